"""Queries that replay a table as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.sources.shared import new_path
from flowgrid.streaming import fields as S
from flowgrid.streaming.merged import MergedPeaks

from .particles import VIEW, view
from .registry import Inputs, query, rounded

SCHEMA = "sim_name string, t double, res_type string, r int, c int, value double"


def stream(x: Inputs) -> DataFrame:
    path = new_path(x.spark, "steps")
    x.cells_t.repartition(8, "t").write.parquet(path)
    # A last time step long after the others closes their windows.
    x.spark.createDataFrame([("", 1e6, "", -1, -1, None)], SCHEMA).write.mode("append").parquet(path)
    return S.field_stream(x.spark, path, SCHEMA)


@query("SELECT sim_name, res_type, CAST(t AS BIGINT) AS start, max(value) AS value FROM cells_t GROUP BY 1, 2, 3")
def stream_time_step_max(x: Inputs) -> DataFrame:
    out = S.run_available(S.stream_time_step_max(stream(x)), "step_max", lambda d: d.groupBy("sim_name", "res_type", "start").agg(F.max("value").alias("value")))
    return out.where("value is not null").withColumn("start", F.unix_seconds("start"))


@query("SELECT sim_name, res_type, r, c, max(value) AS value FROM cells_t GROUP BY 1, 2, 3, 4")
def stream_peak_fields(x: Inputs) -> DataFrame:
    table = MergedPeaks(new_path(x.spark, "peaks"))
    S.run_merging(stream(x), table, new_path(x.spark, "peaks-log"))
    return table.read(x.spark, "sim_name string, res_type string, r int, c int, value double")


@query(f"""WITH {VIEW} SELECT k.sim_name, CAST(k.t AS BIGINT) AS start, round(min(v."range"), 6) AS "range" FROM cells_t k JOIN view v ON k.r = v.r AND k.c = v.c WHERE value > 60 GROUP BY 1, 2""".replace("view", "vw"))
def stream_front(x: Inputs) -> DataFrame:
    table = new_path(x.spark, "front")
    S.run_appending(S.stream_front(stream(x), view(x), 60.0), table, new_path(x.spark, "front-log"))
    out = x.spark.read.schema("sim_name string, start timestamp, range double").parquet(table)
    return rounded(out.withColumn("start", F.unix_seconds("start")), "range")
