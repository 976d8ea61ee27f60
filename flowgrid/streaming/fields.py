"""Streaming forms: results that grow while time steps of running simulations arrive.

Streams carry ts = timestamp_seconds(t); the aggregations are those of the batch operators.  Maxima of time steps are
appended as they change, and as they only rise the table's maximum by key is the state at any time.  Fronts are appended
once, when their window has closed.  Peaks are merged into a table with one row for each cell.  Replays of a batch change
nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowgrid.functions.vectors import above
from flowgrid.sources.shared import new_path
from flowgrid.streaming.merged import MergedPeaks


def field_stream(spark: SparkSession, path: str, schema: str, files: int = 4, delay: str = "1 hour") -> DataFrame:
    """Cells (sim_name, t, res_type, r, c, value) as they arrive, with ts and a watermark."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", delay)


def stream_time_step_max(stream: DataFrame, step: str = "1 second") -> DataFrame:
    """Per simulation, type and tumbling window of time steps the largest value; rows later than the watermark are dropped."""
    return stream.groupBy(F.window("ts", step), "sim_name", "res_type").agg(F.max("value").alias("value")).select("sim_name", "res_type", F.col("window.start").alias("start"), "value")


def stream_front(stream: DataFrame, view: DataFrame, limit: float, step: str = "1 second") -> DataFrame:
    """Per simulation and window of time steps the nearest range (view: r, c, range) of a value above the limit.

    Values are tested within the aggregation, not before it: a filter would go below the watermark, which then would not
    follow time steps in which nothing flows.
    """
    on = stream.join(view.select("r", "c", "range"), ["r", "c"])
    near = F.min(F.when(above(F.col("value"), limit), F.col("range"))).alias("range")
    return on.groupBy(F.window("ts", step), "sim_name").agg(near).where("range is not null").select("sim_name", F.col("window.start").alias("start"), "range")


def run_available(result: DataFrame, label: str, state: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stream over all that is there and return its final state; state reduces the appended changes to one row for each key."""
    spark = result.sparkSession
    table = new_path(spark, label)
    query = result.writeStream.outputMode("update").option("checkpointLocation", new_path(spark, f"{label}-log")).trigger(availableNow=True).foreachBatch(lambda batch, _: batch.write.mode("append").parquet(table)).start()
    query.awaitTermination()
    return state(spark.read.parquet(table))


def run_appending(result: DataFrame, table: str, log: str) -> StreamingQuery:
    """Run a stream over all that is there; windows go to the table once, when the watermark has passed them, and leave the state.

    Rows later than the watermark are dropped.  The table is written by Spark's file sink, so a replayed batch adds nothing.
    A window that no later time step has closed stays in the state until one comes.
    """
    query = result.writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_merging(stream: DataFrame, table: MergedPeaks, log: str) -> StreamingQuery:
    """Run a stream of cells over all that is there and merge each batch into the table; the stream itself keeps no state."""
    query = stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(table.merge).start()
    query.awaitTermination()
    return query
