"""Queries over ensembles of rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.operators import ensemble as E

from .registry import Inputs, query, rounded


@query("""SELECT g.r, g.c, round(coalesce(h.hits, 0) / CAST((SELECT count(DISTINCT sim_name) FROM cells WHERE res_type = 'ppr') AS DOUBLE), 6) AS probability
FROM (SELECT DISTINCT r, c FROM cells) g LEFT JOIN (SELECT r, c, count(*) AS hits FROM cells WHERE res_type = 'ppr' AND value > 40 GROUP BY r, c) h ON g.r = h.r AND g.c = h.c""")
def exceedance_probability(x: Inputs) -> DataFrame:
    return rounded(E.exceedance_probability(x.cells, 40.0, "ppr", grid=x.cells), "probability")


@query("""WITH own AS (SELECT c.*, s.scenario FROM cells c JOIN sims s ON c.sim_name = s.sim_name WHERE res_type = 'ppr'), n AS (SELECT scenario, count(DISTINCT sim_name) AS total FROM own GROUP BY scenario UNION ALL SELECT NULL, count(DISTINCT sim_name) FROM own),
h AS (SELECT r, c, scenario, count(*) FILTER (WHERE value > 40) AS hits FROM own GROUP BY GROUPING SETS ((r, c), (r, c, scenario)))
SELECT h.r, h.c, h.scenario, round(h.hits / CAST(n.total AS DOUBLE), 6) AS probability FROM h JOIN n ON h.scenario IS NOT DISTINCT FROM n.scenario""")
def probability_by_scenario(x: Inputs) -> DataFrame:
    return rounded(E.probability_by_scenario(x.cells, x.sims, 40.0), "probability")


@query("""WITH m AS (SELECT c.* FROM cells c JOIN (SELECT sim_name, r, c FROM cells WHERE res_type = 'ppr' AND value <> 0) k ON c.sim_name = k.sim_name AND c.r = k.r AND c.c = k.c)
SELECT m.sim_name, res_type, max(value) AS v_max, min(value) AS v_min, round(avg(value), 6) AS v_mean, round(stddev_pop(value), 6) AS v_std, rel_th, scenario FROM m JOIN sims s ON m.sim_name = s.sim_name GROUP BY m.sim_name, res_type, rel_th, scenario""")
def field_stats(x: Inputs) -> DataFrame:
    return rounded(E.field_stats(x.cells, x.sims.select("sim_name", "rel_th", "scenario"), "ppr"), "v_mean", "v_std")


@query("""SELECT sim_name, res_type, max(value) AS v_max, coalesce(min(value) FILTER (WHERE value >= 30), 0) AS v_min, round(coalesce(avg(value) FILTER (WHERE value >= 30), 0), 6) AS v_mean, round(coalesce(stddev_pop(value) FILTER (WHERE value >= 30), 0), 6) AS v_std FROM cells GROUP BY sim_name, res_type""")
def field_stats_thresholded(x: Inputs) -> DataFrame:
    return rounded(E.field_stats_thresholded(x.cells, 30.0), "v_mean", "v_std")


@query("SELECT sim_name, t, max(value) FILTER (WHERE res_type = 'ppr') AS ppr, max(value) FILTER (WHERE res_type = 'pft') AS pft, max(value) FILTER (WHERE res_type = 'pfv') AS pfv FROM cells_t GROUP BY sim_name, t")
def time_step_max(x: Inputs) -> DataFrame:
    return E.time_step_max(x.cells_t, ["ppr", "pft", "pfv"])


@query("SELECT sim_name, res_type, r, c, max(value) AS value FROM cells_t GROUP BY sim_name, res_type, r, c")
def peak_over_time(x: Inputs) -> DataFrame:
    return E.peak_over_time(x.cells_t)


@query("""WITH ref AS (SELECT r, c FROM cells WHERE res_type = 'ppr' AND sim_name = 'sim0' AND value > 30), hit AS (SELECT s.sim_name, s.r, s.c, ref.r IS NOT NULL AS m FROM cells s LEFT JOIN ref ON s.r = ref.r AND s.c = ref.c WHERE res_type = 'ppr' AND value > 35),
k AS (SELECT n.sim_name, count(m) FILTER (WHERE m) AS tp, count(m) FILTER (WHERE NOT m) AS fp FROM (SELECT DISTINCT sim_name FROM cells WHERE res_type = 'ppr') n LEFT JOIN hit ON n.sim_name = hit.sim_name GROUP BY n.sim_name)
SELECT sim_name, tp, fp, (SELECT count(*) FROM ref) - tp AS fn, 25.0 * tp AS a_tp, 25.0 * fp AS a_fp, 25.0 * ((SELECT count(*) FROM ref) - tp) AS a_fn FROM k""")
def area_confusion(x: Inputs) -> DataFrame:
    ppr = x.cells.where("res_type = 'ppr'")
    return E.area_confusion(ppr.where("sim_name = 'sim0'"), ppr, 30.0, 35.0, 25.0)


PAIR = "SELECT a.value AS a, b.value AS b, coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c FROM (SELECT * FROM cells WHERE res_type = 'ppr' AND sim_name = 'sim0') a FULL JOIN (SELECT * FROM cells WHERE res_type = 'ppr' AND sim_name = 'sim1') b ON a.r = b.r AND a.c = b.c"


def pair(x: Inputs) -> tuple[DataFrame, DataFrame]:
    ppr = x.cells.where("res_type = 'ppr'")
    return ppr.where("sim_name = 'sim0'"), ppr.where("sim_name = 'sim1'")


@query(f"WITH p AS ({PAIR}) SELECT round(max(coalesce(a, 0) - coalesce(b, 0)), 6) AS d_max, round(avg(coalesce(a, 0) - coalesce(b, 0)), 6) AS d_mean, round(min(coalesce(a, 0) - coalesce(b, 0)), 6) AS d_min FROM p WHERE coalesce(a, 0) <> 0 OR coalesce(b, 0) <> 0")
def difference_stats(x: Inputs) -> DataFrame:
    return rounded(E.difference_stats(*pair(x)), "d_max", "d_mean", "d_min")


@query(f"""WITH p AS ({PAIR}), d AS (SELECT abs(coalesce(a, 0) - coalesce(b, 0)) AS d FROM p WHERE coalesce(a, 0) <> 0 OR coalesce(b, 0) <> 0), s AS (SELECT max(d) AS top, quantile_cont(d, 0.95) AS p95, quantile_cont(d, 0.99) AS p99 FROM d),
b AS (SELECT least(CAST(floor(d / top * 20) AS BIGINT), 19) AS bin, count(*) AS n, any_value(top) AS top, any_value(p95) AS p95, any_value(p99) AS p99 FROM d, s GROUP BY 1)
SELECT bin, round(bin * top / 20, 6) AS lower, n, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS share, round(p95, 9) AS p95, round(p99, 9) AS p99 FROM b""")
def difference_cdf(x: Inputs) -> DataFrame:
    return rounded(rounded(E.difference_cdf(*pair(x)), "lower", "share"), "p95", "p99", digits=9)


@query(f"""WITH p AS ({PAIR}), q AS (SELECT r, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM p)
SELECT r, round(sqrt(50 * sum((a - b) * (a - b))), 5) AS l2, round(CASE WHEN sum(a * a) > 0 THEN sqrt(50 * sum((a - b) * (a - b))) / sqrt(50 * sum(a * a)) ELSE sqrt(50 * sum((a - b) * (a - b))) END, 6) AS l2_rel, round(max(abs(a - b)), 6) AS l_max, round(CASE WHEN max(abs(a)) > 0 THEN max(abs(a - b)) / max(abs(a)) ELSE max(abs(a - b)) END, 6) AS l_max_rel FROM q GROUP BY r""")
def error_norms(x: Inputs) -> DataFrame:
    a, b = pair(x)
    both = a.select("r", "c", F.col("value").alias("a")).join(b.select("r", "c", F.col("value").alias("b")), ["r", "c"], "full_outer").fillna(0.0)
    return rounded(rounded(E.error_norms(both, ("r",), 5.0, 0.5), "l2", digits=5), "l2_rel", "l_max", "l_max_rel")


@query("SELECT sim_name, greatest(min(r) - 2, 0) AS r_min, least(max(r) + 2, 39) AS r_max, greatest(min(c) - 2, 0) AS c_min, least(max(c) + 2, 49) AS c_max FROM cells WHERE value > 95 GROUP BY sim_name")
def data_extent(x: Inputs) -> DataFrame:
    return E.data_extent(x.cells.where("value > 95"), 40, 50, 2)


@query("""WITH v AS (SELECT res_type, value FROM cells), s AS (SELECT min(value) AS lo, max(value) AS hi FROM v), b AS (SELECT res_type, least(CAST(floor((value - lo) / (hi - lo) * 12) AS BIGINT), 11) AS bin, count(*) AS n FROM v, s GROUP BY 1, 2)
SELECT res_type, bin, n, round(sum(n) OVER (PARTITION BY res_type ORDER BY bin) / sum(n) OVER (PARTITION BY res_type), 6) AS ecdf FROM b""")
def histogram_ecdf(x: Inputs) -> DataFrame:
    return rounded(E.histogram_ecdf(x.cells, "value", 12, "res_type"), "ecdf")


@query("""WITH l AS (SELECT res_type, 'v_max' AS quantity, v_max AS v FROM (SELECT sim_name, res_type, max(value) AS v_max, avg(value) AS v_mean FROM cells GROUP BY 1, 2) UNION ALL SELECT res_type, 'v_mean', v_mean FROM (SELECT sim_name, res_type, max(value) AS v_max, avg(value) AS v_mean FROM cells GROUP BY 1, 2))
SELECT res_type, quantity, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS v_min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS v_max FROM l GROUP BY res_type, quantity""")
def runout_ensemble_stats(x: Inputs) -> DataFrame:
    rows = x.cells.groupBy("sim_name", "res_type").agg(F.max("value").alias("v_max"), F.avg("value").alias("v_mean"))
    return rounded(E.runout_ensemble_stats(rows, ["v_max", "v_mean"], ["res_type"]), "mean", "std", "v_min", "q25", "q50", "q75", "v_max")


@query("""WITH a AS (SELECT event_type, CAST(event_id % 83 AS DOUBLE) / 2 AS angle FROM events), box AS (SELECT event_type, avg(angle) AS mean, quantile_cont(angle, 0.25) AS q25, quantile_cont(angle, 0.5) AS q50, quantile_cont(angle, 0.75) AS q75, count(*) AS total FROM a GROUP BY 1)
SELECT a.event_type, CAST(floor(angle / 5) AS BIGINT) AS bin, count(*) AS n, any_value(total) AS total, round(any_value(mean), 6) AS mean, any_value(q25) AS q25, any_value(q50) AS q50, any_value(q75) AS q75 FROM a JOIN box ON a.event_type = box.event_type GROUP BY 1, 2""")
def event_angle_stats(x: Inputs) -> DataFrame:
    return rounded(E.event_angle_stats(x.events.select("event_type", (F.col("event_id") % 83 / 2.0).alias("angle")), "angle", "event_type", 5.0), "mean")


@query("""SELECT CAST(r + 10 * (CAST(substr(sim_name, 4) AS BIGINT) % 3) AS BIGINT) AS "Y", CAST(c + 20 * (CAST(substr(sim_name, 4) AS BIGINT) % 4) AS BIGINT) AS "X", max(value) AS v_max, min(value) AS v_min, round(avg(value), 9) AS v_mean, round(sum(value), 9) AS v_sum, count(*) AS n FROM cells WHERE res_type = 'ppr' GROUP BY 1, 2""")
def mosaic_rasters(x: Inputs) -> DataFrame:
    k = F.substring("sim_name", 4, 9).cast("long")
    rasters = x.sims.select(F.col("sim_name").alias("raster_id"), (100.0 * (k % 4)).alias("xll"), (50.0 * (k % 3)).alias("yll"), F.lit(5.0).alias("cellsize"))
    return rounded(E.mosaic_rasters(rasters, x.cells.where("res_type = 'ppr'").withColumnRenamed("sim_name", "raster_id")), "v_mean", "v_sum", digits=9)


def merged(x: Inputs, how: str) -> DataFrame:
    return E.merge_tiles(x.cells.select(F.col("r").alias("gr"), F.col("c").alias("gc"), F.when(F.col("value") > 20, F.col("value")).otherwise(-9999.0).alias("value")), how)


@query("""WITH v AS (SELECT r AS gr, c AS gc, CASE WHEN value > 20 THEN value ELSE -9999.0 END AS value FROM cells) SELECT gr, gc, 'max' AS how, max(value) AS value FROM v GROUP BY 1, 2 UNION ALL SELECT gr, gc, 'sum', round(sum(value), 6) FROM v GROUP BY 1, 2
UNION ALL SELECT gr, gc, 'min', coalesce(min(value) FILTER (WHERE value >= 0), max(value)) FROM v GROUP BY 1, 2""")
def merge_tiles(x: Inputs) -> DataFrame:
    out = [merged(x, how).select("gr", "gc", F.lit(how).alias("how"), F.round("value", 6).alias("value")) for how in ("max", "sum", "min")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH s AS (SELECT sim_name, max(value) AS v_max, min(value) AS v_min FROM cells GROUP BY 1), l AS (SELECT sim_name, 'v_max' AS characteristic, v_max AS sim FROM s UNION ALL SELECT sim_name, 'v_min', v_min FROM s), j AS (SELECT l.*, ref.sim AS ref FROM l JOIN l ref ON l.characteristic = ref.characteristic AND ref.sim_name = 'sim0')
SELECT sim_name, characteristic, ref, sim, round(CASE WHEN ref = 0 AND sim = 0 THEN 0 WHEN ref <> 0 THEN (ref - sim) / ref END, 6) AS relative, coalesce(abs((ref - sim) / ref) > 0.01, true) AS differs FROM j""")
def compare_report(x: Inputs) -> DataFrame:
    stats = x.cells.groupBy("sim_name").agg(F.max("value").alias("v_max"), F.min("value").alias("v_min"))
    return rounded(E.compare_report(stats.where("sim_name = 'sim0'").drop("sim_name"), stats, ["v_max", "v_min"], 0.01), "relative")
