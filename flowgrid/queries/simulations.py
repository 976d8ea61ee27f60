"""Queries over tables of simulations, features and parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowgrid.operators import simulations as S

from .registry import Inputs, query, rounded


@query("SELECT * FROM sims WHERE abs(rel_th - 0.75) <= 1e-7 + 1e-8 * 0.75 AND scenario NOT IN ('rel1', 'rel2') OR abs(rel_th - 1.0) <= 1e-7 + 1e-8 AND scenario NOT IN ('rel1', 'rel2')")
def filter_sims(x: Inputs) -> DataFrame:
    return S.filter_sims(x.sims, {"rel_th": [0.75, 1.0], "~scenario": ["rel1", "rel2"]})


@query("""WITH k AS (SELECT l_orderkey AS sim, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1) SELECT sim FROM k WHERE hi < 30""")
def filter_thickness(x: Inputs) -> DataFrame:
    sims = x.lineitem.groupBy(F.col("l_orderkey").alias("sim")).agg(F.collect_list("l_quantity").alias("th"))
    return S.filter_thickness(sims, "th", ["<30"]).select("sim")


@query("SELECT DISTINCT r AS k, 0 AS i, 1.0 AS value FROM dem WHERE r < 0 UNION ALL SELECT CAST(p_partkey AS BIGINT), CAST(i AS INT), round(p_size * 0.8 + i * (p_size * 0.4) / 4, 6) FROM part, (VALUES (0), (1), (2), (3), (4)) AS n(i)")
def expand_value_spec(x: Inputs) -> DataFrame:
    specs = x.part.select(F.col("p_partkey").alias("k"), F.concat(F.col("p_size").cast("string"), F.lit("$20$5")).alias("spec"))
    return rounded(S.expand_value_spec(specs).select("k", "i", "value"), "value")


@query("SELECT * FROM sims WHERE abs(rel_th - 0.5) <= 1.0e-7 + 5e-9 OR abs(rel_th - 0.875) <= 1.0e-7 + 8.75e-9 OR abs(rel_th - 1.25) <= 1.0e-7 + 1.25e-8")
def parse_filter_spec(x: Inputs) -> DataFrame:
    return S.filter_sims(x.sims, S.parse_filter_spec({"rel_th": "0.5:1.25:3"}))


TAGS = "(SELECT o_orderkey AS name, list(DISTINCT l_returnflag) AS tags FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)"


@query(f"SELECT name, 'or' AS how FROM {TAGS} WHERE list_has_any(tags, ['A', 'N']) UNION ALL SELECT name, 'and' FROM {TAGS} WHERE list_has_all(tags, ['A', 'N'])")
def filter_benchmarks(x: Inputs) -> DataFrame:
    tests = x.orders.join(x.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderkey").alias("name")).agg(F.collect_set("l_returnflag").alias("tags"))
    return S.filter_benchmarks(tests, ["A", "N"]).select("name", F.lit("or").alias("how")).unionByName(S.filter_benchmarks(tests, ["A", "N"], "and").select("name", F.lit("and").alias("how")))


@query("""WITH k AS (SELECT l_orderkey AS sim_name, list_sort(list(DISTINCT l_returnflag)) AS have FROM lineitem GROUP BY 1), m AS (SELECT sim_name, array_to_string(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(have, x)), ',') AS missing FROM k) SELECT * FROM m WHERE missing <> ''""")
def require_result_types(x: Inputs) -> DataFrame:
    return S.require_result_types(x.lineitem.select(F.col("l_orderkey").alias("sim_name"), F.col("l_returnflag").alias("res_type")), ["A", "N", "R"])


@query("(SELECT sim_name, rel_th FROM sims ORDER BY abs(rel_th - 0.8), sim_name LIMIT 1) UNION ALL (SELECT sim_name, rel_th FROM sims ORDER BY CASE WHEN lower(scenario) = 'rel3' THEN 0 ELSE 1 END, sim_name LIMIT 1)")
def select_reference_sim(x: Inputs) -> DataFrame:
    return S.select_reference_sim(x.sims, "rel_th", 0.8, ["sim_name"]).unionByName(S.select_reference_sim(x.sims, "scenario", "REL3", ["sim_name"])).select("sim_name", "rel_th")


@query("SELECT sim_name, rel_th FROM sims ORDER BY CASE WHEN lower(scenario) = 'none' THEN 0 WHEN contains(sim_name, '7') THEN 1 ELSE 2 END, sim_name LIMIT 1")
def select_reference_by_name(x: Inputs) -> DataFrame:
    return S.select_reference_sim(x.sims, "scenario", "none", ["sim_name"], in_name="7").select("sim_name", "rel_th")


@query("""WITH h AS (SELECT s_suppkey AS layer, 40 + s_suppkey % 2 AS nrows, 50.0 + CAST(s_suppkey % 3 AS DOUBLE) / 10 AS xll, 20.0 + CAST(s_suppkey % 4 AS DOUBLE) / 5 AS yll, CASE WHEN s_suppkey % 7 = 0 THEN 2.5 ELSE 5.0 END AS cs FROM supplier), k AS (SELECT *, xll + 50 * cs AS xur, yll + nrows * cs AS yur FROM h), d AS (SELECT k.layer, greatest(abs(k.xll - o.xll), abs(k.yll - o.yll)) AS ll, greatest(abs(k.xur - o.xur), abs(k.yur - o.yur)) AS ur, k.cs = o.cs AS same FROM k, k o WHERE o.layer = 1)
SELECT layer, round(ll, 6) AS shift_ll, round(ur, 6) AS shift_ur, same AS same_size, same AND round(greatest(ll, ur), 9) <= 0.5 AS fits FROM d""")
def corner_shifts(x: Inputs) -> DataFrame:
    k = F.col("s_suppkey")
    headers = x.supplier.select(k.alias("layer"), (40 + k % 2).alias("nrows"), F.lit(50).alias("ncols"), (50.0 + k % 3 / 10).alias("xll"), (20.0 + k % 4 / 5).alias("yll"), F.when(k % 7 == 0, 2.5).otherwise(5.0).alias("cellsize"))
    return rounded(S.corner_shifts(headers, 1, 0.1), "shift_ll", "shift_ur")


@query("""WITH l AS (SELECT sim_name AS layer, r, c, CASE WHEN value < 2 THEN NULL WHEN value < 10 THEN -9999 ELSE value END AS value FROM cells), k AS (SELECT layer, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS n_null, count(*) FILTER (WHERE value < 0) AS n_negative, count(*) FILTER (WHERE value > 90) AS n_out, max(r) AS r_max, max(c) AS c_max FROM l GROUP BY 1)
SELECT *, r_max = (SELECT r_max FROM k GROUP BY r_max, c_max ORDER BY count(*) DESC, r_max DESC, c_max DESC LIMIT 1) AND c_max = (SELECT c_max FROM k GROUP BY r_max, c_max ORDER BY count(*) DESC, r_max DESC, c_max DESC LIMIT 1) AS same_extent FROM k""")
def validate_layers(x: Inputs) -> DataFrame:
    v = F.col("value")
    return S.validate_layers(x.cells.select(F.col("sim_name").alias("layer"), "r", "c", F.when(v < 2, None).when(v < 10, -9999.0).otherwise(v).alias("value")), 0, 90)


@query("SELECT c.sim_name, res_type, count(*) AS n, rel_th, mu FROM cells c JOIN sims s ON c.sim_name = s.sim_name GROUP BY 1, 2, 4, 5")
def join_results_config(x: Inputs) -> DataFrame:
    return S.join_results_config(x.cells.groupBy("sim_name", "res_type").agg(F.count("*").alias("n")), x.sims.select("sim_name", "rel_th", "mu"), ["sim_name"])


@query("SELECT DISTINCT o_custkey AS sim_name FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def exclude_existing_sims(x: Inputs) -> DataFrame:
    all_ = x.orders.select(F.col("o_custkey").alias("sim_name"), "o_orderstatus")
    return S.exclude_existing_sims(all_.select("sim_name").distinct(), all_.where("o_orderstatus = 'F'"))


@query("SELECT * FROM sims")
def order_sims(x: Inputs) -> DataFrame:
    return S.order_sims(x.sims, ["rel_th", "sim_name"], ascending=False)


@query("SELECT o_custkey AS sim_name, count(*) AS n FROM (SELECT DISTINCT o_custkey, 1 AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT o_custkey, 2 FROM orders WHERE o_orderstatus = 'O') GROUP BY 1 HAVING count(*) > 1")
def union_ref_comp(x: Inputs) -> DataFrame:
    part = lambda s: x.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("sim_name")).distinct()
    return S.union_ref_comp(part("F"), part("O"))[1]


@query("SELECT coalesce(a.k, b.k) AS res_type, a.k IS NOT NULL AND b.k IS NOT NULL AS common FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') b ON a.k = b.k")
def common_types(x: Inputs) -> DataFrame:
    part = lambda s: x.lineitem.where(F.col("l_returnflag") == s).select(F.col("l_partkey").alias("res_type"))
    return S.common_types(part("A"), part("R"))


@query("SELECT sim_name, t, count(*) AS n FROM cells_t WHERE t > 3 GROUP BY 1, 2")
def latest_time_steps(x: Inputs) -> DataFrame:
    return S.latest_time_steps(x.cells_t, 3.0).groupBy("sim_name", "t").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS price, o_orderstatus AS state, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS maybe, concat(CAST(o_custkey AS STRING), '|1') AS listed FROM orders")
def coerce_numeric(x: Inputs) -> DataFrame:
    k = F.col("o_orderkey")
    table = x.orders.select(k.alias("k"), F.format_string("%.2f", "o_totalprice").alias("price"), F.col("o_orderstatus").alias("state"), F.when(k % 7 == 0, "nan").otherwise((k % 100).cast("string")).alias("maybe"), F.concat(F.col("o_custkey").cast("string"), F.lit("|1")).alias("listed"))
    return S.coerce_numeric(table)


@query("""WITH p AS (SELECT sim_name, 'mu' AS key, CAST(round(mu, 2) AS STRING) AS value FROM sims UNION ALL SELECT sim_name, 'type', sim_type FROM sims UNION ALL SELECT sim_name, 'new', scenario FROM sims)
SELECT sim_name, key, value, CASE key WHEN 'mu' THEN '0.10' WHEN 'type' THEN 'null' END AS default_value, CASE WHEN key = 'new' THEN 'added' ELSE 'changed' END AS state FROM p WHERE key = 'new' OR key = 'mu' AND CAST(value AS DOUBLE) <> 0.1 OR key = 'type' AND value <> 'null'""")
def config_diff(x: Inputs) -> DataFrame:
    config = x.sims.select("sim_name", F.round("mu", 2).cast("string").alias("mu"), F.col("sim_type").alias("type"), F.col("scenario").alias("new")).unpivot(["sim_name"], ["mu", "type", "new"], "key", "value")
    return S.config_diff(config, x.spark.createDataFrame([("mu", "0.10"), ("type", "null")], "key string, value string"))


@query("SELECT sim_name, concat('rel_', sim_name, '_scenario_', scenario, '_null_dfa') AS display_name FROM sims")
def sim_display_name(x: Inputs) -> DataFrame:
    return S.sim_display_name(x.sims.withColumn("n", F.col("sim_name")).withColumn("sim_name", F.concat(F.lit("rel_"), "sim_name", F.lit("_null_dfa"))), ["scenario"]).withColumn("sim_name", F.regexp_extract("sim_name", "(sim[0-9]+)", 1))


@query("""WITH v AS (SELECT DISTINCT mu FROM sims), w AS (SELECT DISTINCT rel_th FROM sims), p AS (SELECT scenario, sim_type, mu, rel_th, substr(sha256(concat('mu=', CAST(mu AS STRING), ';rel_th=', CAST(rel_th AS STRING), ';scenario=', scenario, ';sim_type=', sim_type)), 1, 10) AS sim_hash FROM (SELECT DISTINCT scenario FROM sims), (VALUES ('ent'), ('null')) AS k(sim_type), v, w)
SELECT *, concat(scenario, '_', sim_hash, '_', sim_type) AS sim_name FROM p""")
def variation_grid(x: Inputs) -> DataFrame:
    values = x.sims.unpivot(["sim_name"], ["mu", "rel_th"], "name", "value").select("name", "value").distinct()
    return S.variation_grid(values, x.sims, ["ent", "null"])


@query("SELECT feature_id, scenario, CAST(i AS INT) AS variation, round(0.8 + i * 0.1, 6) AS factor, round(thickness * (0.8 + i * 0.1), 6) AS thickness FROM features, (VALUES (0), (1), (2), (3), (4)) AS n(i) WHERE thickness IS NOT NULL")
def expand_thickness_variation(x: Inputs) -> DataFrame:
    return rounded(S.expand_thickness_variation(x.features, 20.0, 5), "factor", "thickness")


@query("""WITH k AS (SELECT scenario, count(*) AS n, count(thickness) AS known, string_agg(CAST(feature_id AS STRING), '|' ORDER BY feature_id) AS ids, string_agg(CAST(coalesce(thickness, 1.0) AS STRING), '|' ORDER BY feature_id) AS th FROM features GROUP BY 1)
SELECT scenario, ids, CASE WHEN known = n OR known = 0 THEN th END AS thicknesses, CASE WHEN known = n THEN 'ok' WHEN known = 0 THEN 'default' ELSE 'error' END AS state FROM k""")
def resolve_thickness(x: Inputs) -> DataFrame:
    return S.resolve_thickness(x.features, 1.0)


@query("SELECT d AS dimension, CAST(row_number() OVER (PARTITION BY d ORDER BY s_suppkey) - 1 AS BIGINT) AS stratum, CAST(1 AS BIGINT) AS n FROM supplier, (VALUES ('mu'), ('xi')) AS k(d)")
def sample_latin_strata(x: Inputs) -> DataFrame:
    """Every one of n equal strata of every dimension holds exactly one draw."""
    draws = S.sample_latin(x.supplier.select(F.col("s_suppkey").alias("id")), ["mu", "xi"], 7)
    total = F.lit(1.0) * F.count("*").over(Window.partitionBy())
    return draws.withColumn("_n", total).unpivot(["id", "_n"], ["mu", "xi"], "dimension", "u").groupBy("dimension", F.floor(F.col("u") * F.col("_n")).alias("stratum")).agg(F.count("*").alias("n"))


@query()
def sample_latin(x: Inputs) -> DataFrame:
    return S.sample_latin(x.supplier.select(F.col("s_suppkey").alias("id")), ["mu", "xi"], 7)


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'mu' ELSE 'rel_th' END AS name, round(CASE WHEN event_id % 2 = 0 THEN 0.14 + CAST(event_id % 101 AS DOUBLE) / 100 * 0.12 ELSE 0.75 + CAST(event_id % 101 AS DOUBLE) / 100 * 0.5 END, 6) AS value FROM events")
def scale_sample(x: Inputs) -> DataFrame:
    draws = x.events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "mu").otherwise("rel_th").alias("name"), (F.col("event_id") % 101 / 100.0).alias("u"))
    return rounded(S.scale_sample(draws, x.spark.createDataFrame([("mu", 0.2, 30.0), ("rel_th", 1.0, 25.0)], "name string, base double, percent double")), "value")


@query("""WITH b AS (SELECT *, CASE WHEN trim(grp) = '' THEN lpad(CAST(row_number() OVER (PARTITION BY trim(grp) = '' ORDER BY ord) AS STRING), 5, '0') ELSE trim(grp) END AS g FROM features), e AS (SELECT g, name, unnest(string_split(scenario, ',')) AS s FROM b)
SELECT g AS grp, CASE WHEN trim(s) = '' THEN 'NULL' ELSE trim(s) END AS scenario, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM e GROUP BY 1, 2""")
def scenario_groups(x: Inputs) -> DataFrame:
    return S.scenario_groups(x.features)
