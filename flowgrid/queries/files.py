"""Queries through files: derived tables are written to the shared folder and read back by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowgrid.operators import sampling as A
from flowgrid.sources import rasters as R
from flowgrid.sources import tables as B
from flowgrid.sources.shared import new_path

from .registry import Inputs, query, rounded

PPR = "(SELECT sim_name AS raster_id, r, c, value FROM cells WHERE res_type = 'ppr')"


def ascii_path(x: Inputs) -> str:
    path = new_path(x.spark, "grids")
    rasters = x.sims.select(F.col("sim_name").alias("raster_id"), F.lit(40).alias("nrows"), F.lit(50).alias("ncols"), F.lit(0.5).alias("xll"), F.lit(1.5).alias("yll"), F.lit(1.0).alias("cellsize"), F.lit(-9999.0).alias("nodata"))
    R.write_ascii_grid(x.cells.where("res_type = 'ppr'").withColumnRenamed("sim_name", "raster_id"), rasters, path)
    return path


DENSE = f"SELECT s.sim_name AS raster_id, CAST(i AS INT) AS r, CAST(j AS INT) AS c, v.value FROM (SELECT DISTINCT sim_name FROM sims) s CROSS JOIN range(40) a(i) CROSS JOIN range(50) b(j) LEFT JOIN {PPR} v ON v.raster_id = s.sim_name AND v.r = i AND v.c = j"


@query(DENSE)
def read_ascii_grid(x: Inputs) -> DataFrame:
    return R.read_ascii_grid(x.spark, ascii_path(x))


@query(f"WITH d AS ({DENSE}), l AS (SELECT raster_id, r, string_agg(CASE WHEN value IS NULL THEN 'x' ELSE 'v' END, '' ORDER BY c) AS line FROM d GROUP BY 1, 2) SELECT raster_id, CAST(40 - r AS BIGINT) AS line_number, line FROM l")
def write_ascii_grid(x: Inputs) -> DataFrame:
    text = x.spark.read.text(ascii_path(x), wholetext=True)
    lines = text.select("raster_id", F.posexplode(F.slice(F.split("value", "\n"), 7, 40)).alias("i", "line"))
    marks = F.array_join(F.transform(F.split("line", " "), lambda v: F.when(v == "-9999.0", "x").otherwise("v")), "")
    return lines.select("raster_id", (F.col("i") + 1).cast("long").alias("line_number"), marks.alias("line"))


@query("SELECT DISTINCT sim_name AS raster_id, 40 AS nrows, 50 AS ncols, 0.5 AS xll, 1.5 AS yll, 1.0 AS cellsize, -9999.0 AS nodata FROM sims")
def raster_catalog(x: Inputs) -> DataFrame:
    return R.raster_catalog(x.spark, ascii_path(x))


@query("SELECT count(DISTINCT sim_name) AS n, CAST(1 AS BIGINT) AS n_headers, true AS equal FROM sims")
def headers_equal(x: Inputs) -> DataFrame:
    return R.headers_equal(R.raster_catalog(x.spark, ascii_path(x)))


NAMES = "SELECT l_orderkey AS k, l_linenumber AS n, concat('out/rel', CAST(l_suppkey AS STRING), CASE WHEN l_linenumber = 2 THEN '_AF' ELSE '' END, '_', lpad(CAST(l_partkey AS STRING), 6, 'a'), CASE WHEN l_linenumber = 3 THEN '_C' ELSE '' END, CASE WHEN l_linenumber = 3 THEN '_M' ELSE '' END, '_null_dfa_', CASE l_returnflag WHEN 'A' THEN 'ppr' WHEN 'N' THEN 'pft' ELSE 'pfv' END, CASE WHEN l_linenumber < 4 THEN concat('_t', CAST(l_linenumber * 5 AS STRING), '.00') ELSE '' END, '.asc') AS path, l_suppkey, l_partkey, l_returnflag FROM lineitem"


def names(x: Inputs) -> DataFrame:
    return x.spark.sql(NAMES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=x.lineitem)


@query(f"""SELECT k, n, path, concat('rel', CAST(l_suppkey AS STRING), CASE WHEN n = 2 THEN '_AF' ELSE '' END) AS release_area, lpad(CAST(l_partkey AS STRING), 6, 'a') AS sim_id, CASE WHEN n = 3 THEN 'C' END AS is_default, CASE WHEN n = 3 THEN 'M' END AS calibration, 'null' AS sim_type, 'dfa' AS model_type,
CASE l_returnflag WHEN 'A' THEN 'ppr' WHEN 'N' THEN 'pft' ELSE 'pfv' END AS res_type, CASE WHEN n < 4 THEN CAST(n * 5 AS DOUBLE) END AS time_step FROM ({NAMES}) q""")
def parse_result_names(x: Inputs) -> DataFrame:
    return R.parse_result_names(names(x).select("k", "n", "path"))


@query(f"WITH q AS ({NAMES}) SELECT concat('sim', CAST(l_suppkey AS STRING)) AS sim_name, min(path) FILTER (WHERE l_returnflag = 'A') AS ppr, min(path) FILTER (WHERE l_returnflag = 'N') AS pft, min(path) FILTER (WHERE l_returnflag = 'R') AS pfv FROM q GROUP BY 1")
def pivot_results_by_sim(x: Inputs) -> DataFrame:
    results = names(x).select(F.concat(F.lit("sim"), F.col("l_suppkey").cast("string")).alias("sim_name"), "path", "l_returnflag").replace({"A": "ppr", "N": "pft", "R": "pfv"}, subset=["l_returnflag"]).withColumnRenamed("l_returnflag", "res_type")
    return R.pivot_results_by_sim(results, ["ppr", "pft", "pfv"])


@query(f"WITH q AS ({NAMES}) SELECT k, n, path, CAST(n * 5 AS DOUBLE) AS t FROM q WHERE l_returnflag IN ('A', 'R') AND n IN (1, 3)")
def read_time_fields(x: Inputs) -> DataFrame:
    results = names(x).replace({"A": "ppr", "N": "pft", "R": "pfv"}, subset=["l_returnflag"]).withColumnRenamed("l_returnflag", "res_type")
    return R.read_time_fields(results, ["ppr", "pfv"], [5.0, 15.0]).select("k", "n", "path", "t")


@query("""SELECT sim_name, 'GENERAL' AS section, 'relTh' AS key, CAST(rel_th AS STRING) AS value FROM sims UNION ALL SELECT sim_name, 'GENERAL', 'simType', sim_type FROM sims UNION ALL SELECT sim_name, 'FRICTION', 'mu', CAST(round(mu, 2) AS STRING) FROM sims UNION ALL SELECT sim_name, 'FRICTION', 'relTh_1', scenario FROM sims""")
def read_sim_configs(x: Inputs) -> DataFrame:
    path = new_path(x.spark, "configs")
    text = F.concat_ws("\n", F.lit("[GENERAL]"), F.lit("# comment"), F.concat(F.lit("relTh = "), F.col("rel_th").cast("string")), F.concat(F.lit("simType="), "sim_type"), F.lit(""), F.lit("[FRICTION]"), F.concat(F.lit("mu = "), F.round("mu", 2).cast("string")), F.concat(F.lit("relTh = "), "scenario"))
    x.sims.select("sim_name", text.alias("value")).write.partitionBy("sim_name").text(path)
    return B.read_sim_configs(x.spark, path)


@query("SELECT s.sim_name, s.rel_th, s.scenario, CASE WHEN s.sim_type = 'null' THEN t.cpu END AS cpu FROM sims s LEFT JOIN (SELECT concat('sim', CAST(s_suppkey % 20 AS STRING)) AS sim_name, count(*) AS cpu FROM supplier GROUP BY 1) t ON s.sim_name = t.sim_name")
def sim_table_csv(x: Inputs) -> DataFrame:
    path = new_path(x.spark, "table")
    cols = ["sim_name", "rel_th", "scenario"]
    B.write_csv(x.sims.where("sim_type = 'null'").select(*cols), path)
    timing = x.supplier.groupBy(F.concat(F.lit("sim"), (F.col("s_suppkey") % 20).cast("string")).alias("sim_name")).agg(F.count("*").alias("cpu"))
    timing = timing.join(x.sims.where("sim_type = 'null'").select("sim_name"), "sim_name", "left_semi")
    return B.append_sim_table(B.read_csv(x.spark, path, "sim_name string, rel_th double, scenario string"), x.sims.select(*cols), timing)


@query("SELECT sim_name, t, total, entrained FROM mass")
def read_mass_series(x: Inputs) -> DataFrame:
    path = new_path(x.spark, "mass")
    B.write_csv(x.mass.select("t", "total", "entrained", "sim_name"), path)  # a file holds the series of many simulations
    return B.read_csv(x.spark, path, "t double, total double, entrained double, sim_name string")


@query('SELECT sim_name, t, id, x + 100 AS "X", y + 200 AS "Y", z AS "Z", m, round(sqrt(ux * ux + uy * uy + uz * uz), 6) AS "velocityMagnitude", t AS time FROM particles')
def export_particles(x: Inputs) -> DataFrame:
    path = new_path(x.spark, "particles")
    B.export_particles(x.particles, ["m"], path, 100.0, 200.0)
    return rounded(B.read_csv(x.spark, path, "id long, X double, Y double, Z double, m double, velocityMagnitude double, time double, sim_name string, t double"), "velocityMagnitude")


KIND = "CASE feature_id % 3 WHEN 0 THEN 'polygon' WHEN 1 THEN 'linestring' ELSE 'point' END"


@query(f"""SELECT feature_id, concat('area', CAST(feature_id AS STRING)) AS name, f.thickness, f.thickness / 10 AS ci95, {KIND} AS kind, CAST(CASE WHEN {KIND} = 'point' THEN seq ELSE 0 END AS INT) AS part, CAST(CASE WHEN {KIND} = 'point' THEN 0 ELSE seq END AS INT) AS seq, round(x, 3) AS x, round(y, 3) AS y FROM vertices JOIN features f USING (feature_id) WHERE feature_id <> 3""")
def read_features(x: Inputs) -> DataFrame:
    path = new_path(x.spark, "features")
    place = F.concat(F.round("x", 3).cast("string"), F.lit(" "), F.round("y", 3).cast("string"))
    places = x.vertices.groupBy("feature_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", place.alias("p")))), lambda v: v["p"]).alias("p"))
    ring, points = F.array_join("p", ", "), F.array_join(F.transform("p", lambda v: F.concat(F.lit("("), v, F.lit(")"))), ", ")
    k = F.col("feature_id") % 3
    wkt = F.when(k == 0, F.concat(F.lit("POLYGON (("), ring, F.lit("))"))).when(k == 1, F.concat(F.lit("LINESTRING ("), ring, F.lit(")"))).otherwise(F.concat(F.lit("MULTIPOINT ("), points, F.lit(")")))
    B.write_csv(places.join(x.features, "feature_id").select("feature_id", "name", "thickness", (F.col("thickness") / 10).alias("ci95"), wkt.alias("wkt")), path)
    return B.read_features(x.spark, path, drop="area3")


@query("SELECT sim_name, CAST(row_number() OVER (PARTITION BY sim_name ORDER BY t) AS INT) AS step, t, total AS mass, entrained, concat('reached ', sim_name) AS stop FROM mass")
def parse_sim_log(x: Inputs) -> DataFrame:
    path = new_path(x.spark, "logs")
    line = F.concat(F.lit("time "), F.col("t").cast("string"), F.lit(" mass "), F.col("total").cast("string"), F.lit(" entrained "), F.col("entrained").cast("string"))
    logs = x.mass.groupBy("sim_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", line.alias("l")))), lambda v: v["l"]), "\n").alias("body"))
    logs.select("sim_name", F.concat(F.lit("start\n"), "body", F.lit("\nstop reached "), "sim_name").alias("value")).write.partitionBy("sim_name").text(path)
    return B.parse_sim_log(x.spark, path)


@query("SELECT concat('test', CAST(p_partkey AS STRING)) AS name, concat('ava', CAST(p_size AS STRING)) AS ava_name, CASE WHEN p_partkey % 2 = 0 THEN 'null,standard' ELSE 'null' END AS tags FROM part")
def read_benchmark_descriptors(x: Inputs) -> DataFrame:
    path = new_path(x.spark, "descriptors")
    k = F.col("p_partkey")
    rows = x.part.select(F.concat(F.lit("test"), k.cast("string")).alias("NAME"), F.concat(F.lit("ava"), F.col("p_size").cast("string")).alias("AVANAME"), F.when(k % 2 == 0, F.array(F.lit("null"), F.lit("standard"))).otherwise(F.array(F.lit("null"))).alias("TAGS"), F.array(F.lit("2D")).alias("TYPE"), F.array(F.lit("a.json")).alias("FILES"))
    # A JSON array in each file, as descriptors are written over several lines.
    each = rows.groupBy(F.pmod(F.hash("NAME"), F.lit(8)).alias("part")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    each.write.partitionBy("part").text(path)
    got = B.read_benchmark_descriptors(x.spark, path)
    return got.select(F.col("NAME").alias("name"), F.col("AVANAME").alias("ava_name"), F.array_join("TAGS", ",").alias("tags"))


@query("""WITH t AS (SELECT s_suppkey AS terrain_id, CASE s_suppkey % 4 WHEN 0 THEN 'flat' WHEN 1 THEN 'plane' WHEN 2 THEN 'parabola' ELSE 'pyramid' END AS kind, 100.0 + s_suppkey AS z0, 20.0 + s_suppkey % 20 AS angle, 90.0 AS length FROM supplier)
SELECT terrain_id, CAST(i AS INT) AS r, CAST(j AS INT) AS c, round(CASE kind WHEN 'flat' THEN 0 WHEN 'plane' THEN z0 - j * 5.0 * tan(radians(angle)) WHEN 'parabola' THEN CASE WHEN j * 5.0 < length THEN z0 * pow(1 - j * 5.0 / length, 2) ELSE 0 END + 0.01 * pow((i - 9.5) * 5.0, 2) ELSE greatest(0, z0 - greatest(abs(j * 5.0 - 60), abs((i - 9.5) * 5.0)) * tan(radians(angle))) END, 6) AS z FROM t, range(20) a(i), range(25) b(j)""")
def generate_dem(x: Inputs) -> DataFrame:
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*[F.lit(n) for n in ("flat", "plane", "parabola", "pyramid")]), (k % 4 + 1).cast("int"))
    terrains = x.supplier.select(k.alias("terrain_id"), kind.alias("kind"), (100.0 + k).alias("z0"), (20.0 + k % 20).alias("angle"), F.lit(90.0).alias("length"))
    return rounded(R.generate_dem(terrains, 20, 25, 5.0), "z")


@query("SELECT c_custkey AS id, d AS dimension, CAST(1 AS BIGINT) AS moves, 0.6 AS distance FROM customer, (VALUES ('mu'), ('xi'), ('relTh')) AS k(d)")
def sample_morris_moves(x: Inputs) -> DataFrame:
    """Along each trajectory every dimension moves once, by half the levels."""
    steps = A.sample_morris(x.customer.select(F.col("c_custkey").alias("id")), ["mu", "xi", "relTh"], 3).unpivot(["id", "step"], ["mu", "xi", "relTh"], "dimension", "u")
    moved = steps.withColumn("d", F.abs(F.col("u") - F.lag("u").over(Window.partitionBy("id", "dimension").orderBy("step"))))
    return moved.groupBy("id", "dimension").agg(F.count_if(F.col("d") > 0).alias("moves"), F.round(F.max("d"), 9).alias("distance"))


@query()
def sample_morris(x: Inputs) -> DataFrame:
    return A.sample_morris(x.customer.select(F.col("c_custkey").alias("id")), ["mu", "xi", "relTh"], 3)


@query("SELECT c_custkey AS id, round(2.0 + (CAST(c_custkey % 50 AS DOUBLE) + 0.5) / 50 * 3.0, 6) AS value FROM customer")
def sample_distribution(x: Inputs) -> DataFrame:
    rows = x.customer.select(F.col("c_custkey").alias("id"))
    return rounded(A.sample_distribution(x.spark, rows, "id", "uniform", 50, low=2.0, high=5.0), "value")


@query("SELECT o_orderkey AS id, round(sqrt(a * a + b * b + c * c), 6) AS norm, round(a * b + b * c + c * a, 6) AS dot, round(b * a - c * c, 6) AS cross_x FROM (SELECT o_orderkey, CAST(o_orderkey % 7 AS DOUBLE) AS a, CAST(o_custkey % 5 AS DOUBLE) AS b, CAST(o_orderkey % 3 AS DOUBLE) + 1 AS c FROM orders) q")
def vector_math(x: Inputs) -> DataFrame:
    from flowgrid.functions import vectors as V

    a, b, c = (F.col(k).cast("double") for k in ("a", "b", "c"))
    rows = x.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7).alias("a"), (F.col("o_custkey") % 5).alias("b"), (F.col("o_orderkey") % 3 + 1).alias("c"))
    u, v = (a, b, c), (b, c, a)
    return rows.select("id", F.round(V.norm(u), 6).alias("norm"), F.round(V.dot(u, v), 6).alias("dot"), F.round(V.cross(u, v)[0], 6).alias("cross_x"))
