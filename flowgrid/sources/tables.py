"""Configurations, mass series, logs, particles, features and descriptors as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rasters import last_section


def read_sim_configs(spark: SparkSession, path: str) -> DataFrame:
    """sim_name, key, value of ini files (one in each folder sim_name=...): sections flattened, a repeated key gets _1, _2 ...

    An ini file is small and read whole, so that its lines keep their order.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.col("sim_name").cast("string").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"))
    pairs = last_section(lines).withColumn("key", F.trim(F.regexp_extract("line", r"^\s*([^=\[#;]+?)\s*=", 1))).where("key <> ''").withColumn("value", F.trim(F.regexp_extract("line", r"=\s*(.*)$", 1)))
    n = F.row_number().over(Window.partitionBy("file", "key").orderBy("i")) - 1
    return pairs.withColumn("_n", n).select(F.col("file").alias("sim_name"), "section", F.when(F.col("_n") > 0, F.concat("key", F.lit("_"), F.col("_n").cast("string"))).otherwise(F.col("key")).alias("key"), "value")


def wide_configs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each simulation with the keys wanted as columns."""
    return pairs.groupBy("sim_name").pivot("key", keys).agg(F.first("value"))


def append_sim_table(old: DataFrame, new: DataFrame, timing: DataFrame | None = None) -> DataFrame:
    """The old table and the new simulations that are not in it, with timing columns joined by name."""
    both = old.unionByName(new.join(old.select("sim_name"), "sim_name", "left_anti"), allowMissingColumns=True)
    return both.join(timing, "sim_name", "left") if timing is not None else both


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    out = df.write.mode("overwrite").option("header", True)
    (out.partitionBy(*by) if by else out).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).schema(schema).csv(path)


def export_particles(particles: DataFrame, properties: list[str], path: str, xll: float = 0.0, yll: float = 0.0) -> None:
    """Snapshots as csv by simulation and time: absolute X, Y, Z, the properties, velocityMagnitude, time."""
    speed = F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2 + F.col("uz") ** 2)
    out = particles.select("sim_name", "t", "id", (F.col("x") + xll).alias("X"), (F.col("y") + yll).alias("Y"), F.col("z").alias("Z"), *properties, speed.alias("velocityMagnitude"), F.col("t").alias("time"))
    write_csv(out, path, ["sim_name", "t"])


def parse_sim_log(spark: SparkSession, path: str) -> DataFrame:
    """sim_name, step, t, mass, entrained, stop of log files (one in each folder sim_name=...).

    Lines `time <t> mass <m> entrained <e>` make the series; `stop <reason>` names the criterion.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select("sim_name", F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"))
    number = lambda k: F.regexp_extract("line", rf"\b{k}\s+([-0-9.eE+]+)", 1).try_cast("double")
    stop = F.nullif(F.regexp_extract("line", r"^stop\s+(.*)$", 1), F.lit(""))
    every = lines.withColumn("stop", F.max(stop).over(Window.partitionBy("sim_name"))).where(F.col("line").rlike(r"^time\s"))
    return every.select("sim_name", F.row_number().over(Window.partitionBy("sim_name").orderBy("i")).alias("step"), number("time").alias("t"), number("mass").alias("mass"), number("entrained").alias("entrained"), "stop")


def common_sims(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a whose simulation b has too."""
    return a.join(b.select("sim_name").distinct(), "sim_name", "left_semi")


def read_features(spark: SparkSession, path: str, keep: str | None = None, drop: str | None = None) -> DataFrame:
    """feature_id, name, thickness, ci95, kind, part, seq, x, y from csv with WKT shapes; keep or drop one feature by name.

    POLYGON, LINESTRING and POINT, with or without MULTI, and further numbers in a place (z) are left out.  part numbers
    the rings, lines or points of a feature; a polygon's first ring is its outline, others are holes or further parts.
    """
    rows = read_csv(spark, path, "feature_id long, name string, thickness double, ci95 double, wkt string")
    if keep is not None:
        rows = rows.where(F.col("name") == keep)
    if drop is not None:
        rows = rows.where(F.col("name") != drop)
    kind = F.lower(F.regexp_extract("wkt", r"^\s*(?:MULTI)?([A-Za-z]+)", 1))
    parts = rows.select("feature_id", "name", "thickness", "ci95", kind.alias("kind"), F.posexplode(F.regexp_extract_all("wkt", F.lit(r"\(([^()]+)\)"), F.lit(1))).alias("part", "places"))
    each = parts.select("feature_id", "name", "thickness", "ci95", "kind", "part", F.posexplode(F.split("places", r",\s*")).alias("seq", "p"))
    place = F.split(F.trim("p"), r"\s+")
    return each.select("feature_id", "name", "thickness", "ci95", "kind", "part", "seq", F.get(place, F.lit(0)).cast("double").alias("x"), F.get(place, F.lit(1)).cast("double").alias("y"))


def features_outside(vertices: DataFrame, dem: DataFrame) -> DataFrame:
    """feature_id, n_outside: features with a vertex whose cell is not in the terrain, or has no elevation."""
    at = vertices.withColumn("r", F.rint("y").cast("int")).withColumn("c", F.rint("x").cast("int"))
    return at.join(dem.select("r", "c", "z"), ["r", "c"], "left").groupBy("feature_id").agg(F.count_if(F.col("z").isNull()).alias("n_outside")).where("n_outside > 0")


def read_benchmark_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """Descriptors (NAME, AVANAME, TAGS, TYPE, FILES) from JSON files."""
    return spark.read.option("multiLine", True).schema("NAME string, AVANAME string, TAGS array<string>, TYPE array<string>, FILES array<string>").json(path)
