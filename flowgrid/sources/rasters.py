"""ESRI ASCII grids as cells and back; headers and names of result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEADER = ("ncols", "nrows", "xllcenter", "yllcenter", "cellsize", "nodata_value")


def _grids(spark: SparkSession, path: str) -> DataFrame:
    """raster_id, and the lines and header values of each grid; a file is one row.  Files lie in folders raster_id=..., or have a name each."""
    text = spark.read.text(path, wholetext=True)
    if "raster_id" not in text.columns:
        text = text.withColumn("raster_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[a-z]+)?$", 1))
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    head = F.transform(F.slice("lines", 1, 6), lambda x: F.split(F.lower(F.trim(x)), r"\s+"))
    on = text.select(F.col("raster_id").cast("string").alias("raster_id"), lines.alias("lines")).withColumn("head", F.map_from_entries(F.transform(head, lambda p: F.struct(F.get(p, F.lit(0)), F.get(p, F.lit(1)).cast("double")))))
    h = lambda k: F.col("head")[k]
    corner = lambda a: F.coalesce(h(f"{a}llcenter"), h(f"{a}llcorner") + h("cellsize") / 2)
    return on.select("raster_id", "lines", h("nrows").cast("int").alias("nrows"), h("ncols").cast("int").alias("ncols"), corner("x").alias("xll"), corner("y").alias("yll"), h("cellsize").alias("cellsize"), h("nodata_value").alias("nodata"))


def raster_catalog(spark: SparkSession, path: str) -> DataFrame:
    """raster_id, nrows, ncols, xll, yll (of the lower left centre), cellsize, nodata of each grid."""
    return _grids(spark, path).drop("lines")


def headers_equal(rasters: DataFrame) -> DataFrame:
    """One row: number of rasters, of different headers, and whether all are equal."""
    one = F.struct("nrows", "ncols", "xll", "yll", "cellsize")
    return rasters.agg(F.count("*").alias("n"), F.count_distinct(one).alias("n_headers")).withColumn("equal", F.col("n_headers") <= 1)


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """raster_id, r, c, value: the cells of all grids under path, southern row first; nodata is null."""
    grids = _grids(spark, path)
    rows = grids.select("raster_id", "nrows", "nodata", F.posexplode(F.slice("lines", 7, 1 << 30)).alias("i", "line"))
    cells = rows.select("raster_id", (F.col("nrows") - 1 - F.col("i")).cast("int").alias("r"), "nodata", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("c", "v"))
    v = F.col("v").cast("double")
    return cells.select("raster_id", "r", "c", F.when((v != F.col("nodata")) & ~F.isnan(v), v).alias("value"))


def write_ascii_grid(cells: DataFrame, rasters: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One ASCII grid for each raster in a folder raster_id=..., northern row first; cells without a value are nodata.

    A row of text is made of a row of cells, and a file of the rows; no task sees more than one raster at a time.
    """
    dense = rasters.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("nrows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("ncols") - 1)))
    on = dense.join(cells.select("raster_id", "r", "c", "value"), ["raster_id", "r", "c"], "left")
    text = F.coalesce("value", "nodata").cast("string")
    lines = on.groupBy(*rasters.columns, "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", text.alias("v")))), lambda x: x["v"]), " ").alias("line"))
    body = lines.groupBy(*rasters.columns).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "line")), asc=False), lambda x: x["line"]), "\n").alias("body"))
    values = ("ncols", "nrows", "xll", "yll", "cellsize", "nodata")
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{name} "), F.col(c).cast("string")) for name, c in zip(HEADER, values, strict=True)])
    body.select("raster_id", F.concat_ws("\n", head, "body").alias("value")).write.mode(mode).partitionBy("raster_id").text(path)


def find_remeshed(catalog: DataFrame, name: str, cellsize: float, threshold: float = 0.001) -> DataFrame:
    """At most one row of a catalogue: a grid whose raster_id has name in it and whose cell size is within threshold of cellsize (the nearest)."""
    off = F.abs(F.col("cellsize") - cellsize)
    return catalog.where(F.col("raster_id").contains(name) & (off < threshold)).orderBy(off, "raster_id").limit(1)


def remeshed_raster(cells: DataFrame, header: tuple[int, int, float, float, float], name: str, cellsize: float, folder: str, threshold: float = 0.001, larger: bool = False) -> tuple[DataFrame, bool]:
    """(cells of the raster in the wanted cell size, whether folder had them already); header: nrows, ncols, xll, yll, cellsize.

    A raster that is of that size within threshold stays as it is.  Else the catalogue of folder is searched for name; what it
    lacks is remeshed, written there as `name_remeshed<size>` and read back, so the next call finds it.
    """
    from flowgrid.operators.grids import remesh, remeshed_shape

    if abs(header[4] - cellsize) < threshold:
        return cells, False
    spark = cells.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    found = find_remeshed(raster_catalog(spark, folder), name, cellsize, threshold).first() if there else None
    own = found.raster_id if found else f"{name}_remeshed{cellsize:g}"
    if not found:
        nrows, ncols = remeshed_shape(*header[:2], header[4], cellsize, larger)
        row = spark.createDataFrame([(own, nrows, ncols, header[2], header[3], float(cellsize), -9999.0)], "raster_id string, nrows int, ncols int, xll double, yll double, cellsize double, nodata double")
        new = remesh(cells, *header[:2], header[4], cellsize, larger=larger)
        write_ascii_grid(new.withColumn("raster_id", F.lit(own)), row, folder, mode="append")
    return read_ascii_grid(spark, folder).where(F.col("raster_id") == own).select("r", "c", "value"), bool(found)


def parse_result_names(files: DataFrame, column: str = "path") -> DataFrame:
    """Parts of a result file's name: release_area, sim_id, is_default, calibration, sim_type, model_type, res_type, time_step.

    release[_AF_more]_id[_C|_D][_S|_M|_L]_simtype_model_restype[_t<seconds>]; an _AF_ belongs to the release name.
    """
    name = F.regexp_extract(F.col(column), r"([^/]+?)(\.[A-Za-z]+)?$", 1)
    pattern = r"^(.+?(?:_AF)?)_([0-9a-zA-Z.]+?)(?:_([CD]))?(?:_([SML]))?_(null|ent|res|entres)_([A-Za-z0-9]+)_([A-Za-z]+?)(?:_t([0-9.]+))?$"
    part = lambda i: F.nullif(F.regexp_extract(F.col("_n"), pattern, i), F.lit(""))
    names = ("release_area", "sim_id", "is_default", "calibration", "sim_type", "model_type", "res_type")
    return files.withColumn("_n", name).select(*files.columns, *[part(i).alias(n) for i, n in enumerate(names, 1)], part(8).cast("double").alias("time_step"))


def pivot_results_by_sim(results: DataFrame, types: list[str]) -> DataFrame:
    """One row for each simulation, the path of each type in a column of its own (the first in order)."""
    return results.groupBy("sim_name").pivot("res_type", types).agg(F.min("path"))


def complete_types(pivoted: DataFrame, types: list[str]) -> list[str]:
    """Types that all simulations have."""
    told = pivoted.agg(*[(F.count(t) == F.count(F.lit(1))).alias(t) for t in types]).first()
    return [t for t in types if told[t]]


def read_time_fields(results: DataFrame, types: list[str], times: list[float] | None = None) -> DataFrame:
    """Results of the given types with their time, in order; only those near one of the times (1e-6 + 1e-5 * |time|)."""
    own = results.where(F.col("res_type").isin(types)).withColumn("t", F.regexp_extract("path", r"_t([0-9.]+?)(?:\.[A-Za-z]+)?$", 1).try_cast("double"))
    if times is not None:
        near = [F.abs(F.col("t") - t) <= 1e-6 + 1e-5 * abs(t) for t in times]
        hit: Column = near[0]
        for n in near[1:]:
            hit = hit | n
        own = own.where(hit)
    return own.orderBy("t")


def generate_dem(terrains: DataFrame, nrows: int, ncols: int, cellsize: float) -> DataFrame:
    """terrain_id, r, c, z of analytic terrains: terrains(terrain_id, kind, z0, angle, length).

    flat; plane (inclined by angle in x); hockey (parabola to a flat end at `length`); parabola; bowl; pyramid; helix.
    Made on the executors from row and column numbers.
    """
    grid = terrains.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(nrows - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(ncols - 1))))
    x, y, z0, long = F.col("c") * cellsize, (F.col("r") - (nrows - 1) / 2) * cellsize, F.col("z0"), F.col("length")
    xm = x - (ncols - 1) * cellsize / 2
    slope = F.tan(F.radians("angle"))
    curve = F.when(x < long, z0 * (1 - x / long) ** 2).otherwise(0.0)
    radius = F.sqrt(xm**2 + y**2)
    kinds = {"flat": z0 * 0, "plane": z0 - x * slope, "hockey": curve, "parabola": curve + 0.01 * y**2, "bowl": z0 * (radius / long) ** 2, "pyramid": F.greatest(F.lit(0.0), z0 - F.greatest(F.abs(xm), F.abs(y)) * slope), "helix": z0 * (F.atan2(y, xm) / (2 * 3.141592653589793) + 0.5) + 0.01 * (radius - long) ** 2}
    z = F.lit(None).cast("double")
    for kind, form in kinds.items():
        z = F.when(F.col("kind") == kind, form).otherwise(z)
    return grid.select("terrain_id", "r", "c", z.alias("z"))


def last_section(lines: DataFrame, key: str = "file") -> DataFrame:
    """lines (file, i, line) with the section each belongs to: the last [name] before it."""
    name = F.nullif(F.regexp_extract("line", r"^\s*\[([^\]]+)\]", 1), F.lit(""))
    order = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(name, ignorenulls=True).over(order))
