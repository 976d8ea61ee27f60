"""Statistics over an ensemble of rasters: cells(sim_name, res_type, r, c, value) in long form.

A missing cell is an absent row or a null value, never NaN.  Aggregations are partial before the one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowgrid.functions.ranks import percentiles
from flowgrid.functions.vectors import above


def exceedance_probability(cells: DataFrame, limit: float, res_type: str = "ppr", sims: DataFrame | None = None, grid: DataFrame | None = None) -> DataFrame:
    """r, c, probability: share of the selected simulations whose value is strictly above the limit.

    The denominator is the number of rasters of the type, so a missing cell counts as not exceeded.  Cells at or below
    the limit are dropped before the exchange; cells that no simulation exceeds come back with 0 from grid (r, c), or
    from the cells themselves.
    """
    own = cells.where(F.col("res_type") == res_type)
    if sims is not None:
        own = own.join(sims.select("sim_name").distinct(), "sim_name", "left_semi")
    total = own.agg(F.count_distinct("sim_name").alias("total"))
    hits = own.groupBy("r", "c").agg(F.count_if(above(F.col("value"), limit)).alias("hits"))
    if grid is not None:
        hits = grid.select("r", "c").distinct().join(hits, ["r", "c"], "left").fillna(0, ["hits"])
    return hits.join(F.broadcast(total)).select("r", "c", (F.col("hits") / F.col("total")).alias("probability"))  # one row


def probability_by_scenario(cells: DataFrame, sims: DataFrame, limit: float, res_type: str = "ppr", scenario: str = "scenario") -> DataFrame:
    """r, c, scenario, probability for all simulations (scenario null) and for each scenario, in one grouping."""
    own = cells.where(F.col("res_type") == res_type).join(sims.select("sim_name", F.col(scenario).alias("scenario")), "sim_name")
    per = own.groupBy("sim_name", "scenario").agg(F.lit(1).alias("one"))
    total = per.groupBy("scenario").agg(F.count("*").alias("total")).unionByName(per.agg(F.lit(None).cast("string").alias("scenario"), F.count("*").alias("total")))
    hits = own.groupingSets([["r", "c"], ["r", "c", "scenario"]], "r", "c", "scenario").agg(F.count_if(above(F.col("value"), limit)).alias("hits"))
    return hits.join(total, hits.scenario.eqNullSafe(total.scenario)).select("r", "c", hits.scenario, (F.col("hits") / F.col("total")).alias("probability"))


def masked(cells: DataFrame, mask_type: str) -> DataFrame:
    """cells without those where the simulation's raster of mask_type is 0 or missing; one exchange, by cell."""
    mask = F.max(F.when(F.col("res_type") == mask_type, F.col("value"))).over(Window.partitionBy("sim_name", "r", "c"))
    return cells.withColumn("mask", mask).where(above(F.col("mask"), 0.0) | above(-F.col("mask"), 0.0)).drop("mask")


def field_stats(cells: DataFrame, sims: DataFrame | None = None, mask_type: str | None = None) -> DataFrame:
    """Per simulation and type: maximum, minimum, mean and population deviation, with the simulation's parameters."""
    own = masked(cells, mask_type) if mask_type else cells
    stats = own.groupBy("sim_name", "res_type").agg(F.max("value").alias("v_max"), F.min("value").alias("v_min"), F.avg("value").alias("v_mean"), F.stddev_pop("value").alias("v_std"))
    return stats.join(sims, "sim_name", "left") if sims is not None else stats


def field_stats_thresholded(cells: DataFrame, least: float) -> DataFrame:
    """Maximum over all cells; minimum, mean and population deviation over cells >= least; all 0 where there are none."""
    v = F.when(F.col("value") >= least, F.col("value"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return cells.groupBy("sim_name", "res_type").agg(zero(F.max("value")).alias("v_max"), zero(F.min(v)).alias("v_min"), zero(F.avg(v)).alias("v_mean"), zero(F.stddev_pop(v)).alias("v_std"))


def time_step_max(cells: DataFrame, types: list[str]) -> DataFrame:
    """Per simulation and time step the maximum of each type, one column for each."""
    return cells.groupBy("sim_name", "t").pivot("res_type", types).max("value")


def peak_over_time(cells: DataFrame) -> DataFrame:
    """Per cell the maximum over all time steps."""
    return cells.groupBy("sim_name", "res_type", "r", "c").agg(F.max("value").alias("value"))


def area_confusion(reference: DataFrame, sims: DataFrame, limit_ref: float, limit_sim: float, cell_area: float | Column = 1.0, keys: tuple[str, ...] = ("sim_name",)) -> DataFrame:
    """Per simulation TP, FP, FN (cells) and their areas against a reference raster r, c, value (all above limits).

    FP is reference not affected, simulation affected.  The reference is joined to the cells that are affected only.
    """
    area = cell_area if isinstance(cell_area, Column) else F.lit(float(cell_area))
    ref = reference.where(above(F.col("value"), limit_ref)).select("r", "c").distinct()
    hit = sims.where(above(F.col("value"), limit_sim)).withColumn("cell_area", area)
    n_ref = reference.where(above(F.col("value"), limit_ref)).withColumn("cell_area", area).agg(F.count("*").alias("n_ref"), F.coalesce(F.sum("cell_area"), F.lit(0.0)).alias("a_ref"))
    both = hit.join(ref.withColumn("in_ref", F.lit(True)), ["r", "c"], "left")
    names = sims.select(*keys).distinct()
    got = both.groupBy(*keys).agg(F.count("in_ref").alias("tp"), F.count_if(F.col("in_ref").isNull()).alias("fp"), F.sum(F.when(F.col("in_ref"), F.col("cell_area"))).alias("a_tp"), F.sum(F.when(F.col("in_ref").isNull(), F.col("cell_area"))).alias("a_fp"))
    all_ = names.join(got, list(keys), "left").fillna(0).join(F.broadcast(n_ref))  # one row
    return all_.select(*keys, "tp", "fp", (F.col("n_ref") - F.col("tp")).alias("fn"), "a_tp", "a_fp", (F.col("a_ref") - F.col("a_tp")).alias("a_fn"))


def area_confusion_within(reference: DataFrame, sims: DataFrame, grid: DataFrame, limit_ref: float, limit_sim: float, keys: tuple[str, ...] = ("sim_name",), on: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """Per simulation TP, FP, FN, TN and their areas over the cells of grid (on, cell_area); cells outside it do not count.

    grid is the area that is analysed: a crop of the raster, or the nodes of the path grid (on = path_id, i_s, i_l) from the
    start of the runout area on.  FP is reference not affected, simulation affected; what is in grid and affected in neither
    is TN, also where a raster has no cell.  Only affected cells are joined; TN follows from the totals of grid.
    """
    area = grid.groupBy(*on).agg(F.max("cell_area").alias("cell_area"))
    ref = reference.where(above(F.col("value"), limit_ref)).select(*on).distinct().withColumn("in_ref", F.lit(True))
    hit = sims.where(above(F.col("value"), limit_sim)).select(*keys, *on).distinct().join(area, list(on)).join(ref, list(on), "left")
    part = lambda c, n: (F.count_if(c).alias(n), F.coalesce(F.sum(F.when(c, F.col("cell_area"))), F.lit(0.0)).alias(f"a_{n}"))
    in_ref = F.coalesce("in_ref", F.lit(False))
    got = hit.groupBy(*keys).agg(*part(in_ref, "tp"), *part(~in_ref, "fp"))
    known = area.join(ref, list(on), "left")
    total = known.agg(*part(in_ref, "ref"), *part(F.lit(True), "all"))
    full = sims.select(*keys).distinct().join(got, list(keys), "left").fillna(0).join(F.broadcast(total))  # one row
    fn, tn = (lambda p: F.col(f"{p}ref") - F.col(f"{p}tp")), (lambda p: F.col(f"{p}all") - F.col(f"{p}ref") - F.col(f"{p}fp"))
    return full.select(*keys, "tp", "fp", fn("").alias("fn"), tn("").alias("tn"), "a_tp", "a_fp", fn("a_").alias("a_fn"), tn("a_").alias("a_tn"))


def differences(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """keys, diff = a - b where at least one value is not 0; a missing value counts as 0."""
    both = a.select(*keys, F.col("value").alias("va")).join(b.select(*keys, F.col("value").alias("vb")), list(keys), "full_outer")
    va, vb = F.coalesce("va", F.lit(0.0)), F.coalesce("vb", F.lit(0.0))
    return both.where((va != 0) | (vb != 0)).select(*keys, (va - vb).alias("diff"))


def difference_stats(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """Maximum, mean and minimum of a - b over cells that are not 0 in both."""
    return differences(a, b, keys).agg(F.max("diff").alias("d_max"), F.avg("diff").alias("d_mean"), F.min("diff").alias("d_min"))


def difference_cdf(a: DataFrame, b: DataFrame, centiles: tuple[float, ...] = (0.95, 0.99), bins: int = 20, keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """Histogram of |a - b| with cumulative shares: bin, lower, n, share; and the values at the centiles on each row."""
    d = differences(a, b, keys).select(F.abs("diff").alias("d"))
    top = d.agg(F.max("d").alias("top")).join(percentiles(d, "d", {f"p{round(p * 100)}": p for p in centiles}, []), how="left")  # one row
    binned = d.join(F.broadcast(top)).withColumn("bin", F.when(F.col("top") > 0, F.least(F.floor(F.col("d") / F.col("top") * bins), F.lit(bins - 1))).otherwise(0))
    counts = binned.groupBy("bin", *top.columns).agg(F.count("*").alias("n"))
    order = Window.orderBy("bin")  # `bins` rows at most
    return counts.select("bin", (F.col("bin") * F.col("top") / bins).alias("lower"), "n", (F.sum("n").over(order) / F.sum("n").over(Window.partitionBy())).alias("share"), *top.columns[1:])


def error_norms(pairs: DataFrame, keys: tuple[str, ...], cell: float = 1.0, cos: float = 1.0) -> DataFrame:
    """Per key L2, relative L2, maximum and relative maximum error of column a (reference) against b.

    L2 = sqrt(cell^2 / cos * sum (a-b)^2); relative to the norm of the reference, or absolute where that is 0.
    """
    w = cell * cell / cos
    sums = pairs.groupBy(*keys).agg(F.sqrt(w * F.sum((F.col("a") - F.col("b")) ** 2)).alias("l2"), F.sqrt(w * F.sum(F.col("a") ** 2)).alias("size"), F.max(F.abs(F.col("a") - F.col("b"))).alias("l_max"), F.max(F.abs("a")).alias("top"))
    relative = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(F.col(x))
    return sums.select(*keys, "l2", relative("l2", "size").alias("l2_rel"), "l_max", relative("l_max", "top").alias("l_max_rel"))


def data_extent(cells: DataFrame, nrows: int, ncols: int, buffer: int = 0, keys: tuple[str, ...] = ("sim_name",)) -> DataFrame:
    """Per key the bounding box of cells > 0 with a buffer, clipped to the grid."""
    box = cells.where(F.col("value") > 0).groupBy(*keys).agg(*[f(x).alias(f"{x}_{n}") for x in ("r", "c") for n, f in (("min", F.min), ("max", F.max))])
    clip = lambda x, sign, last: F.greatest(F.lit(0), F.least(F.lit(last), F.col(x) + sign * buffer))
    return box.select(*keys, clip("r_min", -1, nrows - 1).alias("r_min"), clip("r_max", 1, nrows - 1).alias("r_max"), clip("c_min", -1, ncols - 1).alias("c_min"), clip("c_max", 1, ncols - 1).alias("c_max"))


def histogram_ecdf(rows: DataFrame, column: str, bins: int, by: str) -> DataFrame:
    """Per group: bin of a histogram between the overall ends, its count, and the empirical distribution up to it."""
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = rows.where(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(by, b.alias("bin")).agg(F.count("*").alias("n"))
    own = Window.partitionBy(by)
    return counts.select(by, "bin", "n", (F.sum("n").over(own.orderBy("bin")) / F.sum("n").over(own)).alias("ecdf"))


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def runout_ensemble_stats(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Per group and quantity: count, mean, sample deviation, minimum, quartiles, maximum."""
    long = rows.unpivot(by, columns, "quantity", "v")
    told = long.groupBy(*by, "quantity").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("v_min"), F.max("v").alias("v_max"))
    return told.join(percentiles(long, "v", QUARTILES, [*by, "quantity"]), [*by, "quantity"], "left")


def cross_max_stats(cross: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Per type, path and section: number of simulations, mean, median and two percentiles of their cross maxima."""
    q = lambda p: F.percentile("v_max", F.lit(p))
    return cross.groupBy("res_type", "path_id", "i_s").agg(F.count("v_max").alias("n"), F.avg("v_max").alias("mean"), q(0.5).alias("median"), q(low).alias("low"), q(high).alias("high"))


def event_angle_stats(events: DataFrame, angle: str, category: str, width: float) -> DataFrame:
    """Per category and class of angles (width degrees) the count; with the category's mean and quartiles on each row."""
    own = Window.partitionBy(category)
    box = events.groupBy(category).agg(F.avg(angle).alias("mean")).join(percentiles(events, angle, QUARTILES, [category]), category, "left")
    counts = events.groupBy(category, F.floor(F.col(angle) / width).alias("bin")).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(own))
    return counts.join(box, category)


def mosaic_rasters(rasters: DataFrame, cells: DataFrame, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Cells of many rasters (raster_id, xll, yll, cellsize) on one world grid: X, Y, max, min, mean, sum, count.

    The world index of a cell is a whole number from the lower left centre.  Rasters of several cell sizes are an error.
    """
    sizes = rasters.agg(F.min("cellsize").alias("_low"), F.max("cellsize").alias("_high"))  # one row
    one = F.when(F.col("_low") == F.col("_high"), F.col("cellsize")).otherwise(F.raise_error(F.lit("rasters of one cell size are required")).cast("double"))
    rasters = rasters.join(F.broadcast(sizes)).withColumn("cellsize", one).drop("_low", "_high")
    world = lambda ll, i, o: F.round((F.col(ll) - o) / F.col("cellsize")).cast("long") + F.col(i)
    on = cells.join(rasters, "raster_id").where("value is not null").select(world("xll", "c", x0).alias("X"), world("yll", "r", y0).alias("Y"), "value")
    return on.groupBy("X", "Y").agg(F.max("value").alias("v_max"), F.min("value").alias("v_min"), F.avg("value").alias("v_mean"), F.sum("value").alias("v_sum"), F.count("*").alias("n"))


def merge_tiles(tiles: DataFrame, how: str) -> DataFrame:
    """Overlapping tile cells (gr, gc: global place, value) as one grid: max, sum, or min of the values >= 0 (else the maximum)."""
    v = F.col("value")
    rule = {"max": F.max(v), "sum": F.sum(v), "min": F.coalesce(F.min(F.when(v >= 0, v)), F.max(v))}[how]
    return tiles.groupBy("gr", "gc").agg(rule.alias("value"))


def compare_report(reference: DataFrame, sims: DataFrame, columns: list[str], tolerance: float) -> DataFrame:
    """Per simulation and characteristic: values of reference and simulation, relative difference, whether beyond tolerance.

    Both 0: difference 0.  Only the reference 0 or missing: undefined (null) and flagged.
    """
    ref = reference.unpivot([], columns, "characteristic", "ref")
    own = sims.unpivot(["sim_name"], columns, "characteristic", "sim")
    both = own.join(F.broadcast(ref), "characteristic", "left")  # a row for each characteristic
    rel = F.when((F.col("ref") == 0) & (F.col("sim") == 0), 0.0).when(F.col("ref") != 0, (F.col("ref") - F.col("sim")) / F.col("ref"))
    return both.select("sim_name", "characteristic", "ref", "sim", rel.alias("relative")).withColumn("differs", F.coalesce(F.abs("relative") > tolerance, F.lit(True)))
