"""Path-following (s, l) analysis: the grid about a path, rasters on it, cross sections and runout.

slcells(sim_name, res_type, i_s, i_l, value) are rasters on the grid sl(path_id, i_s, i_l, s, l, x, y, area).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from flowgrid.functions.vectors import above
from flowgrid.sources.shared import kept

from .grids import corner_weights

def own() -> WindowSpec:
    return Window.partitionBy("path_id").orderBy("i")


def path_domain(path: DataFrame, width: float) -> DataFrame:
    """path with the points left and right (xl, yl, xr, yr) at half the width across its direction (central, one-sided at the ends)."""
    dx = F.coalesce(F.lead("x").over(own()), F.col("x")) - F.coalesce(F.lag("x").over(own()), F.col("x"))
    dy = F.coalesce(F.lead("y").over(own()), F.col("y")) - F.coalesce(F.lag("y").over(own()), F.col("y"))
    out = path.withColumn("_dx", dx).withColumn("_dy", dy)
    n = F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2)
    nx, ny = -F.col("_dy") / n * width / 2, F.col("_dx") / n * width / 2
    return out.withColumns({"xl": F.col("x") + nx, "yl": F.col("y") + ny, "xr": F.col("x") - nx, "yr": F.col("y") - ny}).drop("_dx", "_dy")


def sl_grid(path: DataFrame, width: float, step: float) -> DataFrame:
    """path_id, i_s, i_l, s, l, x, y, area: each section in steps of about `step`, across an odd number of points from right to left.

    s is the distance along the middle, l that across; area by the corners of the cell towards the next i_s and i_l
    (shoelace), 0 on the last of either.
    """
    across = int(width / step) // 2 * 2 + 1
    domain = path_domain(path, width)
    for c in ("x", "y", "xl", "yl", "xr", "yr"):
        domain = domain.withColumn(f"_{c}", F.lead(c).over(own()))
    long = F.sqrt((F.col("_x") - F.col("x")) ** 2 + (F.col("_y") - F.col("y")) ** 2)
    n = F.greatest(F.lit(1), F.round(long / step).cast("int"))
    section = domain.withColumn("_n", F.coalesce(n, F.lit(1))).withColumn("_long", F.coalesce(long, F.lit(0.0)))
    section = section.withColumn("_s", F.coalesce(F.sum("_long").over(own().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("_first", F.coalesce(F.sum("_n").over(own().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = section.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    f = F.col("_k") / F.col("_n")
    mid = {c: F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.col(c) + f * (F.col(f"_{c}") - F.col(c))) for c in ("xl", "yl", "xr", "yr")}
    line = each.select("path_id", (F.col("_first") + F.col("_k")).cast("int").alias("i_s"), (F.col("_s") + f * F.col("_long")).alias("s"), *[v.alias(c) for c, v in mid.items()])
    grid = line.withColumn("i_l", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    g = F.col("i_l") / float(across - 1)
    grid = grid.select("path_id", "i_s", "i_l", "s", (-width / 2 + g * width).alias("l"), (F.col("xr") + g * (F.col("xl") - F.col("xr"))).alias("x"), (F.col("yr") + g * (F.col("yl") - F.col("yr"))).alias("y"))
    ws, wl = Window.partitionBy("path_id", "i_l").orderBy("i_s"), Window.partitionBy("path_id", "i_s").orderBy("i_l")
    for c in ("x", "y"):
        grid = grid.withColumn(f"{c}s", F.lead(c).over(ws))
    for c in ("x", "y"):
        grid = grid.withColumn(f"{c}l", F.lead(c).over(wl)).withColumn(f"{c}d", F.lead(f"{c}s").over(wl))
    ring = [("x", "y"), ("xl", "yl"), ("xd", "yd"), ("xs", "ys")]
    terms = [F.col(a) * F.col(d) - F.col(c) * F.col(b) for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True)]
    return grid.withColumn("area", F.coalesce(F.abs(sum(terms[1:], terms[0])) / 2, F.lit(0.0))).drop("xs", "ys", "xl", "yl", "xd", "yd")


def surface_areas(grid: DataFrame, area: DataFrame, nrows: int, ncols: int, cellsize: float = 1.0) -> DataFrame:
    """grid with area on the surface instead of in the plane: times the terrain's cell area (r, c, area) per cellsize^2, bilinear.

    Null where a node has no terrain on all sides.
    """
    node = ["path_id", "i_s", "i_l"]
    near = corner_weights(grid.select(*node, "x", "y"), nrows, ncols).join(area.select("r", "c", F.col("area").alias("_a")), ["r", "c"])
    factor = near.groupBy(*node).agg(F.when(F.count("_a") == 4, F.sum(F.col("w") * F.col("_a")) / cellsize**2).alias("_f"))
    return grid.join(factor, node, "left").withColumn("area", F.col("area") * F.col("_f")).drop("_f")


def transform_to_sl(cells: DataFrame, grid: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """Every raster sampled at the grid's nodes (bilinear): sim_name, res_type, path_id, i_s, i_l, value; null outside.

    The corners of the nodes and their weights are the same for all rasters; cells are joined to them by (r, c), and each
    node of each raster is summed in one exchange.
    """
    keys, node = ["sim_name", "res_type"], ["path_id", "i_s", "i_l"]
    joined = corner_weights(grid, nrows, ncols).select(*node, "r", "c", "w").join(cells.select(*keys, "r", "c", "value"), ["r", "c"])
    parts = joined.where("value is not null").select(*keys, *node, (F.col("w") * F.col("value")).alias("v"))
    every = grid.select(*node).join(cells.select(*keys).distinct()).select(*keys, *node, F.lit(None).cast("double").alias("v"))  # as many as the result has
    return parts.unionByName(every).groupBy(*keys, *node).agg(F.when(F.count("v") == 4, F.sum("v")).alias("value"))


def cross_section_max_mean(slcells: DataFrame, grid: DataFrame) -> DataFrame:
    """Per simulation, type, path and i_s: the largest value, and the area-weighted mean of those above 0 (0 if there are none)."""
    on = slcells.join(grid.select("path_id", "i_s", "i_l", "area"), ["path_id", "i_s", "i_l"])
    return on.groupBy("sim_name", "res_type", "path_id", "i_s").agg(F.max("value").alias("v_max"), positive_mean().alias("v_mean"))


def positive_mean() -> Column:
    """Aggregate: the area-weighted mean of the values above 0, 0 if there are none."""
    w = F.when(above(F.col("value"), 0.0), F.col("area"))
    return F.coalesce(F.sum(w * F.col("value")), F.lit(0.0)) / F.when(F.sum(w) > 0, F.sum(w)).otherwise(1.0)


def runout(slcells: DataFrame, grid: DataFrame, thalweg: DataFrame, limit: float) -> DataFrame:
    """Per simulation, type and path: first and last section with a cross maximum above the limit, and what lies there.

    thalweg: path_id, i_s, s, x, y, z of the middle of each section.  s, z of both ends, l, x, y of the last section's
    maximum, delta_s, delta_z and the runout angle (degrees) between them; s_mean, x_mean, y_mean of the last section whose
    area-weighted mean is above the limit (null if none is).  Found if there is any such section, also if it is the first.
    """
    keys = ["sim_name", "res_type", "path_id"]
    # One pass over the rasters: sections with their maximum, where it lies, and their mean; then sections with their ends.
    on = slcells.join(grid.select("path_id", "i_s", "i_l", "area"), ["path_id", "i_s", "i_l"])
    top = F.max(F.when(F.col("value").isNotNull(), F.struct("value", (-F.col("i_l")).alias("back"))))
    section = on.groupBy(*keys, "i_s").agg(top.alias("top"), positive_mean().alias("v_mean"))
    hit = above(F.col("top.value"), limit)
    ends = section.groupBy(*keys).agg(F.min(F.when(hit, F.col("i_s"))).alias("i_release"), F.max(F.when(hit, F.struct("i_s", F.col("top.back").alias("back")))).alias("k"), F.max(F.when(above(F.col("v_mean"), limit), F.col("i_s"))).alias("i_mean"))
    ends = ends.where("k is not null").select(*keys, "i_release", "i_mean", F.col("k.i_s").alias("i_runout"), (-F.col("k.back")).cast("int").alias("i_l"))
    at = grid.select("path_id", F.col("i_s").alias("i_runout"), "i_l", F.col("s").alias("s_runout"), "l", "x", "y")
    middle = lambda name, *columns: thalweg.select("path_id", F.col("i_s").alias(f"i_{name}"), *[F.col(c).alias(f"{c}_{name}") for c in columns])
    out = ends.join(at, ["path_id", "i_runout", "i_l"]).join(middle("release", "s", "z"), ["path_id", "i_release"]).join(middle("runout", "z"), ["path_id", "i_runout"]).join(middle("mean", "s", "x", "y"), ["path_id", "i_mean"], "left")
    ds, dz = F.col("s_runout") - F.col("s_release"), F.col("z_release") - F.col("z_runout")
    return out.select(*keys, "s_release", "s_runout", "l", "x", "y", "z_release", "z_runout", ds.alias("delta_s"), dz.alias("delta_z"), F.when(ds > 0, F.degrees(F.atan(dz / ds))).alias("runout_angle"), "s_mean", "x_mean", "y_mean")


def runout_line(slcells: DataFrame, grid: DataFrame, limit: float, at_maximum: bool = False) -> DataFrame:
    """Per simulation, type, path and i_l: the furthest i_s above the limit, with its s, l, x, y.

    at_maximum, for features on the grid: the i_s of the largest value other than 0 instead, the furthest of equal ones.
    """
    keys = ["sim_name", "res_type", "path_id", "i_l"]
    hits = slcells.where(F.col("value") != 0) if at_maximum else slcells.where(above(F.col("value"), limit))
    far = F.max(F.struct("value", "i_s"))["i_s"] if at_maximum else F.max("i_s")
    return hits.groupBy(*keys).agg(far.alias("i_s")).join(grid.select("path_id", "i_s", "i_l", "s", "l", "x", "y"), ["path_id", "i_s", "i_l"])


def runout_point(lines: DataFrame) -> DataFrame:
    """Per simulation, type and path: s, l, x, y of the furthest point of a runout line, the first i_l of equal ones."""
    keys = ["sim_name", "res_type", "path_id"]
    return lines.groupBy(*keys).agg(F.max(F.struct("s", -F.col("i_l"), "l", "x", "y")).alias("k")).select(*keys, *[F.col(f"k.{c}").alias(c) for c in ("s", "l", "x", "y")])


def runout_point_diff(points: DataFrame, reference: DataFrame) -> DataFrame:
    """Per simulation and path: the reference's s and l less the simulation's, of runout points."""
    ref = reference.select("path_id", F.col("s").alias("_s"), F.col("l").alias("_l"))
    return points.join(ref, "path_id").select("sim_name", "res_type", "path_id", (F.col("_s") - F.col("s")).alias("diff_s"), (F.col("_l") - F.col("l")).alias("diff_l"))


def runout_line_diff(lines: DataFrame, reference: DataFrame) -> DataFrame:
    """Per simulation: RMSE of s against the reference line where both have a value, and the counts missing on either side."""
    ref = reference.select("path_id", "i_l", F.col("s").alias("s_ref"))
    both = lines.select("sim_name", "path_id", "i_l", "s").join(ref, ["path_id", "i_l"], "left")
    own = both.groupBy("sim_name").agg(F.sqrt(F.avg((F.col("s") - F.col("s_ref")) ** 2)).alias("rmse"), F.count("s_ref").alias("n_both"), F.count_if(F.col("s_ref").isNull()).alias("n_ref_missing"))
    total = ref.agg(F.count("*").alias("_n"))  # one row
    return own.join(F.broadcast(total)).select("sim_name", "rmse", "n_both", (F.col("_n") - F.col("n_both")).alias("n_sim_missing"), "n_ref_missing")


def reference_features_to_sl(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """Nodes of the grid whose nearest cell is in a feature's raster (r, c): path_id, i_s, i_l, value 1, as one more raster."""
    nodes = grid.withColumn("r", F.rint("y").cast("int")).withColumn("c", F.rint("x").cast("int"))
    return nodes.join(cells.select("r", "c").distinct(), ["r", "c"], "left_semi").select("path_id", "i_s", "i_l", F.lit(1.0).alias("value"))


def thalweg_velocity_summary(cross: DataFrame, thalweg: DataFrame, limit: float, bar: int, start_of_runout: int, g: float = 9.81) -> DataFrame:
    """Per simulation and path: first and last s with a cross maximum above the limit, drop and alpha between them; beta, the
    angle (degrees) from the first to the section start_of_runout; largest mean of `bar` sections; largest energy height."""
    on = cross.join(thalweg.select("path_id", "i_s", "s", "z"), ["path_id", "i_s"]).where(above(F.col("v_max"), limit))
    keys = ["sim_name", "path_id"]
    ends = on.groupBy(*keys).agg(F.min_by(F.struct("s", "z"), "i_s").alias("a"), F.max_by(F.struct("s", "z"), "i_s").alias("b"), F.max(F.col("z") + F.col("v_max") ** 2 / (2 * g)).alias("energy_height"))
    bars = on.groupBy(*keys, F.floor(F.col("i_s") / bar).alias("bar")).agg(F.avg("v_max").alias("m")).groupBy(*keys).agg(F.max("m").alias("bar_max"))
    dz, ds = F.col("a.z") - F.col("b.z"), F.col("b.s") - F.col("a.s")
    beta = thalweg.where(F.col("i_s") == start_of_runout).select("path_id", F.col("s").alias("_s"), F.col("z").alias("_z"))
    return ends.join(bars, keys).join(beta, "path_id", "left").select(*keys, F.col("a.s").alias("s_first"), F.col("b.s").alias("s_last"), dz.alias("dz"), ds.alias("ds"), F.degrees(F.atan2(dz, ds)).alias("alpha"), F.degrees(F.atan(F.try_divide(F.col("a.z") - F.col("_z"), F.col("_s") - F.col("a.s")))).alias("beta"), "bar_max", "energy_height")


def fitting_block(nodes: DataFrame, most: float, least: int = 16) -> float | None:
    """The largest side, `most` or up to seven times halved, at which a block that has nodes holds `least` of them or fewer on average; None without nodes."""
    sides = [most / 2**j for j in range(8)]
    blocks = [F.approx_count_distinct(F.xxhash64(F.floor(F.col("gx") / s), F.floor(F.col("gy") / s))).alias(f"b{j}") for j, s in enumerate(sides)]
    told = nodes.agg(F.count("*").alias("n"), *blocks).first()
    return next((s for j, s in enumerate(sides) if told["n"] <= least * told[f"b{j}"]), sides[-1]) if told["n"] else None


def nearest_sl_for_particles(particles: DataFrame, grid: DataFrame, block: float = 2.0) -> DataFrame:
    """particles with path_id, i_s, i_l of the nearest node of the grid; the lowest indices of equal ones; null without a place.

    Squared distances that agree to 9 digits are equal.  Each place that particles have is looked up once, among the places
    that nodes have, so neither is listed as often as it is taken.  Both meet on blocks of the plane, at most `block` wide
    and smaller where nodes are dense: a node is listed under its block and the eight around it, so a nearest node no
    further than a block's side is certain.  Places without one go on with blocks of twice the side until none is left;
    each round is written.
    """
    finite = lambda *names: reduce(lambda a, b: a & b, [F.abs(n) < math.inf for n in names])
    own = grid.where(finite("x", "y")).groupBy(F.col("x").alias("gx"), F.col("y").alias("gy"))
    nodes = kept(own.agg(F.min(F.struct("path_id", "i_s", "i_l")).alias("n")), "nodes")
    block = fitting_block(nodes, block)
    none = [F.lit(None).cast(grid.schema[c].dataType).alias(c) for c in ("path_id", "i_s", "i_l")]
    if block is None:
        return particles.select("*", *none)
    left, found = kept(particles.select("x", "y").where(finite("x", "y")).distinct(), "places"), []
    d = (F.col("x") - F.col("gx")) ** 2 + (F.col("y") - F.col("gy")) ** 2
    around = lambda name: F.explode(F.sequence(F.floor(F.col(name) / block) - 1, F.floor(F.col(name) / block) + 1))
    while not left.isEmpty():
        wide = nodes.withColumn("bx", around("gx")).withColumn("by", around("gy"))
        near = left.withColumn("bx", F.floor(F.col("x") / block)).withColumn("by", F.floor(F.col("y") / block)).join(wide, ["bx", "by"]).where(d <= block**2)
        best = near.groupBy("x", "y").agg(F.min(F.struct(F.round(d, 9).alias("d"), "n")).alias("k"))
        found.append(kept(best.where(F.col("k.d") <= block**2 - 1e-8), "nearest"))  # else an equal one may lie beyond
        left = kept(left.join(found[-1], ["x", "y"], "left_anti"), "left")
        block *= 2
    if not found:
        return particles.select("*", *none)
    return particles.join(reduce(DataFrame.union, found), ["x", "y"], "left").select(*particles.columns, "k.n.*")
