"""Lines and polygons as vertices (feature_id, seq, x, y) joined to cells and points by blocks of the plane."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowgrid.sources.shared import kept

BLOCK = 8.0  # side of the blocks on which points and bounding boxes meet


def polygon_area(vertices: DataFrame) -> DataFrame:
    """feature_id, signed_area (counter-clockwise positive), area, by the shoelace formula."""
    w = Window.partitionBy("feature_id").orderBy("seq")
    own = Window.partitionBy("feature_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(own)) for c in ("x", "y"))
    twice = vertices.withColumn("k", F.col("x") * ny - nx * F.col("y")).groupBy("feature_id").agg((F.sum("k") / 2).alias("signed_area"))
    return twice.withColumn("area", F.abs("signed_area"))


def outlines(vertices: DataFrame) -> DataFrame:
    """feature_id, edge (array of x1, y1, x2, y2, closed), x_min, x_max, y_min, y_max: one row for each feature."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    own = vertices.groupBy("feature_id").agg(ring.alias("ring"), *[f(x).alias(f"{x}_{n}") for x in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])
    edge = F.transform("ring", lambda v, i: F.struct(v["x"].alias("x1"), v["y"].alias("y1"), F.get("ring", (i + 1) % F.size("ring"))["x"].alias("x2"), F.get("ring", (i + 1) % F.size("ring"))["y"].alias("y2")))
    return own.withColumn("edge", edge).drop("ring")


def inside(x: Column, y: Column, edge: Column) -> Column:
    """Whether a point is inside a closed outline: an odd number of edges cross the ray to the east."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(edge, crosses)) % 2 == 1


def edge_distance(x: Column, y: Column, edge: Column) -> Column:
    """Distance of a point to the nearest edge."""
    def one(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        long = dx * dx + dy * dy
        t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / long))).otherwise(0.0)
        return F.sqrt((x - e["x1"] - t * dx) ** 2 + (y - e["y1"] - t * dy) ** 2)

    return F.array_min(F.transform(edge, one))


def on_blocks(shapes: DataFrame, radius: float) -> DataFrame:
    """Shapes listed under every block that their bounding box, widened by radius, meets."""
    span = lambda x: F.explode(F.sequence(F.floor((F.col(f"{x}_min") - radius) / BLOCK), F.floor((F.col(f"{x}_max") + radius) / BLOCK)))
    return shapes.withColumn("bx", span("x")).withColumn("by", span("y"))


def shapes_at(places: DataFrame, shapes: DataFrame, radius: float = 0.0) -> DataFrame:
    """places (x, y) with feature_id for each outline that holds the place, or is within radius.

    Places and bounding boxes meet on blocks; the exact test follows.
    """
    near = places.withColumn("bx", F.floor(F.col("x") / BLOCK)).withColumn("by", F.floor(F.col("y") / BLOCK)).join(on_blocks(shapes, radius), ["bx", "by"])
    x, y = F.col("x"), F.col("y")
    box = (x >= F.col("x_min") - radius) & (x <= F.col("x_max") + radius) & (y >= F.col("y_min") - radius) & (y <= F.col("y_max") + radius)
    hit = inside(x, y, F.col("edge")) | ((edge_distance(x, y, F.col("edge")) <= radius) if radius > 0 else F.lit(False))
    return near.where(box).where(hit).select("x", "y", "feature_id")


def point_in_polygon(points: DataFrame, vertices: DataFrame, radius: float = 0.0) -> DataFrame:
    """points with feature_id for each polygon that holds the point, or whose outline is within radius.

    Each place that points have is tested once, with one polygon of each outline; then places are put in for their points
    and outlines for their polygons, by joins whose rows are the result's.
    """
    every = outlines(vertices).withColumn("_one", F.min("feature_id").over(Window.partitionBy("edge")))
    hits = shapes_at(points.select("x", "y").distinct(), every.where(F.col("feature_id") == F.col("_one")), radius)
    each = hits.withColumnRenamed("feature_id", "_one").join(every.select("_one", "feature_id"), "_one").select("x", "y", "feature_id")
    return points.join(each, ["x", "y"]).select(*points.columns, "feature_id")


def particles_in_release(particles: DataFrame, vertices: DataFrame, radius: float = 0.0) -> DataFrame:
    """Particles with mass that lie in any release polygon.  Each place that particles have is tested once, with each outline once."""
    own = particles.where("m > 0")
    hits = shapes_at(own.select("x", "y").distinct(), outlines(vertices).dropDuplicates(["edge"]), radius).select("x", "y").distinct()
    return own.join(hits, ["x", "y"], "left_semi").select(*particles.columns).distinct()


def rasterize_polygon(vertices: DataFrame, features: DataFrame, nrows: int, ncols: int, average: bool = False, radius: float = 0.0) -> DataFrame:
    """r, c, value, n: thickness (1 where missing) of the polygons over each cell centre, and how many there are.

    Where polygons overlap, n > 1 marks an error for the caller; with average they are combined in order as (a + b) / 2.
    """
    cells = outlines(vertices).join(features.select("feature_id", "thickness", "ord"), "feature_id")
    span = lambda x, n: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil(F.col(f"{x}_min") - radius)).cast("int"), F.least(F.lit(n - 1), F.floor(F.col(f"{x}_max") + radius)).cast("int")))
    fits = cells.where((F.col("x_min") - radius <= ncols - 1) & (F.col("y_min") - radius <= nrows - 1) & (F.ceil(F.col("x_min") - radius) <= F.floor(F.col("x_max") + radius)) & (F.ceil(F.col("y_min") - radius) <= F.floor(F.col("y_max") + radius)))
    each = fits.withColumn("r", span("y", nrows)).withColumn("c", span("x", ncols)).where(inside(F.col("c").cast("double"), F.col("r").cast("double"), F.col("edge")))
    rows = each.select("r", "c", "ord", F.coalesce("thickness", F.lit(1.0)).alias("v")).groupBy("r", "c").agg(F.array_sort(F.collect_list(F.struct("ord", "v"))).alias("all"))
    fold = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0))["v"], lambda a, b: (a + b["v"]) / 2 if average else F.greatest(a, b["v"]))
    return rows.select("r", "c", fold.alias("value"), F.size("all").alias("n"))


def crop_overlap(cells: DataFrame, other: DataFrame) -> DataFrame:
    """cells with 0 where another layer is also above 0."""
    mark = other.where("value > 0").select("r", "c").distinct().withColumn("_hit", F.lit(True))
    return cells.join(mark, ["r", "c"], "left").withColumn("value", F.when(F.col("_hit"), 0.0).otherwise(F.col("value"))).drop("_hit")


def segments(vertices: DataFrame, key: str = "feature_id", order: str = "seq") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return vertices.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where("x2 is not null").withColumnsRenamed({"x": "x1", "y": "y1"})


def dilated(cells: DataFrame, nrows: int, ncols: int, rings: int = 1, keys: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    """keys, r, c of the cells of a set and of their 8 neighbours within the grid, and so on for each further ring.

    Rows are widened before columns, with repeats left out in between, so a cell is sent 2 * rings + 1 times at each of two
    exchanges and not (2 * rings + 1)^2 times at one.
    """
    for name, n in (("r", nrows), ("c", ncols)):
        around = F.explode(F.sequence(F.greatest(F.col(name) - rings, F.lit(0)), F.least(F.col(name) + rings, F.lit(n - 1))))
        cells = cells.select(*keys, *[(around if x == name else F.col(x)).alias(x) for x in ("r", "c")]).distinct()
    return cells


def rasterize_line(vertices: DataFrame, nrows: int, ncols: int, distance: float | None = None, key: str = "feature_id", order: str = "seq", rings: int = 0) -> DataFrame:
    """key, r, c of the cells that a line crosses, or whose centre is within distance of it; with rings also their neighbours.

    Crossed cells come from the parameters at which each segment meets a cell border; between two of them it is in one cell.
    A line through a corner of cells does not touch those beside it.
    """
    if rings:
        return dilated(rasterize_line(vertices, nrows, ncols, distance, key, order), nrows, ncols, rings, (key,))
    seg = segments(vertices, key, order)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    if distance is not None:
        span = lambda a, b, n: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil(F.least(a, b) - distance)).cast("int"), F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.greatest(a, b) + distance)).cast("int"))))
        each = seg.withColumn("r", span("y1", "y2", nrows)).withColumn("c", span("x1", "x2", ncols))
        edge = F.array(F.struct("x1", "y1", "x2", "y2"))
        return each.where(edge_distance(F.col("c").cast("double"), F.col("r").cast("double"), edge) <= distance).select(key, "r", "c").distinct()
    borders = lambda a, b, d: F.when(d == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.floor(F.least(a, b) + 0.5), F.floor(F.greatest(a, b) + 0.5)), lambda k: (k + 0.5 - F.col(a)) / d))
    ts = F.array_sort(F.filter(F.concat(F.array(F.lit(0.0), F.lit(1.0)), borders("x1", "x2", dx), borders("y1", "y2", dy)), lambda t: (t >= 0) & (t <= 1)))
    mid = seg.withColumn("ts", ts).select(key, "x1", "y1", dx.alias("dx"), dy.alias("dy"), F.explode(F.filter(F.zip_with(F.slice("ts", 1, F.size("ts") - 1), F.slice("ts", 2, F.size("ts")), lambda a, b: F.when((b - a > 1e-12) | (dx == 0) & (dy == 0), (a + b) / 2)), lambda t: t.isNotNull())).alias("t"))
    at = lambda o, d: F.floor(F.col(o) + F.col("t") * F.col(d) + 0.5).cast("int")
    return mid.select(key, at("y1", "dy").alias("r"), at("x1", "dx").alias("c")).where((F.col("r") >= 0) & (F.col("r") < nrows) & (F.col("c") >= 0) & (F.col("c") < ncols)).distinct()


SHORT = 64  # vertices of a path that all its points meet, as one array


def snap_points_to_line(points: DataFrame, line: DataFrame, on: str = "path_id", block: float = BLOCK) -> DataFrame:
    """points with i and distance of the nearest vertex of their path; the lowest index of equal ones.

    Only paths that have points are kept.  The vertices of a short path (SHORT and fewer) go to its points as one array, so
    that each point is read once and nothing of it is written.  Points of longer paths meet the vertices that lie in their
    block of the plane or the eight around it; one no further than a block's side is certain.  Those without one go on with
    blocks of twice the side until none is left, so that near points never meet the rest of a long path.  Each of these
    rounds is written.  Points whose path has no vertex are left out, those without a place get nulls.
    """
    finite = lambda *names: reduce(lambda a, b: a & b, [F.abs(n) < math.inf for n in names])
    used = line.select(on, "i", F.col("x").alias("lx"), F.col("y").alias("ly")).where(finite("lx", "ly")).join(points.select(on).distinct(), on, "left_semi")
    vertices = kept(used.select(on, "i", "lx", "ly"), "vertices")
    sizes = vertices.groupBy(on).agg(F.count("*").alias("_n"))
    distance = lambda x, y: F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2)
    arrays = vertices.join(sizes.where(F.col("_n") <= SHORT), on, "left_semi").groupBy(on).agg(F.collect_list(F.struct("i", "lx", "ly")).alias("_v"))
    nearest = F.array_min(F.transform("_v", lambda v: F.struct(distance(v["lx"], v["ly"]).alias("distance"), v["i"].alias("i"))))
    out = points.join(arrays, on).withColumn("k", F.when(finite("x", "y"), nearest)).select(*points.columns, "k.i", "k.distance")
    long = kept(sizes.where(F.col("_n") > SHORT).select(on), "long")
    if long.isEmpty():
        return out
    nodes = vertices.join(long, on, "left_semi")
    placed = kept(points.join(long, on, "left_semi").select(*points.columns, F.monotonically_increasing_id().alias("_p")), "points")
    left, found = placed.where(finite("x", "y")).select("_p", on, "x", "y"), []
    d = distance(F.col("lx"), F.col("ly"))
    at = lambda name: F.floor(F.col(name) / block)
    while not left.isEmpty():
        around = lambda name: F.explode(F.sequence(at(name) - 1, at(name) + 1))
        near = left.withColumn("bx", around("x")).withColumn("by", around("y")).join(nodes.withColumn("bx", at("lx")).withColumn("by", at("ly")), [on, "bx", "by"]).where(d <= block)
        found.append(kept(near.groupBy("_p").agg(F.min(F.struct(d.alias("distance"), "i")).alias("k")), "nearest"))
        left = kept(left.join(found[-1], "_p", "left_anti"), "left")
        block *= 2
    if not found:
        return out.unionByName(placed.select(*points.columns, F.lit(None).cast(line.schema["i"].dataType).alias("i"), F.lit(None).cast("double").alias("distance")))
    return out.unionByName(placed.join(reduce(DataFrame.union, found), "_p", "left").select(*points.columns, "k.i", "k.distance"))


def release_stats(raster: DataFrame, surface: DataFrame) -> DataFrame:
    """Per feature z_max, z_mean, z_min, mean slope, projected and actual area; raster(feature_id, r, c), surface(r, c, z, slope, area)."""
    on = raster.join(surface, ["r", "c"])
    return on.groupBy("feature_id").agg(F.max("z").alias("z_max"), F.avg("z").alias("z_mean"), F.min("z").alias("z_min"), F.avg("slope").alias("slope"), F.count("*").cast("double").alias("projected_area"), F.sum("area").alias("actual_area"))


def cells_of(vertices: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """feature_id, r, c of the cell centres in each polygon."""
    own = outlines(vertices)
    span = lambda x, n: F.explode(F.sequence(F.ceil(F.greatest(F.lit(0.0), F.col(f"{x}_min"))).cast("int"), F.floor(F.least(F.lit(float(n - 1)), F.col(f"{x}_max"))).cast("int")))
    fits = own.where((F.ceil(F.greatest(F.lit(0.0), F.col("x_min"))) <= F.floor(F.least(F.lit(ncols - 1.0), F.col("x_max")))) & (F.ceil(F.greatest(F.lit(0.0), F.col("y_min"))) <= F.floor(F.least(F.lit(nrows - 1.0), F.col("y_max")))))
    return fits.withColumn("r", span("y", nrows)).withColumn("c", span("x", ncols)).where(inside(F.col("c").cast("double"), F.col("r").cast("double"), F.col("edge"))).select("feature_id", "r", "c")


def release_volume(raster: DataFrame, surface: DataFrame, features: DataFrame) -> DataFrame:
    """Per feature the release volume: thickness (1 where missing) x actual cell area."""
    on = raster.join(surface.select("r", "c", "area"), ["r", "c"]).join(features.select("feature_id", "thickness"), "feature_id")
    return on.groupBy("feature_id").agg(F.sum(F.coalesce("thickness", F.lit(1.0)) * F.col("area")).alias("volume"))


def volume_class(volumes: DataFrame, small: float, medium: float) -> DataFrame:
    """S below `small`, M up to `medium` (included), else L."""
    return volumes.withColumn("size", F.when(F.col("volume") < small, "S").when(F.col("volume") <= medium, "M").otherwise("L"))


def max_release_thickness(features: DataFrame, single: float) -> DataFrame:
    """Per scenario the largest thickness of its features, else the single value."""
    return features.groupBy("scenario").agg(F.coalesce(F.max("thickness"), F.lit(single)).alias("thickness"))


def extents(vertices: DataFrame, buffer: float) -> DataFrame:
    """feature_id and the box of half side `buffer` about its centroid (mean of vertices)."""
    own = vertices.groupBy("feature_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return own.select("feature_id", *[(F.col(f"c{a}") + s * buffer).alias(f"{a}_{n}") for a in ("x", "y") for n, s in (("min", -1), ("max", 1))])


def feature_isolation(vertices: DataFrame, features: DataFrame, buffer: float) -> DataFrame:
    """grp, feature_id of features whose buffered box meets no other of their group; only groups of several.

    Boxes of one size meet only if they share a block of their size or lie in neighbouring ones.
    """
    side = 2 * buffer
    own = extents(vertices, buffer).join(features.where("grp <> ''").select("feature_id", "grp"), "feature_id")
    cell = lambda a: F.floor(F.col(f"{a}_min") / side)
    keyed = own.withColumn("bx", cell("x")).withColumn("by", cell("y"))
    around = keyed.withColumn("bx", F.explode(F.sequence(F.col("bx") - 1, F.col("bx") + 1))).withColumn("by", F.explode(F.sequence(F.col("by") - 1, F.col("by") + 1))).alias("o")
    k = keyed.alias("k")
    meets = (F.col("k.feature_id") != F.col("o.feature_id")) & (F.col("k.x_min") <= F.col("o.x_max")) & (F.col("o.x_min") <= F.col("k.x_max")) & (F.col("k.y_min") <= F.col("o.y_max")) & (F.col("o.y_min") <= F.col("k.y_max"))
    met = k.join(around, (F.col("k.grp") == F.col("o.grp")) & (F.col("k.bx") == F.col("o.bx")) & (F.col("k.by") == F.col("o.by"))).where(meets).select("k.feature_id").distinct()
    several = own.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp")
    return own.join(several, "grp", "left_semi").join(met, "feature_id", "left_anti").select("grp", "feature_id")


def features_in_extent(vertices: DataFrame, boxes: DataFrame) -> DataFrame:
    """name, feature_id and the bounding box of the feature clipped to each box (name, x_min ...) that it meets."""
    own = outlines(vertices).drop("edge")
    b = on_blocks(boxes.select("name", *[F.col(c).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")]), 0.0).select("name", "bx", "by", *[F.col(c).alias(f"b_{c}") for c in ("x_min", "x_max", "y_min", "y_max")])
    met = on_blocks(own, 0.0).join(b, ["bx", "by"]).where("x_min <= b_x_max and b_x_min <= x_max and y_min <= b_y_max and b_y_min <= y_max")
    return met.select("name", "feature_id", F.greatest("x_min", "b_x_min").alias("x_min"), F.least("x_max", "b_x_max").alias("x_max"), F.greatest("y_min", "b_y_min").alias("y_min"), F.least("y_max", "b_y_max").alias("y_max")).distinct()
