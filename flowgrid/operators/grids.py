"""Rasters as cells (r, c, value; r = 0 is the south): sampling, resampling, stencils, tiles.

Neighbours come from equi-joins on cell keys or from windows along rows and columns; nothing is compared all with all.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowgrid.functions.vectors import half_even


def grid_of(cells: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """r, c of every place of a grid, made on the executors."""
    n = cells.sparkSession.range(nrows * ncols)
    return n.select(F.floor(F.col("id") / ncols).cast("int").alias("r"), (F.col("id") % ncols).cast("int").alias("c"))


#: Places of a grid that one row stands for while grids are made for many keys.
PLACES = 1 << 12


def places_of(cells: DataFrame, keys: tuple[str, ...], nrows: int, ncols: int) -> DataFrame:
    """keys, r, c of every place of a grid for each key found in cells, made on the executors in blocks of PLACES."""
    if not keys:
        return grid_of(cells, nrows, ncols)
    n = nrows * ncols
    blocks = cells.select(*keys).distinct().withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // PLACES).cast("long")))).repartition(*keys, "_b")
    first = F.col("_b") * PLACES
    each = blocks.withColumn("_i", F.explode(F.sequence(first, F.least(first + PLACES, F.lit(n)) - 1)))
    return each.select(*keys, F.floor(F.col("_i") / ncols).cast("int").alias("r"), (F.col("_i") % ncols).cast("int").alias("c"))


def between(lo: Column, hi: Column, n: int) -> Column:
    """A row for each whole number from lo to hi (both a little widened) that is a row or column of n."""
    first, last = F.greatest(F.lit(0), F.ceil(lo - 1e-6)).cast("int"), F.least(F.lit(n - 1), F.floor(hi + 1e-6)).cast("int")
    return F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))


def bilinear_onto(cells: DataFrame, shape: tuple[int, int], to: tuple[int, int], rows: tuple[Column, Column], columns: tuple[Column, Column], at: tuple[Column, Column], keys: tuple[str, ...]) -> DataFrame:
    """keys, r, c, value of a whole grid `to`, bilinear between cells of a grid `shape`; null where a corner is missing or outside.

    Each cell goes to the new places about it: rows and columns bound them, at = (row, column) says where place (_r, _c) lies
    in the old grid.  Shares are summed before the one exchange that carries values; places come in blocks.
    """
    near = cells.where("value is not null").select(*keys, "r", "c", "value").withColumn("_r", between(*rows, to[0])).withColumn("_c", between(*columns, to[1]))
    ly, lx = at
    dr, dc, fy, fx = F.col("r") - F.floor(ly), F.col("c") - F.floor(lx), ly - F.floor(ly), lx - F.floor(lx)
    inside = (lx >= 0) & (lx < shape[1] - 1) & (ly >= 0) & (ly < shape[0] - 1) & dr.isin(0, 1) & dc.isin(0, 1)
    # A share for each corner, added in one order, so that the sum is the same in every run.
    share = {(i, j): F.sum(F.when((dr == i) & (dc == j), (fy if i else 1 - fy) * (fx if j else 1 - fx) * F.col("value"))) for i in (0, 1) for j in (0, 1)}
    sums = near.where(inside).groupBy(*keys, F.col("_r").alias("r"), F.col("_c").alias("c")).agg(reduce(lambda a, b: a + b, share.values()).alias("value"))
    return places_of(cells, keys, *to).join(sums, [*keys, "r", "c"], "left").select(*keys, "r", "c", "value")


def corner_weights(points: DataFrame, nrows: int, ncols: int, xll: float = 0.0, yll: float = 0.0, cellsize: float = 1.0) -> DataFrame:
    """points with r, c, w of the four cells about each, by bilinear weights; points outside the grid are left out."""
    lx, ly = (F.col("x") - xll) / cellsize, (F.col("y") - yll) / cellsize
    fx, fy = lx - F.floor(lx), ly - F.floor(ly)
    corner = lambda i, j: F.struct((F.floor(ly) + i).cast("int").alias("r"), (F.floor(lx) + j).cast("int").alias("c"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w"))
    inside = (lx >= 0) & (lx < ncols - 1) & (ly >= 0) & (ly < nrows - 1)
    return points.where(inside).withColumn("_q", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)]))).select(*points.columns, "_q.*")


def sample_raster_at_points(points: DataFrame, cells: DataFrame, nrows: int, ncols: int, xll: float = 0.0, yll: float = 0.0, cellsize: float = 1.0, method: str = "bilinear", keys: tuple[str, ...] = ()) -> DataFrame:
    """points with `value`: the raster's value there, null outside.

    bilinear: inside iff 0 <= L < n - 1 for the place L in cells from the lower left centre, and all four corners are
    present.  nearest: -0.5 < L < n - 0.5, halves to the even cell.  keys: further columns (such as sim_name) that both
    sides share; without them each point is sampled once.  The corners of a point are joined by cell key.
    """
    lx, ly = (F.col("x") - xll) / cellsize, (F.col("y") - yll) / cellsize
    names = points.columns
    if method == "nearest":
        inside = (lx > -0.5) & (lx < ncols - 0.5) & (ly > -0.5) & (ly < nrows - 0.5)
        at = points.withColumn("r", F.when(inside, half_even(ly).cast("int"))).withColumn("c", F.when(inside, half_even(lx).cast("int")))
        return at.join(cells.select(*keys, "r", "c", "value"), [*keys, "r", "c"], "left").select(*names, "value")
    inside = (lx >= 0) & (lx < ncols - 1) & (ly >= 0) & (ly < nrows - 1)
    fx, fy = lx - F.floor(lx), ly - F.floor(ly)
    corner = lambda i, j: F.struct((F.floor(ly) + i).cast("int").alias("r"), (F.floor(lx) + j).cast("int").alias("c"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w"))
    four = points.withColumn("_p", F.monotonically_increasing_id()).withColumn("_k", F.when(inside, F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])))
    corners = four.select("*", F.explode_outer("_k").alias("_q")).select(*names, "_p", "_q.*")
    got = corners.join(cells.select(*keys, "r", "c", "value"), [*keys, "r", "c"], "left")
    whole = F.when(F.count("value") == 4, F.sum(F.col("w") * F.col("value")))
    return got.groupBy("_p", *names).agg(whole.alias("value")).drop("_p")


def resample_to_reference(cells: DataFrame, own: tuple[int, int, float, float, float], reference: tuple[int, int, float, float, float], keys: tuple[str, ...] = ("sim_name",)) -> DataFrame:
    """Cells on the grid of another header (nrows, ncols, xll, yll, cellsize), bilinear; unchanged if the headers are equal."""
    if own == reference:
        return cells
    nrows, ncols, xll, yll, size = reference
    ratio, x0, y0 = own[4] / size, (own[2] - xll) / size, (own[3] - yll) / size
    about = lambda c, o: (o + (F.col(c) - 1) * ratio, o + (F.col(c) + 1) * ratio)
    at = ((yll + F.col("_r") * size - own[3]) / own[4], (xll + F.col("_c") * size - own[2]) / own[4])
    return bilinear_onto(cells, own[:2], (nrows, ncols), about("r", y0), about("c", x0), at, keys)


def cubic_weight(d: Column) -> Column:
    """Cubic convolution weight (a = -1/2) of a distance in cells."""
    d = F.abs(d)
    return F.when(d <= 1, 1.5 * d**3 - 2.5 * d**2 + 1).when(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2).otherwise(0.0)


def remeshed_shape(nrows: int, ncols: int, cellsize: float, new_cellsize: float, larger: bool = False) -> tuple[int, int]:
    """Rows and columns of a grid of another cell size over the same lower left centre; with larger one more of both if columns would end short."""
    n_r, n_c = int((nrows - 1) * cellsize / new_cellsize) + 1, int((ncols - 1) * cellsize / new_cellsize) + 1
    more = int(larger and (n_c - 1) * new_cellsize < (ncols - 1) * cellsize)
    return n_r + more, n_c + more


def remesh(cells: DataFrame, nrows: int, ncols: int, cellsize: float, new_cellsize: float, keys: tuple[str, ...] = (), larger: bool = False) -> DataFrame:
    """Cells of a new size over the same lower left centre, cubic; the grid's size is truncated, or with larger covers the old one.

    Each cell adds to the new nodes within two cells of it; a node without all its 16 neighbours (at edges or gaps) takes
    the weighted mean of those it has, and none if they weigh under one half.
    """
    ratio = new_cellsize / cellsize
    n_r, n_c = remeshed_shape(nrows, ncols, cellsize, new_cellsize, larger)
    first = lambda c: F.greatest(F.lit(0), F.ceil((F.col(c) - 2) / ratio))
    last = lambda c, n: F.least(F.lit(n - 1), F.floor((F.col(c) + 2) / ratio))
    span = lambda c, n: F.explode(F.when(last(c, n) >= first(c), F.sequence(first(c), last(c, n))).otherwise(F.array().cast("array<bigint>")))
    near = cells.where("value is not null").withColumn("_r", span("r", n_r)).withColumn("_c", span("c", n_c))
    w = cubic_weight(F.col("_r") * ratio - F.col("r")) * cubic_weight(F.col("_c") * ratio - F.col("c"))
    sums = near.withColumn("w", w).groupBy(*keys, "_r", "_c").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("value")).alias("wv"))
    return sums.where("w >= 0.5").select(*keys, F.col("_r").cast("int").alias("r"), F.col("_c").cast("int").alias("c"), (F.col("wv") / F.col("w")).alias("value"))


def rotate_raster(cells: DataFrame, nrows: int, ncols: int, degrees: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """The raster turned counter-clockwise about the lower left centre, sampled bilinearly on its own grid."""
    a = math.radians(degrees)
    return turned(cells, nrows, ncols, F.lit(math.cos(a)), F.lit(math.sin(a)), keys)


def turned(cells: DataFrame, nrows: int, ncols: int, cos: Column, sin: Column, keys: tuple[str, ...]) -> DataFrame:
    """bilinear_onto the same grid turned by an angle, which may differ from row to row (columns _cos and _sin, the same for a key)."""
    reach = F.abs(cos) + F.abs(sin)
    row, column = F.col("c") * sin + F.col("r") * cos, F.col("c") * cos - F.col("r") * sin
    at = (-F.col("_c") * sin + F.col("_r") * cos, F.col("_c") * cos + F.col("_r") * sin)
    return bilinear_onto(cells, (nrows, ncols), (nrows, ncols), (row - reach, row + reach), (column - reach, column + reach), at, keys)


def surface_normals(dem: DataFrame, cellsize: float = 1.0) -> DataFrame:
    """r, c, z, nx, ny, nz, area, slope of each cell: unit normal by central differences (one-sided at edges).

    area is the cell's area on the surface, cellsize^2 / nz; slope in degrees.  Windows run along one row or one column.
    """
    def slope_along(by: str, along: str) -> Column:
        w = Window.partitionBy(by).orderBy(along)
        back, ahead = F.lag("z").over(w), F.lead("z").over(w)
        span = F.when(back.isNull() | ahead.isNull(), 1.0).otherwise(2.0)
        return F.coalesce((F.coalesce(ahead, F.col("z")) - F.coalesce(back, F.col("z"))) / (span * cellsize), F.lit(0.0))

    d = dem.select("r", "c", "z").withColumn("dx", slope_along("r", "c")).withColumn("dy", slope_along("c", "r"))
    n = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + 1)
    return d.select("r", "c", "z", (-F.col("dx") / n).alias("nx"), (-F.col("dy") / n).alias("ny"), (1 / n).alias("nz"), (cellsize * cellsize * n).alias("area"), F.degrees(F.acos(1 / n)).alias("slope"))


#: Neighbours of a cell (dr, dc), counter-clockwise from the east, of the triangles that meet in it.
AROUND = {4: ((0, 1), (1, 0), (0, -1), (-1, 0)), 6: ((0, 1), (1, 1), (1, 0), (0, -1), (-1, -1), (-1, 0)), 8: ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))}


def triangle_normals(dem: DataFrame, cellsize: float = 1.0, triangles: int = 6) -> DataFrame:
    """r, c, z, nx, ny, nz, area, slope of each cell, from the triangles that meet in it.

    triangles: 4, 6 or 8, the normals of those whose corners are all there (at edges and gaps fewer) are added up; or 1, the
    normals of the squares beside a cell, by their diagonals, are added up.  A cell without any stands upright.  Each cell
    is sent to its neighbours, one exchange.  area is the cell's area on the surface, cellsize^2 / nz; slope in degrees.
    """
    z = lambda i, j: F.col("_z")[f"{i},{j}"]
    sent = dem.select("z", F.explode(F.array(*[F.struct((F.col("r") - i).alias("r"), (F.col("c") - j).alias("c"), F.lit(f"{i},{j}").alias("from")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("k"))
    met = sent.where("z is not null").groupBy("k.r", "k.c").agg(F.map_from_entries(F.collect_list(F.struct("k.from", "z"))).alias("_z")).where("_z['0,0'] is not null")  # 9 values at most

    def cross(a: tuple[int, int], b: tuple[int, int], za: Column, zb: Column) -> list[Column]:
        """Normal of the vectors (a, za) and (b, zb) from the cell, in units of the cell size."""
        return [a[0] * zb - b[0] * za, b[1] * za - a[1] * zb, F.when((za + zb).isNotNull(), F.lit(float(a[1] * b[0] - a[0] * b[1]) * cellsize))]

    if triangles == 1:  # diagonals of the square between the cell and the one at (i, j)
        parts = []
        for i, j in ((1, 1), (1, -1), (-1, -1), (-1, 1)):
            low, high, left, right = min(i, 0), max(i, 0), min(j, 0), max(j, 0)
            up, down = z(high, right) - z(low, left), z(high, left) - z(low, right)
            parts.append(cross((1, 1), (1, -1), up, down))
    else:
        ring = AROUND[triangles]
        parts = [cross(a, b, z(*a) - z(0, 0), z(*b) - z(0, 0)) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    total = lambda k: sum((F.coalesce(x[k], F.lit(0.0)) for x in parts[1:]), F.coalesce(parts[0][k], F.lit(0.0)))
    d = met.select("r", "c", F.col("_z")["0,0"].alias("z"), total(0).alias("a"), total(1).alias("b"), total(2).alias("u")).withColumn("u", F.when(F.col("u") > 0, F.col("u")).otherwise(1.0))
    n = F.sqrt(F.col("a") ** 2 + F.col("b") ** 2 + F.col("u") ** 2)
    nz = F.col("u") / n
    return d.select("r", "c", "z", (F.col("a") / n).alias("nx"), (F.col("b") / n).alias("ny"), nz.alias("nz"), (cellsize * cellsize / nz).alias("area"), F.degrees(F.acos(nz)).alias("slope"))


def depth_thickness(cells: DataFrame, normals: DataFrame, to: str) -> DataFrame:
    """Depth (vertical) to thickness (normal to the surface) by nz, or back; with the slope angle."""
    both = cells.join(normals.select("r", "c", "nz", "slope"), ["r", "c"])
    return both.withColumn("value", F.col("value") * F.col("nz") if to == "thickness" else F.col("value") / F.col("nz")).drop("nz")


def tile_grid(cells: DataFrame, nrows: int, ncols: int, size: int, overlap: int) -> DataFrame:
    """Each cell in every tile that covers it (1 to 4): tile_r, tile_c, r, c (within the tile), gr, gc (global), inner.

    Tiles of `size` cells step by size - 2 * overlap; inner is false in the margin of `overlap` cells at sides that
    another tile follows, where release cells are blanked.
    """
    step = size - 2 * overlap
    if step <= 0:
        raise ValueError("size must be over twice the overlap")
    n = lambda length: max(1, math.ceil((length - 2 * overlap) / step))
    tiles = lambda c, length: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / step).cast("int")), F.least(F.lit(n(length) - 1), F.floor(F.col(c) / step).cast("int"))))
    out = cells.withColumn("tile_r", tiles("r", nrows)).withColumn("tile_c", tiles("c", ncols))
    out = out.withColumnsRenamed({"r": "gr", "c": "gc"}).withColumn("r", F.col("gr") - F.col("tile_r") * step).withColumn("c", F.col("gc") - F.col("tile_c") * step)
    inner = lambda c, t, length: ((F.col(t) == 0) | (F.col(c) >= overlap)) & ((F.col(t) == n(length) - 1) | (F.col(c) < size - overlap))
    return out.withColumn("inner", inner("r", "tile_r", nrows) & inner("c", "tile_c", ncols))


def clip_grid_by_group(dem: DataFrame, vertices: DataFrame, features: DataFrame, buffer: float, cellsize: float = 1.0) -> DataFrame:
    """grp, r, c, z: the part of the terrain within each group's extent and a buffer.

    The rows and columns of an extent are listed and joined by cell key, so the work follows what is kept.
    """
    box = vertices.join(features.select("feature_id", "grp"), "feature_id").groupBy("grp").agg(*[f(x).alias(f"{x}_{n}") for x in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])
    span = lambda x: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(f"{x}_min") - buffer) / cellsize)).cast("int"), F.greatest(F.lit(0), F.floor((F.col(f"{x}_max") + buffer) / cellsize)).cast("int")))
    places = box.withColumn("r", span("y")).withColumn("c", span("x")).select("grp", "r", "c")
    return places.join(dem.select("r", "c", "z"), ["r", "c"]).select("grp", "r", "c", "z")


def update_surface(changes: DataFrame, dem: DataFrame, normals: DataFrame, switches: tuple[bool, bool, bool] = (True, True, True)) -> DataFrame:
    """sim_name, t, r, c, z: terrain with the accumulated change of surface (stopped, detrained, less entrained thickness) / nz."""
    parts = [F.coalesce(F.col(c), F.lit(0.0)) * s for c, s, on in zip(("stopped", "detrained", "entrained"), (1, 1, -1), switches, strict=True) if on] or [F.lit(0.0)]
    total = F.sum("_d").over(Window.partitionBy("sim_name", "r", "c").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    own = changes.withColumn("_d", sum(parts[1:], parts[0])).withColumn("_sum", total)
    on = own.join(dem.select("r", "c", "z"), ["r", "c"]).join(normals.select("r", "c", "nz"), ["r", "c"])
    return on.select("sim_name", "t", "r", "c", (F.col("z") + F.col("_sum") / F.col("nz")).alias("z"))


def export_field_units(cells: DataFrame, area: DataFrame, rho: float = 200.0) -> DataFrame:
    """Values in export units: ppr to kPa, pke to kJ per area, FTDet from detrained mass to thickness."""
    on = cells.join(area.select("r", "c", "area"), ["r", "c"], "left")
    v = F.col("value")
    unit = F.when(F.col("res_type") == "ppr", v * 0.001).when(F.col("res_type") == "pke", v * 0.001 / F.col("area")).when(F.col("res_type") == "FTDet", v / (rho * F.col("area"))).otherwise(v)
    return on.withColumn("value", unit).drop("area")


def fill_nodata(cells: DataFrame, value: float = 0.0) -> DataFrame:
    return cells.fillna(value, ["value"])


def highest_planes(planes: DataFrame, rows: int, cols: int, block: int = 8) -> DataFrame:
    """planes with br, bc of the blocks of cells in which they may be the highest (others are lower there throughout).

    Blocks are halved from one that covers the grid; at each step a plane stays in a block only if its highest corner
    reaches the best lowest corner of any plane, so that few planes are left for each block and all never meet all cells.
    """
    side = block
    while side < max(rows, cols):
        side *= 2
    at = lambda r, c: F.col("z") - ((c - F.col("x")) * F.sin(F.radians("azimuth")) + (r - F.col("y")) * F.cos(F.radians("azimuth"))) * F.tan(F.radians("dip"))
    left = planes.withColumns({"br": F.lit(0), "bc": F.lit(0)})
    while True:
        corners = [at(F.col("br") * side + i, F.col("bc") * side + j) for i in (0, side - 1) for j in (0, side - 1)]
        marked = left.withColumns({"low": F.least(*corners), "high": F.greatest(*corners)})
        best = marked.groupBy("br", "bc").agg(F.max("low").alias("best"))
        left = marked.join(best, ["br", "bc"]).where("high >= best").drop("low", "high", "best")
        if side == block:
            return left
        side //= 2
        for c, n in (("br", rows), ("bc", cols)):
            left = left.withColumn(c, F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1))).where(F.col(c) * side < n)


def scarp_surface(dem: DataFrame, features: DataFrame, perimeter: DataFrame | None = None, form: str = "plane") -> DataFrame:
    """r, c, scarp, release: the terrain cut down by inclined planes or ellipsoids, and the height that it releases.

    plane: features(x, y, z, dip, azimuth), a point and the direction of steepest descent in degrees; of several the highest
    counts, where it is below the terrain.  ellipsoid: features(x, y, depth, a, b, tilt, azimuth), depressions of half axes
    a, b (b along the azimuth) under the terrain, whose floor sinks by tan(tilt) along the azimuth; of several the lowest
    counts.  perimeter (r, c) limits the release.  Planes meet the blocks of cells in which they may be the highest (the
    size of the grid is looked up for that), ellipsoids the cells that they cover.
    """
    if form == "plane":
        rows, cols = dem.agg(F.max("r") + 1, F.max("c") + 1).first()
        near = highest_planes(features, rows or 1, cols or 1).withColumnRenamed("z", "z0")
        on = dem.select("r", "c", "z", F.floor(F.col("r") / 8).cast("int").alias("br"), F.floor(F.col("c") / 8).cast("int").alias("bc")).join(near, ["br", "bc"])
        level = F.col("z0") - ((F.col("c") - F.col("x")) * F.sin(F.radians("azimuth")) + (F.col("r") - F.col("y")) * F.cos(F.radians("azimuth"))) * F.tan(F.radians("dip"))
        found = on.groupBy("r", "c").agg(F.max(level).alias("level"))
    elif form == "ellipsoid":
        reach = F.greatest("a", "b")
        span = lambda c: F.explode(F.sequence(F.ceil(F.col(c) - reach), F.floor(F.col(c) + reach)).cast("array<int>"))
        covered = features.withColumn("r", span("y")).withColumn("c", span("x"))
        dx, dy, azimuth = F.col("c") - F.col("x"), F.col("r") - F.col("y"), F.radians("azimuth")
        along, across = dx * F.sin(azimuth) + dy * F.cos(azimuth), dx * F.cos(azimuth) - dy * F.sin(azimuth)
        covered = covered.withColumns({"along": along, "inside": 1 - (across / F.col("a")) ** 2 - (along / F.col("b")) ** 2}).where("inside > 0")
        sunk = F.col("depth") * F.sqrt("inside") + F.col("along") * F.tan(F.radians("tilt"))
        found = covered.groupBy("r", "c").agg(F.max(sunk).alias("sunk")).join(dem.select("r", "c", "z"), ["r", "c"]).select("r", "c", (F.col("z") - F.col("sunk")).alias("level"))
    else:
        raise ValueError("form: plane or ellipsoid")
    top = dem.select("r", "c", F.col("z").alias("ground")).join(found, ["r", "c"], "left")
    scarp = F.least("ground", "level")  # without a level the terrain stays
    if perimeter is not None:
        top = top.join(perimeter.select("r", "c").distinct().withColumn("_in", F.lit(True)), ["r", "c"], "left")
        scarp = F.when(F.col("_in"), scarp).otherwise(F.col("ground"))
    return top.select("r", "c", scarp.alias("scarp"), (F.col("ground") - scarp).alias("release"))


def contour_segments(cells: DataFrame, level: float) -> DataFrame:
    """x1, y1, x2, y2 of the pieces of a contour line in each block of 2 x 2 cells (marching squares).

    Edges that the level crosses (one end above, the other not) are found and joined in pairs in the order south, east,
    north, west; a saddle gives two pieces.
    """
    v = lambda i, j: F.max(F.when((F.col("dr") == i) & (F.col("dc") == j), F.col("value")))
    each = cells.select(F.explode(F.array(*[F.struct((F.col("r") - i).alias("r"), (F.col("c") - j).alias("c"), F.lit(i).alias("dr"), F.lit(j).alias("dc"), F.col("value")) for i in (0, 1) for j in (0, 1)])).alias("k")).select("k.*")
    block = each.groupBy("r", "c").agg(v(0, 0).alias("sw"), v(0, 1).alias("se"), v(1, 1).alias("ne"), v(1, 0).alias("nw"), F.count("value").alias("n")).where("n = 4")

    def cut(a: str, b: str, x: Column, y: Column, dx: int, dy: int) -> Column:
        f = (level - F.col(a)) / (F.col(b) - F.col(a))
        return F.when((F.col(a) > level) != (F.col(b) > level), F.struct((x + f * dx).alias("x"), (y + f * dy).alias("y")))

    x, y = F.col("c").cast("double"), F.col("r").cast("double")
    cuts = F.filter(F.array(cut("sw", "se", x, y, 1, 0), cut("se", "ne", x + 1, y, 0, 1), cut("nw", "ne", x, y + 1, 1, 0), cut("sw", "nw", x, y, 0, 1)), lambda e: e.isNotNull())
    pieces = block.select("r", "c", cuts.alias("k")).where("size(k) >= 2")
    pairs = F.explode(F.sequence(F.lit(0), F.size("k") - 2, F.lit(2)))
    return pieces.withColumn("i", pairs).select("r", "c", *[F.get("k", F.col("i") + d)[a].alias(f"{a}{d + 1}") for d in (0, 1) for a in ("x", "y")])


#: Parts in which the points of one place, and places without four cells about them, are dealt.
PARTS = 16


def profile_at_line(line: DataFrame, cells: DataFrame, dem: DataFrame, nrows: int, ncols: int, digits: int | None = None) -> DataFrame:
    """line (path_id, i, x, y) with the terrain's z, and for each simulation the value and the surface (z + value) along it.

    The four values about each square of cells come together for each simulation, as one row; places are joined to the rows
    of their square, and their points are put in last.  So what is exchanged grows with the cells and the points, not with
    the result, which has a row for each simulation and point.  Values are rounded to `digits`, once for a place.
    """
    lx, ly = F.col("x"), F.col("y")
    inside = F.coalesce((lx >= 0) & (lx < ncols - 1) & (ly >= 0) & (ly < nrows - 1), F.lit(False))
    part = F.pmod(F.xxhash64("path_id", "i"), F.lit(PARTS)).cast("int")
    square = [F.when(inside, F.floor(ly).cast("int")).otherwise(-1 - part).alias("r"), F.when(inside, F.floor(lx).cast("int")).otherwise(-1).alias("c")]
    places = line.select("path_id", "i", "x", "y", part.alias("_part"), *square).groupBy("x", "y", "_part", "r", "c").agg(F.collect_list(F.struct("path_id", "i")).alias("_points"))
    fx, fy = lx - F.floor(lx), ly - F.floor(ly)
    weight = {(i, j): (fy if i else 1 - fy) * (fx if j else 1 - fx) for i in (0, 1) for j in (0, 1)}
    exact = lambda v: v if digits is None else F.round(v, digits)

    def about(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
        """keys, r, c of the square's lower left cell, v00 ... v11."""
        corner = F.explode(F.array(*[F.struct((F.col("r") - i).alias("r"), (F.col("c") - j).alias("c"), F.lit(2 * i + j).alias("k")) for i, j in weight]))
        each = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_v"), corner.alias("_q")).select(*keys, "_q.*", "_v")
        return each.join(squares, ["r", "c"], "left_semi").groupBy(*keys, "r", "c").agg(*[F.max(F.when(F.col("k") == 2 * i + j, F.col("_v"))).alias(f"v{i}{j}") for i, j in weight])

    between_four = lambda: reduce(lambda a, b: a + b, [w * F.col(f"v{i}{j}") for (i, j), w in weight.items()])  # noqa: E731  null if one is missing
    squares = line.select(*square).distinct()
    corners = [f"v{i}{j}" for i, j in weight]
    ground = places.join(about(dem.select("r", "c", "z"), "z"), ["r", "c"], "left").withColumn("z", between_four()).drop(*corners)
    every = cells.select("sim_name").distinct().join(squares).select("sim_name", "r", "c", *[F.lit(None).cast("double").alias(v) for v in corners])
    values = about(cells.select("sim_name", "r", "c", "value"), "value", ("sim_name",)).select("sim_name", "r", "c", *corners).unionByName(every).groupBy("sim_name", "r", "c").agg(*[F.max(v).alias(v) for v in corners])
    told = ground.join(values, ["r", "c"]).withColumn("value", between_four()).withColumn("surface", F.col("z") + F.coalesce("value", F.lit(0.0)))
    told = told.select("sim_name", "x", "y", *[exact(F.col(c)).alias(c) for c in ("z", "value", "surface")], "_points")
    return told.withColumn("_p", F.explode("_points")).select("sim_name", "_p.path_id", "_p.i", "x", "y", "z", "value", "surface")


def rotate_results(cells: DataFrame, angles: DataFrame, nrows: int, ncols: int, reference: float = 0.0) -> DataFrame:
    """Every simulation's rasters turned by its own angle (sim_name, degrees) less that of the reference."""
    a = F.radians(F.col("degrees") - reference)
    on = cells.join(angles.select("sim_name", F.cos(a).alias("_cos"), F.sin(a).alias("_sin")), "sim_name")
    keys = ("sim_name", "res_type", "_cos", "_sin")
    return turned(on, nrows, ncols, F.col("_cos"), F.col("_sin"), keys).select("sim_name", "res_type", "r", "c", "value")
