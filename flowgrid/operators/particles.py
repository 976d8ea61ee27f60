"""Particle snapshots particles(sim_name, t, id, parent_id, x, y, z, ux, uy, uz, m, ...), mass series and routed paths."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowgrid.functions.batches import in_groups
from flowgrid.functions.ranks import percentiles
from flowgrid.functions.vectors import above, half_even, norm
from flowgrid.sources.shared import kept


def mass_averaged_path(particles: DataFrame, columns: tuple[str, ...] = ("x", "y", "z", "s"), weight: str = "m", keys: tuple[str, ...] = ("sim_name", "t")) -> DataFrame:
    """Per key the weighted mean and deviation of each column, of the squared speed, and the kinetic energy.

    The variance is summed about an anchor near the mean (the first value seen in a first, cheap pass), so that large
    coordinates do not cancel.
    """
    own = particles.withColumn("u2", F.col("ux") ** 2 + F.col("uy") ** 2 + F.col("uz") ** 2)
    names = (*columns, "u2")
    anchor = own.groupBy(*keys).agg(*[F.min(c).alias(f"_{c}") for c in names])
    w = F.col(weight)
    on = own.join(anchor, list(keys))
    d = lambda c: F.col(c) - F.col(f"_{c}")
    sums = on.groupBy(*keys, *[f"_{c}" for c in names]).agg(F.sum(w).alias("w"), *[F.sum(w * d(c)).alias(f"{c}1") for c in names], *[F.sum(w * d(c) ** 2).alias(f"{c}2") for c in names])
    mean = lambda c: F.col(f"{c}1") / F.col("w")
    out = [(F.col(f"_{c}") + mean(c)).alias(c) for c in names] + [F.sqrt(F.greatest(F.lit(0.0), F.col(f"{c}2") / F.col("w") - mean(c) ** 2)).alias(f"{c}_std") for c in names]
    return sums.where("w > 0").select(*keys, *out, (0.5 * F.col("w") * (F.col("_u2") + mean("u2"))).alias("e_kin"))


def mass_averaged_path_of_fields(fields: DataFrame, dem: DataFrame, cellsize: float = 1.0) -> DataFrame:
    """Per simulation and time the mass-averaged path from rasters instead of particles: x, y, z, u2, ekin and their deviations, e_kin, s.

    fields: sim_name, t, r, c, ft (thickness), fm (mass), fv (speed); cells count where ft > 0 and mass and speed are there.
    x and y are from the lower left centre; s is the distance along the path in the plane; ekin is the mass-averaged kinetic
    energy of a cell, e_kin that of all.  Cells without terrain are left out.
    """
    flowing = fields.where(above(F.col("ft"), 0.0) & F.col("fm").isNotNull() & F.col("fv").isNotNull()).join(dem.select("r", "c", "z"), ["r", "c"])
    x, y = F.col("c") * float(cellsize), F.col("r") * float(cellsize)
    none = F.lit(0.0)
    rows = flowing.select("sim_name", "t", x.alias("x"), y.alias("y"), "z", F.col("fm").alias("m"), F.col("fv").alias("ux"), none.alias("uy"), none.alias("uz"), (0.5 * F.col("fm") * F.col("fv") ** 2).alias("ekin"))
    mean = mass_averaged_path(rows, ("x", "y", "z", "ekin"))
    own = Window.partitionBy("sim_name").orderBy("t")
    step = F.sqrt((F.col("x") - F.lag("x").over(own)) ** 2 + (F.col("y") - F.lag("y").over(own)) ** 2)
    return mean.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("s", F.sum("_d").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def velocity_envelope_time(particles: DataFrame) -> DataFrame:
    """Per simulation and time: maximum, minimum, mean and median speed, largest and smallest trajectory length."""
    own = particles.withColumn("v", norm((F.col("ux"), F.col("uy"), F.col("uz"))))
    told = own.groupBy("sim_name", "t").agg(F.max("v").alias("v_max"), F.min("v").alias("v_min"), F.avg("v").alias("v_mean"), F.max("s").alias("s_max"), F.min("s").alias("s_min"))
    return told.join(percentiles(own, "v", {"v_median": 0.5}, ["sim_name", "t"]), ["sim_name", "t"], "left")


def velocity_envelope_thalweg(particles: DataFrame, step: float) -> DataFrame:
    """The same along the path, by steps of s (a whole number, not a double, is the key), with the mean elevation.

    The median is taken on values with their counts, so a step that holds most particles stays small.
    """
    v = F.round(norm((F.col("ux"), F.col("uy"), F.col("uz"))), 6)
    own = particles.select("sim_name", F.floor(F.col("s") / step).alias("i_s"), v.alias("v"), "z")
    counts = own.groupBy("sim_name", "i_s", "v").agg(F.count("*").alias("n"), F.sum("z").alias("z"))
    total = F.sum("n")
    # Speeds are whole millionths, so their sum is exact in whatever order it is taken.
    mean = F.sum(F.round(F.col("v") * 1e6).cast("long") * F.col("n")) / total / 1e6
    return counts.groupBy("sim_name", "i_s").agg(F.max("v").alias("v_max"), F.min("v").alias("v_min"), mean.alias("v_mean"), F.percentile("v", F.lit(0.5), F.col("n")).alias("v_median"), (F.sum("z") / total).alias("z_mean"))


def track_particles(particles: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """All snapshots of particles whose parent is, at the simulation's first time, within radius of a point."""
    first = particles.withColumn("_t", F.min("t").over(Window.partitionBy("sim_name", "parent_id"))).where("t = _t")
    parents = first.where((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2 <= radius**2).select("sim_name", "parent_id").distinct()
    return particles.join(parents, ["sim_name", "parent_id"], "left_semi")


def particle_time_arrays(particles: DataFrame, column: str, width: int | None = None) -> DataFrame:
    """sim_name, t, n, values of a column in the order of ids, and whether the number of particles is that of the first time.

    With width a row holds the particles of `width` ids (chunk = floor(id / width)), so a snapshot of any size is spread
    over rows; n is still that of the whole snapshot.
    """
    part = [] if width is None else ["chunk"]
    numbered = particles if width is None else particles.withColumn("chunk", F.floor(F.col("id") / width))
    own = numbered.groupBy("sim_name", "t", *part).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("id", column))), lambda x: x[column]).alias("values"))
    first = F.first("n").over(Window.partitionBy("sim_name").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    if width is None:
        return own.withColumn("same_count", F.col("n") == first)
    whole = own.groupBy("sim_name", "t").agg(F.sum("n").alias("n"))
    return own.drop("n").join(whole.withColumn("same_count", F.col("n") == first), ["sim_name", "t"]).select("sim_name", "t", "chunk", "n", "values", "same_count")


def travel_angle(particles: DataFrame) -> DataFrame:
    """particles with travel_angle (degrees): of the drop since the parent's first snapshot over the length of the trajectory, 0 without length."""
    first = particles.groupBy("sim_name", "parent_id").agg(F.max_by("z", F.struct(-F.col("t"), F.col("id"))).alias("z0"))
    on = particles.join(first, ["sim_name", "parent_id"])
    return on.withColumn("travel_angle", F.when(F.col("s") > 0, F.degrees(F.atan2(F.col("z0") - F.col("z"), F.col("s")))).otherwise(0.0)).drop("z0")


def particles_to_fields(particles: DataFrame, cellsize: float, rho: float = 200.0) -> DataFrame:
    """Per simulation, time and node: mass, flow thickness, velocity, pressure, kinetic energy, from particles spread on 4 nodes.

    Weights are bilinear, so the mass is kept; sums are partial before the exchange, which also evens out full cells.
    """
    full = all_particle_fields(particles, cellsize, rho)
    return full.where("mass > 0").select("sim_name", "t", "r", "c", "mass", "ft", "v", "p", "ke")


def all_particle_fields(particles: DataFrame, cellsize: float, rho: float = 200.0, rho_ent: float = 100.0, area: DataFrame | None = None, stopped: DataFrame | None = None) -> DataFrame:
    """Per simulation, time and node everything that particles leave on the grid.

    mass, m_det, m_ent, m_stop, thickness ft, vx, vy, vz, speed v, pressure p, kinetic energy ke, travel angle ta, and the
    changes of the surface ft_det, ft_ent (with rho_ent) and ft_stop.  Two footprints go through one exchange: a particle adds
    bilinear shares of m, dm_det, dm_ent and momentum to its four nodes, and its travel_angle to the maximum of the nearest
    node (halves upwards).  Columns dm_det, dm_ent and travel_angle count as 0 where particles has none or nulls.

    area: r, c, area of each cell on the surface, without it cellsize^2; nodes that it lacks are left out.
    stopped: sim_name, t, x, y, m of particles that came to rest; their mass counts for m_stop and ft_stop only.
    """
    given = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in particles.columns else F.lit(0.0)
    place = ["sim_name", "t", "x", "y"]
    shares = ("mass", "m_det", "m_ent", "m_stop", "ux", "uy", "uz")
    m = F.col("m")
    rows = particles.select(*place, m.alias("mass"), given("dm_det").alias("m_det"), given("dm_ent").alias("m_ent"), F.lit(0.0).alias("m_stop"), *[(m * F.col(u)).alias(u) for u in ("ux", "uy", "uz")], given("travel_angle").alias("ta"))
    if stopped is not None:
        rest = stopped.select(*place, *[(F.col("m") if c == "m_stop" else F.lit(0.0)).alias(c) for c in shares], F.lit(0.0).alias("ta"))
        rows = rows.unionByName(rest)
    lx, ly = F.col("x") / cellsize, F.col("y") / cellsize
    fx, fy = lx - F.floor(lx), ly - F.floor(ly)
    near = (F.floor(ly + 0.5).cast("int"), F.floor(lx + 0.5).cast("int"))

    def node(i: int, j: int) -> Column:
        r, c = (F.floor(ly) + i).cast("int"), (F.floor(lx) + j).cast("int")
        return F.struct(r.alias("r"), c.alias("c"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w"), ((r == near[0]) & (c == near[1])).alias("nearest"))

    each = rows.withColumn("k", F.explode(F.array(*[node(i, j) for i in (0, 1) for j in (0, 1)]))).where("k.w > 0")
    sums = each.groupBy("sim_name", "t", F.col("k.r").alias("r"), F.col("k.c").alias("c")).agg(*[F.sum(F.col("k.w") * F.col(x)).alias(x) for x in shares], F.coalesce(F.max(F.when(F.col("k.nearest"), F.col("ta"))), F.lit(0.0)).alias("ta"))
    on = sums.withColumn("area", F.lit(float(cellsize) ** 2)) if area is None else sums.join(area.select("r", "c", "area"), ["r", "c"])
    per_mass = lambda u: F.coalesce(F.try_divide(u, "mass"), F.lit(0.0))
    v = F.coalesce(F.try_divide(norm((F.col("ux"), F.col("uy"), F.col("uz"))), F.col("mass")), F.lit(0.0))
    on = on.withColumns({f"v{a}": per_mass(f"u{a}") for a in "xyz"}).withColumn("v", v)
    unit = F.col("area") * rho
    change = lambda c, by: ((0.0 - F.col(c)) / by).alias(f"ft_{c[2:]}")
    return on.select("sim_name", "t", "r", "c", "mass", "m_det", "m_ent", "m_stop", (F.col("mass") / unit).alias("ft"), "vx", "vy", "vz", "v", (rho * F.col("v") ** 2).alias("p"), (0.5 * F.col("mass") * F.col("v") ** 2).alias("ke"), "ta", change("m_det", unit), change("m_ent", F.col("area") * rho_ent), (F.col("m_stop") / unit).alias("ft_stop"))


def particles_per_cell(particles: DataFrame, cellsize: float, ncols: int) -> DataFrame:
    """Per simulation, time and cell (by rounding) the count, and the number of particles in the cells before it."""
    own = particles.select("sim_name", "t", half_even(F.col("y") / cellsize).cast("int").alias("r"), half_even(F.col("x") / cellsize).cast("int").alias("c")).groupBy("sim_name", "t", "r", "c").agg(F.count("*").alias("n"))
    order = Window.partitionBy("sim_name", "t").orderBy(F.col("r") * ncols + F.col("c")).rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))


def split_cell_mass(particles: DataFrame, cell_mass: DataFrame, keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """Particles with an even share of the mass of their cell."""
    counts = particles.groupBy(*keys).agg(F.count("*").alias("_n"))
    return particles.join(counts, list(keys)).join(cell_mass.select(*keys, "mass"), list(keys)).withColumn("m", F.col("mass") / F.col("_n")).drop("_n", "mass")


BLOCKS = 64


def start_balanced_chunks(cells: DataFrame, parts: int, order: str = "altitude", weight: str = "weight") -> DataFrame:
    """Start cells in descending order of altitude, cut into parts of about equal weight: rank, part.

    The running sum is taken in blocks of cells: totals of the blocks before, then within the block, so no window holds
    all cells.  Blocks lie between approximate percentiles of the altitude; cells of one altitude are spread over BLOCKS
    more by their id, in order.
    """
    cuts = F.percentile_approx(order, [i / BLOCKS for i in range(1, BLOCKS)], 10 * BLOCKS)
    edge = cells.agg(cuts.alias("cuts"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum(weight).alias("total"))  # one row
    higher = F.size(F.filter("cuts", lambda c: c > F.col(order)))
    by_id = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("id") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (BLOCKS - 1))).otherwise(0)
    block = F.struct(higher.alias("a"), F.when(F.array_contains("cuts", F.col(order)), -F.col(order)).alias("b"), F.when(F.array_contains("cuts", F.col(order)), by_id).alias("c"))
    on = cells.join(F.broadcast(edge)).withColumn("_b", block)
    blocks = on.groupBy("_b").agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"))  # BLOCKS * (BLOCKS + 1) rows at most
    w = Window.orderBy(F.col("_b.a"), F.col("_b.b").isNotNull().cast("int"), F.col("_b.b"), F.col("_b.c")).rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("_b", F.coalesce(F.sum("_w").over(w), F.lit(0.0)).alias("_w0"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"))
    own = Window.partitionBy("_b").orderBy(F.desc(order), "id")
    so_far = F.col("_w0") + F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
    out = on.join(F.broadcast(before), "_b").withColumn("rank", F.col("_n0") + F.row_number().over(own)).withColumn("part", F.least(F.lit(parts - 1), F.floor(so_far / F.col("total") * parts)))
    return out.select(*cells.columns, "rank", "part")


# ---- mass series ----
def write_mass_series(mass: DataFrame) -> DataFrame:
    """Mass rows with the running total of what was detrained."""
    return mass.withColumn("detrained_total", F.sum("detrained").over(Window.partitionBy("sim_name").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))


def mass_summary(mass: DataFrame, reference: str, tolerance: float = 0.0005) -> DataFrame:
    """Per simulation first and last total, entrained sum, growth index and gradient, difference to the reference, whether mass is kept.

    Without entrainment mass is kept if the totals agree; with it if the growth is the entrained sum within the tolerance.
    """
    own = mass.groupBy("sim_name").agg(F.min_by("total", "t").alias("first"), F.max_by("total", "t").alias("last"), F.sum("entrained").alias("entrained"), (F.max("t") - F.min("t")).alias("duration"))
    ref = own.where(F.col("sim_name") == reference).select(F.col("last").alias("ref_last"))
    on = own.join(F.broadcast(ref), how="left")  # one row
    grown = F.col("last") - F.col("first")
    kept = F.when(F.col("entrained") == 0, F.abs(grown) <= tolerance * F.col("first")).otherwise(F.abs(grown - F.col("entrained")) <= tolerance * F.col("last"))
    return on.select("sim_name", "first", "last", "entrained", F.try_divide("last", "first").alias("growth_index"), F.try_divide(grown, F.col("duration")).alias("growth_gradient"), F.try_divide((F.col("ref_last") - F.col("last")) * 100, F.col("ref_last")).alias("difference"), kept.alias("kept"))


def interp_to_time_grid(mass: DataFrame, times: DataFrame) -> DataFrame:
    """Total mass and entrained flow (change over the step before) of each simulation at common times, linear, ends clamped.

    As-of on both sides: times and rows are ordered together per simulation, and the last and next known row are carried.
    """
    w = Window.partitionBy("sim_name").orderBy("t")
    known = mass.select("sim_name", "t", "total", F.coalesce(F.try_divide(F.col("entrained"), F.col("t") - F.lag("t").over(w)), F.lit(0.0)).alias("flow"))
    wanted = mass.select("sim_name").distinct().join(times.select("t"))
    both = known.select("sim_name", "t", F.struct("t", "total", "flow").alias("k")).unionByName(wanted.withColumn("k", F.lit(None)), allowMissingColumns=True)
    # What follows is what precedes in the opposite order, with a running frame; a frame to the end would start anew at each row.
    order = Window.partitionBy("sim_name").orderBy("t", F.col("k").isNull())
    back = Window.partitionBy("sim_name").orderBy(F.desc("t"), F.col("k").isNotNull())
    a, b = (F.last("k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for w in (order, back))
    on = both.withColumn("a", a).withColumn("b", b).where("k is null").withColumn("a", F.coalesce("a", "b")).withColumn("b", F.coalesce("b", "a"))
    f = F.when(F.col("b.t") > F.col("a.t"), (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))).otherwise(0.0)
    return on.select("sim_name", "t", *[(F.col(f"a.{c}") + f * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(c) for c in ("total", "flow")])


# ---- routed paths ----
def path_visit_layers(visits: DataFrame) -> DataFrame:
    """Per cell over all start cells: largest z_delta and flux, sums, angles, length, number of starts, and the sum of each start's largest z_delta.

    Two levels: by start and cell, which spreads a valley cell that every start visits, then by cell.
    """
    per = visits.groupBy("start_id", "r", "c").agg(*[F.max(c).alias(c) for c in ("z_delta", "flux")], F.sum("flux").alias("flux_sum"), F.sum("flux_dep").alias("dep_sum"), *[f(c).alias(f"{c}_{n}") for c in ("fp_gamma", "sl_gamma") for n, f in (("max", F.max), ("min", F.min))], F.max("dist").alias("dist_max"), F.min("dist").alias("dist_min"))
    return per.groupBy("r", "c").agg(F.max("z_delta").alias("z_delta"), F.max("flux").alias("flux"), F.sum("flux_sum").alias("flux_sum"), F.sum("dep_sum").alias("dep_sum"), *[f(f"{c}_{n}").alias(f"{c}_{n}") for c in ("fp_gamma", "sl_gamma", "dist") for n, f in (("max", F.max), ("min", F.min))], F.count("*").alias("n_starts"), F.sum("z_delta").alias("z_delta_sum"))


def improved(found: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Rows of found (start_id, node, value, one for each node) that are above the largest value in tables, or new to them."""
    known = reduce(DataFrame.union, tables).join(found.select("start_id", "node"), ["start_id", "node"], "left_semi").groupBy("start_id", "node").agg(F.max("value").alias("_v"))
    return found.join(known, ["start_id", "node"], "left").where("_v is null or value > _v").select("start_id", "node", "value")


def spread_in_blocks(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """start_id, node, value of the nodes that rise when values go up the links (node, down) within each block until nothing changes.

    A group is one block of one start: its nodes and the links between them, bounded by the block's size.
    """

    def run(key: tuple, own: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([own["node"], up["node"], up["down"]]))
        value = np.full(len(ids), -np.inf)
        value[np.searchsorted(ids, own["node"])] = own["value"]
        to, of, before = np.searchsorted(ids, up["node"]), np.searchsorted(ids, up["down"]), value.copy()
        while True:
            new = value.copy()
            np.maximum.at(new, to, value[of])
            if (new == value).all():
                break
            value = new
        rose = value > before
        return pd.DataFrame({"start_id": key[0], "node": ids[rose], "value": value[rose]})

    kind = nodes.schema["start_id"].dataType.simpleString()
    return nodes.groupBy("start_id", "block").cogroup(links.groupBy("start_id", "block")).applyInPandas(run, f"start_id {kind}, node long, value double")


def largest_below(node: np.ndarray, down: np.ndarray, value: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """group, node and largest value of each node and all below it, for many graphs at once.

    Rows are links (node, down), or values of a node (down is the node itself); values of links are -inf.  A round goes up
    the links of the nodes that rose in the round before.
    """
    ids, at = np.unique(np.concatenate([node, down]), return_inverse=True)
    keys, at = np.unique(np.concatenate([group, group]) * len(ids) + at, return_inverse=True)
    to, of = np.split(at, 2)
    own = to == of
    best, known = np.full(len(keys), -np.inf), np.zeros(len(keys), bool)
    np.maximum.at(best, to[own], value[own])
    known[to[own]] = True
    order = np.argsort(of[~own], kind="stable")
    up, of = to[~own][order], of[~own][order]
    first, count = np.searchsorted(of, np.arange(len(keys))), np.bincount(of, minlength=len(keys))
    rose = np.flatnonzero(known & (count > 0))
    while len(rose):
        n = count[rose]
        links = np.repeat(first[rose] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        before = best[up[links]]
        np.maximum.at(best, up[links], np.repeat(best[rose], n))
        rose = np.unique(up[links][best[up[links]] > before])
        rose = rose[count[rose] > 0]
    found = known | (best > -np.inf)
    return keys[found] // len(ids), ids[keys[found] % len(ids)], best[found]


def backtrack_small(edges: DataFrame, values: DataFrame) -> DataFrame:
    """backtrack_max for starts with few rows each: many starts at a time, after one exchange."""
    kind = values.schema["start_id"].dataType.simpleString()
    rows = edges.select("start_id", "node", "down", F.lit(-math.inf).alias("value")).unionByName(values.select("start_id", "node", F.col("node").alias("down"), "value"))

    def work(c: dict[str, np.ndarray], group: np.ndarray, keys: pa.Array) -> pa.Table:
        of, node, value = largest_below(c["node"], c["down"], c["value"], group)
        return pa.table({"start_id": keys.take(pa.array(of)), "node": node, "value": value})

    return in_groups(rows, "start_id", [], work, f"start_id {kind}, node long, value double")


def backtrack_max(edges: DataFrame, values: DataFrame, block: int = 256) -> DataFrame:
    """start_id, node, value: the largest value of a node and of all nodes downstream of it on its path.

    Starts with up to 4 * block edges and values are done whole, many at a time.  In larger ones values travel by frontier:
    a round takes only the nodes whose value rose in the round before.  It spreads them within blocks of `block` node
    numbers, to the end, and over the edges that leave a block by one step; what rises there is the next frontier.  So a
    path takes as many rounds as it changes blocks, and circles end when nothing rises.  Each round's rises are a table of
    their own in the shared folder; at every eighth they are put together.  Nodes are whole numbers; missing and NaN values
    and edges without an end are left out; a node that nothing reaches and has no value is not there.
    """
    links = edges.select("start_id", F.col("parent").cast("long").alias("node"), F.col("child").cast("long").alias("down")).where("start_id is not null and node is not null and down is not null and node <> down")
    own = values.select("start_id", F.col("node").cast("long").alias("node"), F.col("value").cast("double").alias("value")).where("node is not null and value is not null and not isnan(value)")
    large = kept(links.select("start_id").unionByName(own.select("start_id")).groupBy("start_id").count().where(F.col("count") > 4 * block).select("start_id"), "large")
    if large.isEmpty():
        return backtrack_small(links, own)
    small = [df.join(large, "start_id", "left_anti") for df in (links, own)]
    return backtrack_small(*small).unionByName(backtrack_large(links.join(large, "start_id", "left_semi"), own.join(large, "start_id", "left_semi"), block))


def backtrack_large(links: DataFrame, own: DataFrame, block: int) -> DataFrame:
    """backtrack_max by frontier."""
    of = lambda c: F.floor(F.col(c) / block)
    links = kept(links.distinct().withColumn("block", of("node")).withColumn("same", of("node") == of("down")), "links")
    inner, outer = links.where("same").drop("same"), links.where("not same").select("start_id", "node", "down")
    base, risen = kept(own.groupBy("start_id", "node").agg(F.max("value").alias("value")), "values"), []
    fresh = base
    while not fresh.isEmpty():
        touched = fresh.select("start_id", of("node").alias("block")).distinct()
        here = ["start_id", "block"]
        current = reduce(DataFrame.union, [base, *risen]).withColumn("block", of("node")).join(touched, here, "left_semi").groupBy("start_id", "block", "node").agg(F.max("value").alias("value"))
        spread = kept(spread_in_blocks(current, inner.join(touched, here, "left_semi")), "spread")
        risen.append(spread)
        moved = fresh.union(spread).groupBy("start_id", "node").agg(F.max("value").alias("value"))
        below = outer.join(moved.withColumnRenamed("node", "down"), ["start_id", "down"]).groupBy("start_id", "node").agg(F.max("value").alias("value"))
        fresh = kept(improved(below, [base, *risen]), "frontier")
        risen.append(fresh)
        if len(risen) > 8:
            risen = [kept(reduce(DataFrame.union, risen).groupBy("start_id", "node").agg(F.max("value").alias("value")), "risen")]
    return reduce(DataFrame.union, [base, *risen]).groupBy("start_id", "node").agg(F.max("value").alias("value"))


# ---- distance and time ----
def radar_mask(cells: DataFrame, z: DataFrame, radar: tuple[float, float, float], azimuth: float, aperture: float) -> DataFrame:
    """r, c, range, azimuth of the cells within +- aperture (degrees) of the direction in which the radar looks."""
    from flowgrid.functions.vectors import spherical

    far, az, _ = spherical(F.col("c") - radar[0], F.col("r") - radar[1], F.col("z") - radar[2])
    on = cells.select("r", "c").distinct().join(z.select("r", "c", "z"), ["r", "c"])
    turn = F.pmod(az - azimuth + 180.0, F.lit(360.0)) - 180.0
    return on.select("r", "c", far.alias("range"), az.alias("azimuth"), turn.alias("turn")).where(F.abs("turn") <= aperture).drop("turn")


def range_time(cells: DataFrame, view: DataFrame, limit: float, width: float, how: str = "max", step: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(mti, front): per simulation, time and range gate the maximum or mean of the values above the limit, and the nearest range.

    Gate k is at k * step (by default width, so that gates don't overlap) and holds the cells strictly within half a
    width; a cell on an edge belongs to no gate on that side.  Gates from the nearest to the farthest flowing cell are
    listed, with 0 where they hold none.  Each cell is listed under the few gates that it may belong to: an equi-join, no range join.
    """
    step = step or width
    on = cells.join(view.select("r", "c", "range"), ["r", "c"]).where(F.coalesce(F.col("value") > limit, F.lit(False)))
    near = F.sequence(F.floor((F.col("range") - width / 2) / step), F.ceil((F.col("range") + width / 2) / step))
    rule = F.max if how == "max" else F.avg
    hit = on.withColumn("gate", F.explode(near)).where(F.abs(F.col("range") - F.col("gate") * step) < width / 2).groupBy("sim_name", "t", "gate").agg(rule("value").alias("value"))
    ends = on.groupBy("sim_name", "t").agg(F.min("range").alias("range"), F.max("range").alias("far"))
    first, last = F.ceil(F.col("range") / step), F.floor(F.col("far") / step)
    gates = ends.where(last >= first).select("sim_name", "t", F.explode(F.sequence(first, last)).alias("gate"))
    mti = gates.join(hit, ["sim_name", "t", "gate"], "left").fillna(0.0, ["value"])
    return mti, ends.select("sim_name", "t", "range")


def thalweg_distance(thalweg: DataFrame, start_of_runout: int, parallel: bool = False) -> DataFrame:
    """path_id, i_s, distance of each section from the one where the runout area starts: in the plane, or parallel to the surface."""
    own = Window.partitionBy("path_id").orderBy("i_s")
    d = F.col("s")
    if parallel:
        step = F.sqrt((F.col("s") - F.lag("s").over(own)) ** 2 + (F.col("z") - F.lag("z").over(own)) ** 2)
        thalweg = thalweg.withColumn("_step", F.coalesce(step, F.lit(0.0)))
        d = F.sum("_step").over(own.rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy("path_id")
    return thalweg.withColumn("_d", d).select("path_id", "i_s", (F.col("_d") - F.max(F.when(F.col("i_s") == start_of_runout, F.col("_d"))).over(whole)).alias("distance"))


def thalweg_time(cross: DataFrame, thalweg: DataFrame, limit: float, start_of_runout: int, parallel: bool = False) -> DataFrame:
    """Per simulation, path and time the front: the distance of the last section whose cross maximum is above the limit.

    thalweg: path_id, i_s, s, and with parallel z; start_of_runout: the section (i_s) that distances are taken from.
    """
    on = cross.where(F.coalesce(F.col("v_max") > limit, F.lit(False))).join(thalweg_distance(thalweg, start_of_runout, parallel), ["path_id", "i_s"])
    return on.groupBy("sim_name", "path_id", "t").agg(F.max_by("distance", "i_s").alias("front"))


def thalweg_time_values(cross: DataFrame, thalweg: DataFrame, start_of_runout: int, how: str = "max", parallel: bool = False) -> DataFrame:
    """sim_name, path_id, t, distance, value: the cross maximum or mean of each section at each time, by its distance."""
    value = {"max": "v_max", "mean": "v_mean"}[how]
    return cross.join(thalweg_distance(thalweg, start_of_runout, parallel), ["path_id", "i_s"]).select("sim_name", "path_id", "t", "distance", F.col(value).alias("value"))


def approach_velocity(front: DataFrame) -> DataFrame:
    """sim_name, velocity, range, t: the largest velocity of approach along a front (t, range falling towards the radar).

    Rows with a range up to the first farthest one are left out, ranges are unique by their value rounded to 2 digits
    (the first time stays), and a velocity over twice the mean of its neighbours is an outlier; the last is not tested.
    """
    own = Window.partitionBy("sim_name").orderBy("t")
    known = front.where("range is not null")
    first = F.row_number().over(Window.partitionBy("sim_name", F.round("range", 2)).orderBy("t"))
    unique = known.withColumn("_k", first).where("_k = 1")
    v = F.abs((F.lead("range").over(own) - F.col("range")) / (F.lead("t").over(own) - F.col("t")))
    each = unique.withColumn("velocity", v).where("velocity is not null")
    before, after = F.lag("velocity").over(own), F.lead("velocity").over(own)
    fine = each.withColumn("_out", F.coalesce(F.col("velocity") > 2 * (before + after) / 2, F.lit(False))).where("not _out")
    return fine.groupBy("sim_name").agg(F.max(F.struct("velocity", -F.col("t"), "range")).alias("k")).select("sim_name", "k.velocity", "k.range", (-F.col("k.col2")).alias("t"))


