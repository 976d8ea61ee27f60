"""Lines as ordered vertices (path_id, i, x, y, z): distances, slopes, and the models fitted to many profiles at once.

Windows are per path; paths are short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from flowgrid.functions.batches import in_groups

from .grids import corner_weights

def own() -> WindowSpec:
    return Window.partitionBy("path_id").orderBy("i")


def whole() -> WindowSpec:
    return own().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def so_far() -> WindowSpec:
    return own().rowsBetween(Window.unboundedPreceding, 0)


def along_line_distance(path: DataFrame, surface: bool = False) -> DataFrame:
    """path with s, the cumulative distance in the plane, and with surface s_xyz, that along the surface."""
    step = lambda c: F.col(c) - F.lag(c).over(own())
    flat = step("x") ** 2 + step("y") ** 2
    out = path.withColumn("_d", F.coalesce(F.sqrt(flat), F.lit(0.0)))
    if surface:
        out = out.withColumn("_e", F.coalesce(F.sqrt(flat + step("z") ** 2), F.lit(0.0)))
    out = out.withColumn("s", F.sum("_d").over(so_far()))
    return out.withColumn("s_xyz", F.sum("_e").over(so_far())).drop("_d", "_e") if surface else out.drop("_d")


def orient_profile(path: DataFrame) -> DataFrame:
    """Paths reversed where the last point is higher than the first: i and s count from the upper end."""
    up = F.last("z").over(whole()) > F.first("z").over(whole())
    flagged = path.withColumn("_up", up).withColumn("_n", F.max("i").over(whole())).withColumn("_l", F.max("s").over(whole()))
    return flagged.withColumn("i", F.when(F.col("_up"), F.col("_n") - F.col("i")).otherwise(F.col("i"))).withColumn("s", F.when(F.col("_up"), F.col("_l") - F.col("s")).otherwise(F.col("s"))).drop("_up", "_n", "_l")


def resample_line(path: DataFrame, distance: float) -> DataFrame:
    """path_id, i, s, x, y, z at ceil(L / distance) + 1 equally spaced points, linear between vertices; repeated vertices are left out.

    Each section between two vertices yields the points that lie in it, so there is no join.
    """
    flat = along_line_distance(path).withColumn("_back", F.lag("s").over(own())).where("_back is null or s > _back").drop("_back")
    long = F.max("s").over(whole())
    section = flat.withColumn("_n", F.ceil(long / distance)).withColumn("_l", long)
    for c in ("s", "x", "y", "z"):
        section = section.withColumn(f"_{c}", F.lead(c).over(own()))
    step = F.col("_l") / F.col("_n")
    first, last = F.ceil(F.col("s") / step - 1e-9), F.when(F.col("_s") == F.col("_l"), F.col("_n")).otherwise(F.ceil(F.col("_s") / step - 1e-9) - 1)
    each = section.where("_s is not null").withColumn("k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    f = (F.col("k") * step - F.col("s")) / (F.col("_s") - F.col("s"))
    return each.select("path_id", F.col("k").cast("int").alias("i"), (F.col("k") * step).alias("s"), *[(F.col(c) + f * (F.col(f"_{c}") - F.col(c))).alias(c) for c in ("x", "y", "z")])


def bends(u: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives at u of the cubic splines through (u, y) whose first and last two pieces are one cubic each.

    The first axis is that of the points, four at least; y has one more at the end than u, and all others are of many lines.
    """
    n = len(u)
    h = np.diff(u, axis=0)
    right = 6 * np.diff(np.diff(y, axis=0) / h[..., None], axis=0)
    low, mid, high = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    # The outer second derivatives follow from the inner ones, so a band of three is left.
    mid[0], high[0] = mid[0] + h[0] + h[0] ** 2 / h[1], high[0] - h[0] ** 2 / h[1]
    mid[-1], low[-1] = mid[-1] + h[-1] + h[-1] ** 2 / h[-2], low[-1] - h[-1] ** 2 / h[-2]
    for i in range(1, n - 2):
        f = low[i] / mid[i - 1]
        mid[i] -= f * high[i - 1]
        right[i] -= f[..., None] * right[i - 1]
    m = np.zeros_like(y)
    for i in range(n - 3, -1, -1):
        m[i + 1] = (right[i] - (high[i][..., None] * m[i + 2] if i < n - 3 else 0)) / mid[i][..., None]
    m[0] = m[1] - (h[0] / h[1])[..., None] * (m[2] - m[1])
    m[-1] = m[-2] + (h[-1] / h[-2])[..., None] * (m[-2] - m[-3])
    return m


def spline(u: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through (u, y), whose first and last two pieces are one cubic each, at other places; y by columns.

    Of up to three points the polynomial through them.
    """
    n = len(u)
    if n < 4:
        weights = [np.prod([(at - u[j]) / (u[i] - u[j]) for j in range(n) if j != i], axis=0) if n > 1 else np.ones_like(at) for i in range(n)]
        return sum(w[:, None] * y[i] for i, w in enumerate(weights))
    return cubic_between(u, y, bends(u, y), at)


def five_band(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of symmetric positive definite systems with the diagonals d0, d1, d2 (first to second beside it).

    The first axis is that of the unknowns; right has one more at the end, and all others are of many systems.
    """
    n, none = len(d0), np.zeros((1, *d0.shape[1:]))
    d, e, f, x = d0.astype(float), np.concatenate([d1, none]), np.concatenate([d2, none, none]), right.astype(float)
    for i in range(n):  # L D L', row by row
        if i > 1:
            d[i] -= f[i - 2] ** 2 * d[i - 2]
        if i > 0:
            d[i] -= e[i - 1] ** 2 * d[i - 1]
            e[i] -= e[i - 1] * f[i - 1] * d[i - 1]
            x[i] -= e[i - 1][..., None] * x[i - 1]
        if i > 1:
            x[i] -= f[i - 2][..., None] * x[i - 2]
        e[i], f[i] = e[i] / d[i], f[i] / d[i]
    x /= d[..., None]
    for i in range(n - 2, -1, -1):
        x[i] -= e[i][..., None] * x[i + 1] + (f[i][..., None] * x[i + 2] if i < n - 2 else 0)
    return x


def smoothed(u: np.ndarray, y: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, second derivatives, weight) at u of the smoothest curve whose squared distances from y add up to bound at most.

    Smoothest: the integral of the squared second derivative is smallest; that is a natural cubic spline.  Its second
    derivatives m solve (R + k Q'Q) m = Q'y with a band of five, its values are y - k Q m, and k, the weight of smoothness,
    is found by halving so that the bound is met.  Where even the straight line of best fit keeps the bound, it is the result.
    The first axis is that of the points; y has one more at the end than u, and all others are of many lines.
    """
    h = np.diff(u, axis=0)
    a, c = 1 / h[:-1], 1 / h[1:]
    b = -a - c
    second = lambda v: a[..., None] * v[:-2] + b[..., None] * v[1:-1] + c[..., None] * v[2:]

    def spread(m: np.ndarray) -> np.ndarray:
        out = np.zeros_like(y)
        out[:-2] += a[..., None] * m
        out[1:-1] += b[..., None] * m
        out[2:] += c[..., None] * m
        return out

    q = (a**2 + b**2 + c**2, b[:-1] * a[1:] + c[:-1] * b[1:], c[:-2] * a[2:])
    r = ((h[:-1] + h[1:]) / 3, h[1:-1] / 6)
    bent = second(y)

    def at(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = five_band(r[0] + k * q[0], r[1] + k * q[1], k * q[2], bent)
        return k[..., None] * spread(m), m

    squares = lambda v: (v**2).sum(axis=(0, -1))
    v = u - u.mean(axis=0)
    straight = y.mean(axis=0) + v[..., None] * ((v[..., None] * y).sum(axis=0) / (v**2).sum(axis=0)[..., None])
    line = squares(y - straight) <= bound
    low, high = np.full(u.shape[1:], -30.0), np.full(u.shape[1:], 30.0)  # of log k, in units of the mean step to the third power
    unit = h.mean(axis=0) ** 3
    while (wider := ~line & (high < 60) & (squares(at(unit * np.exp(high))[0]) < bound)).any():
        high = np.where(wider, high + 5, high)
    for _ in range(80):
        mid = (low + high) / 2
        below = squares(at(unit * np.exp(mid))[0]) < bound
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    k = unit * np.exp(low)
    off, m = at(k)
    values, m = y - off, np.pad(m, ((1, 1), *((0, 0),) * (y.ndim - 1)))
    return np.where(line[..., None], straight, values), np.where(line[..., None], 0.0, m), np.where(line, np.inf, k)


def cubic_between(u: np.ndarray, y: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic pieces with values y and second derivatives m at u, at other places."""
    h = np.diff(u)
    k = np.clip(np.searchsorted(u, at, side="right") - 1, 0, len(u) - 2)
    a, b, w = ((u[k + 1] - at) / h[k])[:, None], ((at - u[k]) / h[k])[:, None], (h[k] ** 2 / 6)[:, None]
    return a * y[k] + b * y[k + 1] + w * ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1])


def smoothing_spline(u: np.ndarray, y: np.ndarray, at: np.ndarray, bound: float) -> np.ndarray:
    """spline(u, y, at) that keeps within a bound of squared distances instead of going through the points; 0: through them."""
    if bound <= 0 or len(u) < 4:
        return spline(u, y, at)
    values, m, _ = smoothed(u, y, bound)
    return cubic_between(u, values, m, at)


def even_splines(xy: np.ndarray, path: np.ndarray, distance: float, smoothing: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """path, number, length so far and place of the new points of many lines (see resample_line_spline); path: sorted numbers from 0.

    Lines of one number of points are solved together.
    """
    stays = np.append(True, (np.diff(xy, axis=0) != 0).any(axis=1) | (np.diff(path) != 0))
    xy, path = xy[stays], path[stays]
    first, sizes = np.unique(path, return_index=True, return_counts=True)[1:]
    lines: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        y = xy[first[own] + np.arange(n)[:, None]]
        u = np.concatenate([np.zeros((1, len(own))), np.cumsum(np.hypot(*np.moveaxis(np.diff(y, axis=0), -1, 0)), axis=0)])
        bound = n - np.sqrt(2 * n) if smoothing is None else smoothing
        if n < 4:
            m = None
        elif bound > 0:
            y, m, _ = smoothed(u, y, bound)
        else:
            m = bends(u, y)
        for j, k in enumerate(own):
            lines[k] = (u[:, j], y[:, j], None if m is None else m[:, j])
    new, far, count = [], [], []
    for k in range(len(sizes)):
        u, y, m = lines.pop(k)
        at = np.linspace(0, u[-1], int(np.ceil(u[-1] / distance)) + 1)
        new.append(spline(u, y, at) if m is None else cubic_between(u, y, m, at))
        far.append(np.append(0.0, np.cumsum(np.hypot(*np.diff(new[-1], axis=0).T))))
        count.append(len(at))
    each = np.repeat(np.arange(len(count)), count)
    return each, np.concatenate([np.arange(n, dtype=np.int32) for n in count]), np.concatenate(far), np.concatenate(new)


def resample_line_spline(path: DataFrame, distance: float, smoothing: float | None = 0.0) -> DataFrame:
    """path_id, i, s, x, y at ceil(L / distance) + 1 points of the cubic spline of a path's vertices, even in its parameter.

    The parameter is the length of the polyline; repeated vertices are left out; s is the length along the new points.  A
    path is whole in one batch, and short; many are solved together.  Elevations follow from sample_raster_at_points.

    smoothing bounds the sum of squared distances of the spline from the vertices: 0 goes through them, None is
    n - sqrt(2 n) for n vertices.  A smoothed spline is the one of least bending, straight at both ends; paths of up to
    three vertices are not smoothed.
    """

    def work(c: dict[str, np.ndarray], group: np.ndarray, keys: pa.Array) -> pa.Table:
        each, i, s, new = even_splines(np.stack([c["x"], c["y"]], axis=1).astype(float), group, distance, smoothing)
        return pa.table({"path_id": keys.take(pa.array(each)), "i": i, "s": s, "x": new[:, 0], "y": new[:, 1]})

    return in_groups(path.select("path_id", "i", "x", "y"), "path_id", ["i"], work, f"path_id {path.schema['path_id'].dataType.simpleString()}, i int, s double, x double, y double")


def slope_angle_profile(path: DataFrame) -> DataFrame:
    """path with angle (degrees, positive downwards) of the section before each point; the first takes the second's."""
    angle = F.degrees(F.atan2(-(F.col("z") - F.lag("z").over(own())), F.col("s") - F.lag("s").over(own())))
    out = path.withColumn("angle", angle)
    return out.withColumn("angle", F.coalesce("angle", F.lead("angle").over(own())))


def first_sustained_slope(path: DataFrame, degrees: float, least: float, after: Column | None = None) -> DataFrame:
    """Per path the first point (i, s) whose slope is below `degrees` on a stretch of at least `least` in s.

    after: a column of path (such as the split point's s) beyond which the search begins.
    """
    below = F.coalesce((F.col("angle") < degrees) & ((F.col("s") >= after) if after is not None else F.lit(True)), F.lit(False))
    marked = path.withColumn("_b", below).withColumn("_n", F.row_number().over(own()))
    inside = marked.where("_b").withColumn("_k", F.col("_n") - F.row_number().over(own()))
    runs = inside.groupBy("path_id", "_k").agg(F.min("i").alias("i"), F.min("s").alias("s"), (F.max("s") - F.min("s")).alias("ds"))
    return runs.where(F.col("ds") >= least).groupBy("path_id").agg(F.min(F.struct("i", "s")).alias("k")).select("path_id", "k.i", "k.s")


def quadratic_fit(path: DataFrame) -> DataFrame:
    """path_id, a, b, c of the least-squares parabola z = a s^2 + b s + c, by power sums about the mean of s (for stability)."""
    m = path.withColumn("_u", F.col("s") - F.avg("s").over(whole())).withColumn("_m", F.avg("s").over(whole()))
    u, z = F.col("_u"), F.col("z")
    sums = m.groupBy("path_id").agg(F.first("_m").alias("m"), F.count("*").cast("double").alias("n"), F.sum(u).alias("s1"), F.sum(u**2).alias("s2"), F.sum(u**3).alias("s3"), F.sum(u**4).alias("s4"), F.sum(z).alias("t0"), F.sum(u * z).alias("t1"), F.sum(u**2 * z).alias("t2"))
    n, s1, s2, s3, s4, t0, t1, t2, mean = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2", "m"))
    det = lambda a, b, c, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    full = det(s4, s3, s2, s3, s2, s1, s2, s1, n)
    a, b, c = det(t2, s3, s2, t1, s2, s1, t0, s1, n) / full, det(s4, t2, s2, s3, t1, s1, s2, t0, n) / full, det(s4, s3, t2, s3, s2, t1, s2, s1, t0) / full
    got = sums.where(n >= 3).where(full != 0).select("path_id", "m", a.alias("a"), b.alias("_b"), c.alias("_c"))
    return got.select("path_id", "a", (F.col("_b") - 2 * F.col("a") * F.col("m")).alias("b"), (F.col("a") * F.col("m") ** 2 - F.col("_b") * F.col("m") + F.col("_c")).alias("c"))


# Coefficients of the statistical runout model and the standard deviation of its angle (degrees).
K1, K2, K3, K4, SD = 1.05, -3130.0, 0.0, -2.38, 1.25
LABELS = {"alpha": 0, "alpha_p1": 1, "alpha_m1": -1, "alpha_m2": -2}


def alpha_beta(path: DataFrame, beta_angle: float = 10.0, least: float = 20.0, split: Column | None = None) -> DataFrame:
    """Per path beta (angle from the beta point to the top), the fit's curvature and drop, and alpha with +1, -1 and -2 deviations.

    path: i, s, z, angle, from the top.  The beta point is the first on a sustained slope below beta_angle.
    """
    point = first_sustained_slope(path, beta_angle, least, split).select("path_id", F.col("s").alias("s_beta"), F.col("i").alias("i_beta"))
    top = path.groupBy("path_id").agg(F.min_by("z", "i").alias("z_top"), F.min_by("s", "i").alias("s_top"))
    at = path.join(point, "path_id").where("i = i_beta").select("path_id", "i_beta", "s_beta", F.col("z").alias("z_beta"))
    fit = quadratic_fit(path)
    beta = F.degrees(F.atan2(F.col("z_top") - F.col("z_beta"), F.col("s_beta") - F.col("s_top")))
    all_ = at.join(top, "path_id").join(fit, "path_id").withColumn("beta", beta).withColumn("z2", 2 * F.col("a"))
    h0 = F.when(F.col("a") > 0, F.col("z_top") - (F.col("c") - F.col("b") ** 2 / (4 * F.col("a")))).otherwise(F.col("z_top") - F.col("z_beta"))
    all_ = all_.withColumn("h0", h0).withColumn("alpha", K1 * F.col("beta") + K2 * F.col("z2") + K3 * F.col("h0") + K4)
    return all_.select("path_id", "i_beta", "s_beta", "z_beta", "s_top", "z_top", "beta", "z2", "h0", *[(F.col("alpha") + k * SD).alias(n) for n, k in LABELS.items()])


def alpha_beta_points(path: DataFrame, model: DataFrame) -> DataFrame:
    """path_id, label, angle, i, s, z: where the line from the top under each angle first comes below the profile after the beta point.

    beta's own point is listed too; i is null where a line stays above the profile: out of profile.
    """
    long = model.select("path_id", "i_beta", "s_top", "z_top", *LABELS).unpivot(["path_id", "i_beta", "s_top", "z_top"], list(LABELS), "label", "angle")
    on = long.join(path.select("path_id", "i", "s", "z"), "path_id")
    line = F.col("z_top") - F.tan(F.radians("angle")) * (F.col("s") - F.col("s_top"))
    hit = F.when((F.col("i") >= F.col("i_beta")) & (line <= F.col("z")), F.struct("i", "s", "z"))
    found = on.groupBy("path_id", "label", "angle").agg(F.min(hit).alias("k")).select("path_id", "label", "angle", "k.i", "k.s", "k.z")
    return found.unionByName(model.select("path_id", F.lit("beta").alias("label"), F.col("beta").alias("angle"), F.col("i_beta").alias("i"), F.col("s_beta").alias("s"), F.col("z_beta").alias("z")))


def parabolic_fit(path: DataFrame, near_end: float | None = None) -> DataFrame:
    """path_id, a, b, c of the parabola z = a s^2 + b s + c through both end points (closed form).

    It is the one that fits best in between; with near_end the one that ends with the mean slope angle of the points
    within that distance of the last (path then needs angle, see slope_angle_profile).
    """
    ends = path.groupBy("path_id").agg(F.min_by("s", "i").alias("s0"), F.min_by("z", "i").alias("z0"), F.max_by("s", "i").alias("s1"), F.max_by("z", "i").alias("z1"))
    on = path.join(ends, "path_id").where("s1 > s0")
    long, m = F.col("s1") - F.col("s0"), (F.col("z1") - F.col("z0")) / (F.col("s1") - F.col("s0"))
    if near_end is None:
        line = F.col("z0") + m * (F.col("s") - F.col("s0"))
        bow = (F.col("s") - F.col("s0")) * (F.col("s") - F.col("s1"))
        a = F.try_divide(F.sum(bow * (F.col("z") - line)), F.sum(bow * bow))
    else:
        slope = -F.tan(F.radians(F.avg(F.when(F.col("s1") - F.col("s") < near_end, F.col("angle")))))
        a = (slope - m) / long
    fit = on.groupBy("path_id", "s0", "z0", "s1", "z1").agg(a.alias("a")).where("a is not null")  # null where no point lies between the ends
    return fit.select("path_id", "a", (m - F.col("a") * (F.col("s0") + F.col("s1"))).alias("b"), (F.col("z0") - m * F.col("s0") + F.col("a") * F.col("s0") * F.col("s1")).alias("c"))


def split_point(path: DataFrame, fit: DataFrame, degrees: float, least: float = 0.0) -> DataFrame:
    """Per path the first point at which the fitted parabola's slope is below `degrees` for a stretch."""
    on = path.join(fit.select("path_id", "a", "b"), "path_id").withColumn("angle", F.degrees(F.atan(-(2 * F.col("a") * F.col("s") + F.col("b")))))
    return first_sustained_slope(on.drop("a", "b"), degrees, least)


def extend_path(path: DataFrame, particles: DataFrame, distance: float, top: str = "highest") -> DataFrame:
    """Paths with a point before the first, a particle of the first time step, and one beyond the last.

    top: the highest particle, or by "gain" the one that lies highest over a line through the first point with the path's
    own mean slope.  The lower point lies `distance` further in the mean direction of the last three points; see
    extend_bottom for one that stays in the terrain.
    """
    first = particles.withColumn("_t", F.min("t").over(Window.partitionBy("path_id"))).where("t = _t")
    height = F.col("z")
    if top == "gain":
        ends = along_line_distance(path).groupBy("path_id").agg(*[F.min_by(c, "i").alias(f"_{c}0") for c in ("x", "y", "z")], F.max("s").alias("_l"), F.max_by("z", "i").alias("_z1"))
        first = first.join(ends, "path_id")
        tan = F.coalesce(F.try_divide(F.col("_z0") - F.col("_z1"), F.col("_l")), F.lit(0.0))
        height = F.col("z") - F.col("_z0") - tan * F.sqrt((F.col("x") - F.col("_x0")) ** 2 + (F.col("y") - F.col("_y0")) ** 2)
    first = first.groupBy("path_id").agg(F.max_by(F.struct("x", "y", "z"), F.struct(height.alias("height"), "id")).alias("k"))
    top = first.select("path_id", F.lit(-1).alias("i"), "k.x", "k.y", "k.z")
    n = F.max("i").over(whole())
    last = path.withColumn("_n", n).where("i >= _n - 2").groupBy("path_id").agg(F.max("i").alias("n"), *[f(c, "i").alias(f"{c}{k}") for c in ("x", "y", "z") for k, f in ((0, F.min_by), (1, F.max_by))])
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    long = F.sqrt(dx**2 + dy**2)
    k = F.when(long > 0, distance / long).otherwise(0.0)
    bottom = last.select("path_id", (F.col("n") + 1).alias("i"), *[(F.col(f"{c}1") + k * (F.col(f"{c}1") - F.col(f"{c}0"))).alias(c) for c in ("x", "y", "z")])
    return path.select("path_id", "i", "x", "y", "z").unionByName(top.join(path.select("path_id").distinct(), "path_id", "left_semi")).unionByName(bottom)


def extend_bottom(path: DataFrame, dem: DataFrame, nrows: int, ncols: int, nearest: float, farthest: float, factor: float, halvings: int = 7) -> DataFrame:
    """Paths with a point beyond the last, as far as the terrain goes: path_id, i, x, y, z.

    It lies in the mean direction from the points at a distance between nearest and farthest to the last one, by factor
    times the path's length, or by the largest of 2^halvings equal parts of that at which there still is terrain.  The
    places are tested together, by one join of cells.  A path without such points, or without such a place, stays as it is.
    """
    whole_path = along_line_distance(path)
    ends = whole_path.groupBy("path_id").agg(F.max("i").alias("n"), F.max_by("x", "i").alias("x1"), F.max_by("y", "i").alias("y1"), F.max("s").alias("long"))
    dx, dy = F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    on = path.join(ends, "path_id").withColumns({"dx": dx, "dy": dy, "d": F.sqrt(dx**2 + dy**2)}).where((F.col("d") > nearest) & (F.col("d") < farthest))
    way = on.groupBy("path_id", "n", "x1", "y1", "long").agg(F.sum(F.col("dx") / F.col("d")).alias("u"), F.sum(F.col("dy") / F.col("d")).alias("v")).withColumn("w", F.sqrt(F.col("u") ** 2 + F.col("v") ** 2)).where("w > 0")
    parts = 1 << halvings
    far = F.col("k") * (factor / parts) * F.col("long") / F.col("w")
    places = way.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(parts)))).select("path_id", "n", "k", (F.col("x1") + far * F.col("u")).alias("x"), (F.col("y1") + far * F.col("v")).alias("y"))
    near = corner_weights(places, nrows, ncols).join(dem.select("r", "c", F.col("z").alias("_z")), ["r", "c"])
    inside = near.groupBy("path_id", "n", "k", "x", "y").agg(F.when(F.count("_z") == 4, F.sum(F.col("w") * F.col("_z"))).alias("z")).where("z is not null")
    last = inside.groupBy("path_id", "n").agg(F.max_by(F.struct("x", "y", "z"), "k").alias("p")).select("path_id", (F.col("n") + 1).alias("i"), "p.x", "p.y", "p.z")
    return path.select("path_id", "i", "x", "y", "z").unionByName(last)


def energy_line_test(path: DataFrame, g: float = 9.81) -> DataFrame:
    """Per path the runout angle, the angle of the line through the energy heights z + v^2 / 2g (least squares), and their RMSE about the runout line.

    path: i, s, z, v; needs at least two points.
    """
    ends = path.groupBy("path_id").agg(F.min_by("s", "i").alias("s0"), F.min_by("z", "i").alias("z0"), F.max_by("s", "i").alias("s1"), F.max_by("z", "i").alias("z1"))
    on = path.join(ends, "path_id").withColumn("e", F.col("z") + F.col("v") ** 2 / (2 * g))
    line = F.col("z0") + (F.col("z1") - F.col("z0")) * (F.col("s") - F.col("s0")) / (F.col("s1") - F.col("s0"))
    out = on.where("s1 > s0").groupBy("path_id", "s0", "z0", "s1", "z1").agg(F.regr_slope("e", "s").alias("slope"), F.sqrt(F.avg((F.col("e") - line) ** 2)).alias("rmse"))
    return out.select("path_id", F.degrees(F.atan2(F.col("z0") - F.col("z1"), F.col("s1") - F.col("s0"))).alias("runout_angle"), F.degrees(F.atan(-F.col("slope"))).alias("energy_angle"), "rmse")
