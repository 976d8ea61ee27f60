"""Queries over lines, profiles and the path-following grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.operators import ensemble as E
from flowgrid.operators import grids as G
from flowgrid.operators import profiles as L
from flowgrid.operators import shapes as P
from flowgrid.operators import thalweg as T

from .geometry import NORMALS
from .registry import Inputs, query, rounded

NR, NC = 40, 50
DIST = """d AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d2, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0) AS d3 FROM path WINDOW w AS (PARTITION BY path_id ORDER BY i)),
p AS (SELECT path_id, i, x, y, z, sum(d2) OVER w AS s, sum(d3) OVER w AS s_xyz FROM d WINDOW w AS (PARTITION BY path_id ORDER BY i))"""
ANGLE = f"""{DIST}, a0 AS (SELECT path_id, i, s, z, degrees(atan2(-(z - lag(z) OVER w), s - lag(s) OVER w)) AS angle FROM p WINDOW w AS (PARTITION BY path_id ORDER BY i)), a AS (SELECT path_id, i, s, z, coalesce(angle, lead(angle) OVER (PARTITION BY path_id ORDER BY i)) AS angle FROM a0)"""
SUSTAINED = """m AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY i) AS n FROM {a}), r AS (SELECT path_id, i, s, n - row_number() OVER (PARTITION BY path_id ORDER BY i) AS k FROM m WHERE angle < {deg}),
q AS (SELECT path_id, min(i) AS i, min(s) AS s FROM r GROUP BY path_id, k HAVING max(s) - min(s) >= {least}), f AS (SELECT path_id, min(i) AS i, min(s) AS s FROM q GROUP BY 1)"""


def profile(x: Inputs) -> DataFrame:
    return L.slope_angle_profile(L.along_line_distance(x.path))


@query(f"WITH {DIST} SELECT path_id, i, x, y, z, round(s, 6) AS s, round(s_xyz, 6) AS s_xyz FROM p")
def along_line_distance(x: Inputs) -> DataFrame:
    return rounded(L.along_line_distance(x.path, surface=True), "s", "s_xyz")


@query(f"WITH {DIST}, e AS (SELECT path_id, max(i) AS n, max(s) AS l, max_by(z, i) > min_by(z, i) AS up FROM p GROUP BY 1) SELECT p.path_id, CASE WHEN up THEN n - i ELSE i END AS i, x, y, -z AS z, round(CASE WHEN up THEN l - s ELSE s END, 6) AS s FROM p JOIN e ON p.path_id = e.path_id".replace("max_by(z, i) > min_by(z, i)", "max_by(-z, i) > min_by(-z, i)"))
def orient_profile(x: Inputs) -> DataFrame:
    return rounded(L.orient_profile(L.along_line_distance(x.path.withColumn("z", -F.col("z")))), "s").select("path_id", "i", "x", "y", "z", "s")


@query(f"""WITH {DIST}, e AS (SELECT path_id, max(s) AS l, CAST(ceil(max(s) / 7) AS BIGINT) AS n FROM p GROUP BY 1 HAVING max(s) > 0), k AS (SELECT path_id, l, n, unnest(range(0, n + 1)) AS i FROM e), g AS (SELECT p.*, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, lead(s) OVER w AS s2 FROM p WINDOW w AS (PARTITION BY path_id ORDER BY i)),
m AS (SELECT k.path_id, k.i, k.i * (l / n) AS s, g.s AS s1, g.s2, g.x, g.y, g.z, x2, y2, z2, row_number() OVER (PARTITION BY k.path_id, k.i ORDER BY g.s DESC) AS o FROM k JOIN g ON k.path_id = g.path_id AND g.s2 IS NOT NULL AND g.s <= k.i * (l / n) + 1e-9 AND g.s < l - 1e-9)
SELECT path_id, CAST(i AS INT) AS i, round(s, 6) AS s, round(x + (s - s1) / (s2 - s1) * (x2 - x), 6) AS x, round(y + (s - s1) / (s2 - s1) * (y2 - y), 6) AS y, round(z + (s - s1) / (s2 - s1) * (z2 - z), 6) AS z FROM m WHERE o = 1""")
def resample_line(x: Inputs) -> DataFrame:
    return rounded(L.resample_line(x.path, 7.0), "s", "x", "y", "z")


@query()
def resample_line_spline(x: Inputs) -> DataFrame:
    return rounded(L.resample_line_spline(x.path, 7.0), "s", "x", "y")


@query()
def resample_line_smoothed(x: Inputs) -> DataFrame:
    return rounded(L.resample_line_spline(x.path, 7.0, smoothing=None), "s", "x", "y")


@query(f"WITH {ANGLE} SELECT path_id, i, round(s, 6) AS s, z, round(angle, 6) AS angle FROM a")
def slope_angle_profile(x: Inputs) -> DataFrame:
    return rounded(profile(x).select("path_id", "i", "s", "z", "angle"), "s", "angle")


@query(f"WITH {ANGLE}, {SUSTAINED.format(a='a', deg=70, least=20)} SELECT path_id, i, round(s, 6) AS s FROM f")
def first_sustained_slope(x: Inputs) -> DataFrame:
    return rounded(L.first_sustained_slope(profile(x), 70.0, 20.0), "s")


FIT = """u AS (SELECT path_id, s - avg(s) OVER (PARTITION BY path_id) AS u, avg(s) OVER (PARTITION BY path_id) AS m, z FROM a), k AS (SELECT path_id, any_value(m) AS m, CAST(count(*) AS DOUBLE) AS n, sum(u) AS s1, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(z) AS t0, sum(u * z) AS t1, sum(u * u * z) AS t2 FROM u GROUP BY 1),
g AS (SELECT *, s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2) AS w FROM k), h AS (SELECT path_id, m, (t2 * (s2 * n - s1 * s1) - s3 * (t1 * n - s1 * t0) + s2 * (t1 * s1 - s2 * t0)) / w AS a, (s4 * (t1 * n - s1 * t0) - t2 * (s3 * n - s1 * s2) + s2 * (s3 * t0 - t1 * s2)) / w AS b, (s4 * (s2 * t0 - t1 * s1) - s3 * (s3 * t0 - t1 * s2) + t2 * (s3 * s1 - s2 * s2)) / w AS c FROM g WHERE n >= 3 AND w <> 0),
fit AS (SELECT path_id, a, b - 2 * a * m AS b, a * m * m - b * m + c AS c FROM h)"""
AB = f"""WITH {ANGLE}, {SUSTAINED.format(a='a', deg=70, least=20)}, {FIT}, top AS (SELECT path_id, min_by(z, i) AS z_top, min_by(s, i) AS s_top FROM a GROUP BY 1),
j AS (SELECT f.path_id, f.i AS i_beta, f.s AS s_beta, a.z AS z_beta, s_top, z_top, degrees(atan2(z_top - a.z, f.s - s_top)) AS beta, 2 * fit.a AS z2, CASE WHEN fit.a > 0 THEN z_top - (fit.c - fit.b * fit.b / (4 * fit.a)) ELSE z_top - a.z END AS h0 FROM f JOIN a ON f.path_id = a.path_id AND f.i = a.i JOIN top ON f.path_id = top.path_id JOIN fit ON f.path_id = fit.path_id),
ab AS (SELECT *, 1.05 * beta - 3130.0 * z2 + 0.0 * h0 - 2.38 AS alpha, 1.05 * beta - 3130.0 * z2 + 0.0 * h0 - 2.38 + 1.25 AS alpha_p1, 1.05 * beta - 3130.0 * z2 + 0.0 * h0 - 2.38 - 1.25 AS alpha_m1, 1.05 * beta - 3130.0 * z2 + 0.0 * h0 - 2.38 - 2.5 AS alpha_m2 FROM j)"""


@query(f"{AB} SELECT path_id, i_beta, {', '.join(f'round({c}, 5) AS {c}' for c in ('s_beta', 'z_beta', 's_top', 'z_top', 'beta', 'z2', 'h0', 'alpha', 'alpha_p1', 'alpha_m1', 'alpha_m2'))} FROM ab")
def alpha_beta(x: Inputs) -> DataFrame:
    return rounded(L.alpha_beta(profile(x), 70.0, 20.0), "s_beta", "z_beta", "s_top", "z_top", "beta", "z2", "h0", "alpha", "alpha_p1", "alpha_m1", "alpha_m2", digits=5)


@query(f"""{AB}, l AS (SELECT path_id, i_beta, s_top, z_top, 'alpha' AS label, alpha AS angle FROM ab UNION ALL SELECT path_id, i_beta, s_top, z_top, 'alpha_p1', alpha_p1 FROM ab UNION ALL SELECT path_id, i_beta, s_top, z_top, 'alpha_m1', alpha_m1 FROM ab UNION ALL SELECT path_id, i_beta, s_top, z_top, 'alpha_m2', alpha_m2 FROM ab),
o AS (SELECT l.path_id, label, l.angle, min(a.i) FILTER (WHERE a.i >= i_beta AND z_top - tan(radians(l.angle)) * (a.s - s_top) <= a.z) AS i FROM l JOIN a ON l.path_id = a.path_id GROUP BY 1, 2, 3)
SELECT o.path_id, label, round(o.angle, 5) AS angle, o.i, round(a.s, 5) AS s, round(a.z, 5) AS z FROM o LEFT JOIN a ON o.path_id = a.path_id AND o.i = a.i UNION ALL SELECT path_id, 'beta', round(beta, 5), i_beta, round(s_beta, 5), round(z_beta, 5) FROM ab""")
def alpha_beta_points(x: Inputs) -> DataFrame:
    p = profile(x)
    return rounded(L.alpha_beta_points(p, L.alpha_beta(p, 70.0, 20.0)), "angle", "s", "z", digits=5)


PARABOLA = """ends AS (SELECT path_id, min_by(s, i) AS s0, min_by(z, i) AS z0, max_by(s, i) AS s1, max_by(z, i) AS z1 FROM a GROUP BY 1), bow AS (SELECT a.path_id, s0, z0, s1, z1, sum((s - s0) * (s - s1) * (z - (z0 + (z1 - z0) * (s - s0) / (s1 - s0)))) / sum((s - s0) * (s - s1) * (s - s0) * (s - s1)) AS a FROM a JOIN ends ON a.path_id = ends.path_id WHERE s1 > s0 GROUP BY 1, 2, 3, 4, 5 HAVING sum((s - s0) * (s - s1) * (s - s0) * (s - s1)) > 0),
par AS (SELECT path_id, a, (z1 - z0) / (s1 - s0) - a * (s0 + s1) AS b, z0 - (z1 - z0) / (s1 - s0) * s0 + a * s0 * s1 AS c FROM bow)"""


@query(f"WITH {ANGLE}, {PARABOLA} SELECT path_id, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM par")
def parabolic_fit(x: Inputs) -> DataFrame:
    return rounded(L.parabolic_fit(profile(x)), "a", "b", "c")


@query(f"""WITH {ANGLE}, ends AS (SELECT path_id, min_by(s, i) AS s0, min_by(z, i) AS z0, max_by(s, i) AS s1, max_by(z, i) AS z1 FROM a GROUP BY 1), k AS (SELECT a.path_id, s0, z0, s1, z1, (-tan(radians(avg(angle) FILTER (WHERE s1 - s < 30))) - (z1 - z0) / (s1 - s0)) / (s1 - s0) AS a FROM a JOIN ends ON a.path_id = ends.path_id WHERE s1 > s0 GROUP BY 1, 2, 3, 4, 5)
SELECT path_id, round(a, 6) AS a, round((z1 - z0) / (s1 - s0) - a * (s0 + s1), 6) AS b, round(z0 - (z1 - z0) / (s1 - s0) * s0 + a * s0 * s1, 6) AS c FROM k WHERE a IS NOT NULL""")
def parabolic_fit_end_slope(x: Inputs) -> DataFrame:
    return rounded(L.parabolic_fit(profile(x), near_end=30.0), "a", "b", "c")


@query(f"WITH {ANGLE}, {PARABOLA}, t AS (SELECT a.path_id, i, s, degrees(atan(-(2 * par.a * s + b))) AS angle FROM a JOIN par ON a.path_id = par.path_id), {SUSTAINED.format(a='t', deg=60, least=5)} SELECT path_id, i, round(s, 6) AS s FROM f")
def split_point(x: Inputs) -> DataFrame:
    p = profile(x)
    return rounded(L.split_point(p, L.parabolic_fit(p), 60.0, 5.0), "s")


@query("""WITH pt AS (SELECT 1 + id % 1500 AS path_id, id, t, x, y, z FROM particles), f AS (SELECT *, min(t) OVER (PARTITION BY path_id) AS t0 FROM pt), top AS (SELECT path_id, x, y, z, row_number() OVER (PARTITION BY path_id ORDER BY z DESC, id DESC) AS n FROM f WHERE t = t0),
l AS (SELECT *, max(i) OVER (PARTITION BY path_id) AS n FROM path), e AS (SELECT path_id, max(i) AS n, min_by(x, i) AS x0, max_by(x, i) AS x1, min_by(y, i) AS y0, max_by(y, i) AS y1, min_by(z, i) AS z0, max_by(z, i) AS z1 FROM l WHERE i >= n - 2 GROUP BY 1), b AS (SELECT *, CASE WHEN sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) > 0 THEN 12 / sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) ELSE 0 END AS k FROM e)
SELECT path_id, i, x, y, round(z, 6) AS z FROM path UNION ALL SELECT path_id, -1, x, y, round(z, 6) FROM top WHERE n = 1 AND path_id IN (SELECT path_id FROM path) UNION ALL SELECT path_id, n + 1, round(x1 + k * (x1 - x0), 6), round(y1 + k * (y1 - y0), 6), round(z1 + k * (z1 - z0), 6) FROM b""")
def extend_path(x: Inputs) -> DataFrame:
    particles = x.particles.withColumn("path_id", 1 + F.col("id") % 1500)
    return rounded(L.extend_path(x.path, particles, 12.0), "x", "y", "z")


@query(f"""WITH {DIST}, pt AS (SELECT 1 + id % 1500 AS path_id, id, t, x, y, z FROM particles), f AS (SELECT *, min(t) OVER (PARTITION BY path_id) AS t0 FROM pt), h AS (SELECT path_id, min_by(x, i) AS x0, min_by(y, i) AS y0, min_by(z, i) AS z0, max_by(z, i) AS z1, max(s) AS l FROM p GROUP BY 1),
top AS (SELECT f.path_id, x, y, z, row_number() OVER (PARTITION BY f.path_id ORDER BY z - z0 - CASE WHEN l > 0 THEN (z0 - z1) / l ELSE 0 END * sqrt(pow(x - x0, 2) + pow(y - y0, 2)) DESC, id DESC) AS n FROM f JOIN h ON f.path_id = h.path_id WHERE t = t0)
SELECT path_id, -1 AS i, x, y, z FROM top WHERE n = 1""")
def extend_path_by_gain(x: Inputs) -> DataFrame:
    particles = x.particles.withColumn("path_id", 1 + F.col("id") % 1500)
    return L.extend_path(x.path, particles, 12.0, top="gain").where("i = -1")


@query(f"""WITH sm AS (SELECT path_id, i, x / 8 AS x, y / 8 AS y, z FROM path), {DIST.replace("FROM path WINDOW", "FROM sm WINDOW")}, e AS (SELECT path_id, max(i) AS n, max_by(x, i) AS x1, max_by(y, i) AS y1, max(s) AS l FROM p GROUP BY 1), o AS (SELECT p.path_id, n, x1, y1, l, x1 - x AS dx, y1 - y AS dy, sqrt(pow(x1 - x, 2) + pow(y1 - y, 2)) AS d FROM p JOIN e ON p.path_id = e.path_id),
w AS (SELECT path_id, n, x1, y1, l, sum(dx / d) AS u, sum(dy / d) AS v FROM o WHERE d > 1 AND d < 6 GROUP BY 1, 2, 3, 4, 5), c AS (SELECT path_id, n, k, x1 + k * (0.8 / 32) * l / sqrt(u * u + v * v) * u AS x, y1 + k * (0.8 / 32) * l / sqrt(u * u + v * v) * v AS y FROM w, range(1, 33) r(k) WHERE u * u + v * v > 0),
q AS (SELECT path_id, n, k, x, y, CAST(floor(y) AS INT) + di AS r, CAST(floor(x) AS INT) + dj AS c, (CASE WHEN di = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN dj = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS wt FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS z(di, dj) WHERE x >= 0 AND x < {NC - 1} AND y >= 0 AND y < {NR - 1}),
g AS (SELECT path_id, n, k, x, y, sum(wt * z) AS z FROM q JOIN dem ON q.r = dem.r AND q.c = dem.c GROUP BY 1, 2, 3, 4, 5 HAVING count(z) = 4), b AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY k DESC) AS o FROM g)
SELECT path_id, i, round(x, 6) AS x, round(y, 6) AS y, round(z, 5) AS z FROM sm UNION ALL SELECT path_id, n + 1, round(x, 6), round(y, 6), round(z, 5) FROM b WHERE o = 1""")
def extend_bottom(x: Inputs) -> DataFrame:
    path = x.path.select("path_id", "i", (F.col("x") / 8).alias("x"), (F.col("y") / 8).alias("y"), "z")
    return rounded(rounded(L.extend_bottom(path, x.dem, NR, NC, 1.0, 6.0, 0.8, 5), "x", "y"), "z", digits=5)


@query(f"""WITH {DIST}, e AS (SELECT path_id, min_by(s, i) AS s0, min_by(z, i) AS z0, max_by(s, i) AS s1, max_by(z, i) AS z1 FROM p GROUP BY 1), k AS (SELECT p.path_id, p.s, z + pow(5 + i % 7, 2) / 19.62 AS e, s0, z0, s1, z1 FROM p JOIN e ON p.path_id = e.path_id WHERE s1 > s0)
SELECT path_id, round(degrees(atan2(z0 - z1, s1 - s0)), 6) AS runout_angle, round(degrees(atan(-regr_slope(e, s))), 6) AS energy_angle, round(sqrt(avg(pow(e - (z0 + (z1 - z0) * (s - s0) / (s1 - s0)), 2))), 6) AS rmse FROM k GROUP BY path_id, s0, z0, s1, z1""")
def energy_line_test(x: Inputs) -> DataFrame:
    return rounded(L.energy_line_test(L.along_line_distance(x.path).withColumn("v", (5 + F.col("i") % 7).cast("double"))), "runout_angle", "energy_angle", "rmse")


# ---- the path-following grid ----
WIDTH, STEP, ACROSS = 8.0, 1.0, 9
DOMAIN = f"""dir AS (SELECT *, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM thal WINDOW w AS (PARTITION BY path_id ORDER BY i)),
dom AS (SELECT path_id, i, x, y, z, x - dy / sqrt(dx * dx + dy * dy) * {WIDTH} / 2 AS xl, y + dx / sqrt(dx * dx + dy * dy) * {WIDTH} / 2 AS yl, x + dy / sqrt(dx * dx + dy * dy) * {WIDTH} / 2 AS xr, y - dx / sqrt(dx * dx + dy * dy) * {WIDTH} / 2 AS yr FROM dir)"""
GRID = f"""{DOMAIN}, sec AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(xl) OVER w AS xl2, lead(yl) OVER w AS yl2, lead(xr) OVER w AS xr2, lead(yr) OVER w AS yr2 FROM dom WINDOW w AS (PARTITION BY path_id ORDER BY i)),
len AS (SELECT *, coalesce(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)), 0) AS d, coalesce(greatest(1, CAST(round(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) / {STEP}) AS INT)), 1) AS n FROM sec), cum AS (SELECT *, coalesce(sum(d) OVER w, 0) AS s0, coalesce(sum(n) OVER w, 0) AS f0 FROM len WINDOW w AS (PARTITION BY path_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st AS (SELECT *, unnest(range(0, n)) AS k FROM cum), ln AS (SELECT path_id, CAST(f0 + k AS INT) AS i_s, s0 + k / CAST(n AS DOUBLE) * d AS s, coalesce(xl + k / CAST(n AS DOUBLE) * (xl2 - xl), xl) AS xl, coalesce(yl + k / CAST(n AS DOUBLE) * (yl2 - yl), yl) AS yl, coalesce(xr + k / CAST(n AS DOUBLE) * (xr2 - xr), xr) AS xr, coalesce(yr + k / CAST(n AS DOUBLE) * (yr2 - yr), yr) AS yr FROM st),
g0 AS (SELECT path_id, i_s, CAST(j AS INT) AS i_l, s, -{WIDTH} / 2 + j / {ACROSS - 1}.0 * {WIDTH} AS l, xr + j / {ACROSS - 1}.0 * (xl - xr) AS x, yr + j / {ACROSS - 1}.0 * (yl - yr) AS y FROM ln, range({ACROSS}) b(j)),
sl AS (SELECT a.path_id, a.i_s, a.i_l, a.s, a.l, a.x, a.y, coalesce(abs(a.x * b.y - b.x * a.y + b.x * e.y - e.x * b.y + e.x * f.y - f.x * e.y + f.x * a.y - a.x * f.y) / 2, 0) AS area FROM g0 a LEFT JOIN g0 b ON a.path_id = b.path_id AND a.i_s = b.i_s AND a.i_l + 1 = b.i_l LEFT JOIN g0 f ON a.path_id = f.path_id AND a.i_s + 1 = f.i_s AND a.i_l = f.i_l LEFT JOIN g0 e ON a.path_id = e.path_id AND a.i_s + 1 = e.i_s AND a.i_l + 1 = e.i_l)"""
ON_SL = f"""{GRID}, cor AS (SELECT path_id, i_s, i_l, x, y, CAST(floor(y) AS INT) + di AS kr, CAST(floor(x) AS INT) + dj AS kc, (CASE WHEN di = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN dj = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w, x >= 0 AND x < {NC - 1} AND y >= 0 AND y < {NR - 1} AS ins FROM sl, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(di, dj)),
slc AS (SELECT s.sim_name, s.res_type, path_id, i_s, i_l, CASE WHEN count(v.value) = 4 THEN sum(w * v.value) END AS value FROM (SELECT DISTINCT sim_name, res_type FROM cells_peak) s CROSS JOIN cor LEFT JOIN cells_peak v ON ins AND v.sim_name = s.sim_name AND v.res_type = s.res_type AND v.r = kr AND v.c = kc GROUP BY 1, 2, 3, 4, 5)"""
LIMIT = 45.0
PEAK = "cells_peak AS (SELECT concat('set', CAST(CAST(substr(sim_name, 4) AS BIGINT) % 4 AS STRING)) AS sim_name, 'ppr' AS res_type, r, c, max(value) AS value FROM cells GROUP BY 1, 3, 4)"
CROSS = "crs AS (SELECT sim_name, res_type, v.path_id, v.i_s, max(value) AS v_max, coalesce(sum(area * value) FILTER (WHERE value > 0), 0) / CASE WHEN sum(area) FILTER (WHERE value > 0) > 0 THEN sum(area) FILTER (WHERE value > 0) ELSE 1 END AS v_mean FROM slc v JOIN sl ON v.path_id = sl.path_id AND v.i_s = sl.i_s AND v.i_l = sl.i_l GROUP BY 1, 2, 3, 4)"


def peaks(x: Inputs) -> DataFrame:
    """Rasters of four sets of simulations, so that they have few gaps."""
    name = F.concat(F.lit("set"), (F.substring("sim_name", 4, 9).cast("long") % 4).cast("string"))
    return x.cells.groupBy(name.alias("sim_name"), F.lit("ppr").alias("res_type"), "r", "c").agg(F.max("value").alias("value"))


def grid(x: Inputs) -> DataFrame:
    return T.sl_grid(x.thal, WIDTH, STEP)


def on_sl(x: Inputs) -> tuple[DataFrame, DataFrame]:
    g = grid(x)
    return T.transform_to_sl(peaks(x), g, NR, NC), g


@query(f"WITH {DOMAIN} SELECT path_id, i, x, y, round(z, 6) AS z, round(xl, 6) AS xl, round(yl, 6) AS yl, round(xr, 6) AS xr, round(yr, 6) AS yr FROM dom")
def path_domain(x: Inputs) -> DataFrame:
    return rounded(T.path_domain(x.thal, WIDTH), "z", "xl", "yl", "xr", "yr")


@query(f"WITH {GRID} SELECT path_id, i_s, i_l, {', '.join(f'round({c}, 6) AS {c}' for c in ('s', 'l', 'x', 'y', 'area'))} FROM sl")
def sl_grid(x: Inputs) -> DataFrame:
    return rounded(grid(x), "s", "l", "x", "y", "area")


@query(f"""WITH {NORMALS}, {GRID}, q AS (SELECT path_id, i_s, i_l, CAST(floor(y) AS INT) + di AS r, CAST(floor(x) AS INT) + dj AS c, (CASE WHEN di = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN dj = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM sl, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(di, dj) WHERE x >= 0 AND x < {NC - 1} AND y >= 0 AND y < {NR - 1}),
f AS (SELECT path_id, i_s, i_l, sum(w * n.area) / 25 AS f FROM q JOIN normals n ON q.r = n.r AND q.c = n.c GROUP BY 1, 2, 3 HAVING count(*) = 4) SELECT sl.path_id, sl.i_s, sl.i_l, round(sl.area * f, 6) AS area FROM sl LEFT JOIN f ON sl.path_id = f.path_id AND sl.i_s = f.i_s AND sl.i_l = f.i_l""")
def sl_surface_areas(x: Inputs) -> DataFrame:
    return rounded(T.surface_areas(grid(x), G.surface_normals(x.dem, 5.0), NR, NC, 5.0).select("path_id", "i_s", "i_l", "area"), "area")


@query(f"WITH {PEAK}, {ON_SL} SELECT sim_name, res_type, path_id, i_s, i_l, round(value, 6) AS value FROM slc")
def transform_to_sl(x: Inputs) -> DataFrame:
    return rounded(on_sl(x)[0], "value")


@query(f"WITH {PEAK}, {ON_SL}, {CROSS} SELECT sim_name, res_type, path_id, i_s, round(v_max, 6) AS v_max, round(v_mean, 6) AS v_mean FROM crs")
def cross_section_max_mean(x: Inputs) -> DataFrame:
    return rounded(T.cross_section_max_mean(*on_sl(x)), "v_max", "v_mean")


@query(f"""WITH {PEAK}, {ON_SL}, {CROSS} SELECT res_type, path_id, i_s, count(v_max) AS n, round(avg(v_max), 6) AS mean, round(quantile_cont(v_max, 0.5), 6) AS median, round(quantile_cont(v_max, 0.05), 6) AS low, round(quantile_cont(v_max, 0.95), 6) AS high FROM crs GROUP BY 1, 2, 3""")
def cross_max_stats(x: Inputs) -> DataFrame:
    return rounded(E.cross_max_stats(T.cross_section_max_mean(*on_sl(x))), "mean", "median", "low", "high")


THALWEG = "th AS (SELECT path_id, i_s, s, x, y, 2000 - 12.5 * s AS z FROM sl WHERE i_l = 4)"


def thalweg(g: DataFrame) -> DataFrame:
    return g.where("i_l = 4").select("path_id", "i_s", "s", "x", "y", (2000 - 12.5 * F.col("s")).alias("z"))


@query(f"""WITH {PEAK}, {ON_SL}, {CROSS}, {THALWEG}, h AS (SELECT *, row_number() OVER (PARTITION BY sim_name, path_id ORDER BY i_s DESC, value DESC, i_l) AS n, min(i_s) OVER (PARTITION BY sim_name, path_id) AS i0 FROM slc WHERE value > {LIMIT}),
m AS (SELECT sim_name, path_id, max(i_s) AS i_m FROM crs WHERE v_mean > {LIMIT} GROUP BY 1, 2)
SELECT h.sim_name, res_type, h.path_id, round(b.s, 6) AS s_release, round(a.s, 6) AS s_runout, round(a.l, 6) AS l, round(a.x, 6) AS x, round(a.y, 6) AS y, round(b.z, 6) AS z_release, round(e.z, 6) AS z_runout, round(a.s - b.s, 6) AS delta_s, round(b.z - e.z, 6) AS delta_z,
round(CASE WHEN a.s > b.s THEN degrees(atan((b.z - e.z) / (a.s - b.s))) END, 6) AS runout_angle, round(q.s, 6) AS s_mean, round(q.x, 6) AS x_mean, round(q.y, 6) AS y_mean
FROM h JOIN sl a ON h.path_id = a.path_id AND h.i_s = a.i_s AND h.i_l = a.i_l JOIN th b ON h.path_id = b.path_id AND h.i0 = b.i_s JOIN th e ON h.path_id = e.path_id AND h.i_s = e.i_s LEFT JOIN m ON h.sim_name = m.sim_name AND h.path_id = m.path_id LEFT JOIN th q ON m.path_id = q.path_id AND m.i_m = q.i_s WHERE n = 1""")
def runout(x: Inputs) -> DataFrame:
    cells, g = on_sl(x)
    return rounded(T.runout(cells, g, thalweg(g), LIMIT), "s_release", "s_runout", "l", "x", "y", "z_release", "z_runout", "delta_s", "delta_z", "runout_angle", "s_mean", "x_mean", "y_mean")


LINE = f"lin AS (SELECT sim_name, res_type, h.path_id, h.i_l, h.i_s, s, l, x, y FROM (SELECT sim_name, res_type, path_id, i_l, max(i_s) AS i_s FROM slc WHERE value > {LIMIT} GROUP BY 1, 2, 3, 4) h JOIN sl ON h.path_id = sl.path_id AND h.i_s = sl.i_s AND h.i_l = sl.i_l)"
POINT = "pnt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sim_name, res_type, path_id ORDER BY s DESC, i_l) AS n FROM lin) q WHERE n = 1)"
ON_LINE = "round(s, 6) AS s, round(l, 6) AS l, round(x, 6) AS x, round(y, 6) AS y"


@query(f"WITH {PEAK}, {ON_SL}, {LINE} SELECT sim_name, res_type, path_id, i_l, i_s, {ON_LINE} FROM lin")
def runout_line(x: Inputs) -> DataFrame:
    return rounded(T.runout_line(*on_sl(x), LIMIT), "s", "l", "x", "y")


@query(f"""WITH {PEAK}, {ON_SL}, k AS (SELECT *, row_number() OVER (PARTITION BY sim_name, path_id, i_l ORDER BY value DESC, i_s DESC) AS n FROM slc WHERE value <> 0)
SELECT sim_name, res_type, k.path_id, k.i_l, k.i_s, {ON_LINE} FROM k JOIN sl ON k.path_id = sl.path_id AND k.i_s = sl.i_s AND k.i_l = sl.i_l WHERE n = 1""")
def runout_line_at_maximum(x: Inputs) -> DataFrame:
    return rounded(T.runout_line(*on_sl(x), LIMIT, at_maximum=True), "s", "l", "x", "y")


@query(f"WITH {PEAK}, {ON_SL}, {LINE}, {POINT} SELECT sim_name, res_type, path_id, {ON_LINE} FROM pnt")
def runout_point(x: Inputs) -> DataFrame:
    return rounded(T.runout_point(T.runout_line(*on_sl(x), LIMIT)), "s", "l", "x", "y")


@query(f"WITH {PEAK}, {ON_SL}, {LINE}, {POINT} SELECT a.sim_name, a.res_type, a.path_id, round(b.s - a.s, 6) AS diff_s, round(b.l - a.l, 6) AS diff_l FROM pnt a JOIN pnt b ON a.path_id = b.path_id AND b.sim_name = 'set0'")
def runout_point_diff(x: Inputs) -> DataFrame:
    points = T.runout_point(T.runout_line(*on_sl(x), LIMIT))
    return rounded(T.runout_point_diff(points, points.where("sim_name = 'set0'")), "diff_s", "diff_l")


@query(f"""WITH {PEAK}, {ON_SL}, {LINE}, ref AS (SELECT n.sim_name, path_id, i_l, s AS s_ref FROM (SELECT DISTINCT sim_name FROM lin) n, lin WHERE lin.sim_name = 'set0'), b AS (SELECT coalesce(lin.sim_name, ref.sim_name) AS sim_name, s, s_ref FROM lin FULL JOIN ref ON lin.sim_name = ref.sim_name AND lin.path_id = ref.path_id AND lin.i_l = ref.i_l)
SELECT sim_name, round(sqrt(avg(pow(s - s_ref, 2))), 6) AS rmse, count(s_ref) FILTER (WHERE s IS NOT NULL) AS n_both, count(*) FILTER (WHERE s IS NULL) AS n_sim_missing, count(*) FILTER (WHERE s_ref IS NULL) AS n_ref_missing FROM b GROUP BY 1""")
def runout_line_diff(x: Inputs) -> DataFrame:
    lines = T.runout_line(*on_sl(x), LIMIT)
    return rounded(T.runout_line_diff(lines, lines.where("sim_name = 'set0'")), "rmse")


@query(f"""WITH {PEAK}, {ON_SL}, ref AS (SELECT path_id, i_s, i_l, value > {LIMIT} AS a FROM slc WHERE sim_name = 'set0'), k AS (SELECT v.sim_name, coalesce(a, false) AS a, coalesce(v.value > {LIMIT + 5}, false) AS b, area FROM slc v JOIN sl ON v.path_id = sl.path_id AND v.i_s = sl.i_s AND v.i_l = sl.i_l LEFT JOIN ref ON v.path_id = ref.path_id AND v.i_s = ref.i_s AND v.i_l = ref.i_l WHERE v.i_s >= 10)
SELECT sim_name, {", ".join(f"count(*) FILTER (WHERE {c}) AS {n}, round(coalesce(sum(area) FILTER (WHERE {c}), 0), 6) AS a_{n}" for n, c in (("tp", "a AND b"), ("fp", "NOT a AND b"), ("fn", "a AND NOT b"), ("tn", "NOT a AND NOT b")))} FROM k GROUP BY 1""")
def area_confusion_in_runout(x: Inputs) -> DataFrame:
    cells, g = on_sl(x)
    area = g.where("i_s >= 10").select("path_id", "i_s", "i_l", F.col("area").alias("cell_area"))
    out = E.area_confusion_within(cells.where("sim_name = 'set0'"), cells, area, LIMIT, LIMIT + 5, on=("path_id", "i_s", "i_l"))
    return rounded(out, "a_tp", "a_fp", "a_fn", "a_tn")


EDGES = "e AS (SELECT feature_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM vertices WINDOW w AS (PARTITION BY feature_id ORDER BY seq))"


@query(f"""WITH {GRID}, {EDGES}, cell AS (SELECT CAST(i AS INT) AS r, CAST(j AS INT) AS c FROM range({NR}) a(i), range({NC}) b(j)), ras AS (SELECT DISTINCT r, c FROM (SELECT feature_id, r, c FROM cell, e GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE (y1 > r) <> (y2 > r) AND c < (x2 - x1) * (r - y1) / (y2 - y1) + x1) % 2 = 1) k)
SELECT path_id, i_s, i_l, 1.0 AS value FROM sl JOIN ras ON ras.r = round_even(sl.y, 0) AND ras.c = round_even(sl.x, 0)""")
def reference_features_to_sl(x: Inputs) -> DataFrame:
    return T.reference_features_to_sl(P.cells_of(x.vertices, NR, NC), grid(x))


@query(f"""WITH {PEAK}, {ON_SL}, {CROSS}, th AS (SELECT path_id, i_s, s, 2000 - 12.5 * s AS z FROM sl WHERE i_l = 4), o AS (SELECT crs.*, s, z FROM crs JOIN th ON crs.path_id = th.path_id AND crs.i_s = th.i_s WHERE v_max > {LIMIT}), b AS (SELECT sim_name, path_id, max(m) AS bar_max FROM (SELECT sim_name, path_id, i_s // 5 AS k, avg(v_max) AS m FROM o GROUP BY 1, 2, 3) q GROUP BY 1, 2),
k AS (SELECT sim_name, path_id, min_by(s, i_s) AS s_first, max_by(s, i_s) AS s_last, min_by(z, i_s) AS z_first, min_by(z, i_s) - max_by(z, i_s) AS dz, max_by(s, i_s) - min_by(s, i_s) AS ds, max(z + v_max * v_max / 19.62) AS energy_height FROM o GROUP BY 1, 2)
SELECT k.sim_name, k.path_id, round(s_first, 6) AS s_first, round(s_last, 6) AS s_last, round(dz, 6) AS dz, round(ds, 6) AS ds, round(degrees(atan2(dz, ds)), 6) AS alpha, round(degrees(atan((z_first - b10.z) / nullif(b10.s - s_first, 0))), 6) AS beta, round(bar_max, 6) AS bar_max, round(energy_height, 6) AS energy_height FROM k JOIN b ON k.sim_name = b.sim_name AND k.path_id = b.path_id LEFT JOIN th b10 ON k.path_id = b10.path_id AND b10.i_s = 10""")
def thalweg_velocity_summary(x: Inputs) -> DataFrame:
    cells, g = on_sl(x)
    return rounded(T.thalweg_velocity_summary(T.cross_section_max_mean(cells, g), thalweg(g), LIMIT, 5, 10), "s_first", "s_last", "dz", "ds", "alpha", "beta", "bar_max", "energy_height")


@query(f"""WITH {GRID}, k AS (SELECT p.sim_name, p.t, p.id, sl.path_id, sl.i_s, sl.i_l, row_number() OVER (PARTITION BY p.sim_name, p.t, p.id ORDER BY round(pow(p.x - sl.x, 2) + pow(p.y - sl.y, 2), 9), sl.path_id, sl.i_s, sl.i_l) AS n FROM particles p, sl)
SELECT p.sim_name, p.t, p.id, k.path_id, k.i_s, k.i_l FROM particles p LEFT JOIN k ON p.sim_name = k.sim_name AND p.t = k.t AND p.id = k.id AND n = 1""")
def nearest_sl_for_particles(x: Inputs) -> DataFrame:
    return T.nearest_sl_for_particles(x.particles.select("sim_name", "t", "id", "x", "y"), grid(x)).select("sim_name", "t", "id", "path_id", "i_s", "i_l")
