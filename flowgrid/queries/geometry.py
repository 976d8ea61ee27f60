"""Queries over grids, polygons and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.operators import grids as G
from flowgrid.operators import shapes as P
from flowgrid.sources.rasters import remeshed_raster
from flowgrid.sources.shared import new_path

from .registry import Inputs, query, rounded

NR, NC = 40, 50
MOST = "(SELECT sim_name, r, c, value FROM cells WHERE res_type = 'ppr')"


def ppr(x: Inputs) -> DataFrame:
    return x.cells.where("res_type = 'ppr'").select("sim_name", "r", "c", "value")


def elevation(x: Inputs) -> DataFrame:
    return x.dem.withColumnRenamed("z", "value")


def corners(points: str, cells: str, keys: str = "") -> str:
    """SQL: the same by a join of corner keys."""
    names = "".join(f"q.{k} = v.{k} AND " for k in keys.split())
    return f"""SELECT id, {"".join(f"any_value(q.{k}) AS {k}, " for k in keys.split())}any_value(x) AS x, any_value(y) AS y, CASE WHEN count(v.value) = 4 THEN sum(w * v.value) END AS value
FROM (SELECT p.*, CAST(floor(y) AS INT) + di AS kr, CAST(floor(x) AS INT) + dj AS kc, (CASE WHEN di = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN dj = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w, x >= 0 AND x < {NC - 1} AND y >= 0 AND y < {NR - 1} AS ins
FROM {points} p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(di, dj)) q LEFT JOIN {cells} v ON {names}ins AND q.kr = v.r AND q.kc = v.c GROUP BY id"""


@query(f"""WITH b AS ({corners("(SELECT point_id AS id, x, y FROM points)", "(SELECT r, c, z AS value FROM dem)")}) SELECT id AS point_id, x, y, round(value, 6) AS value, 'bilinear' AS how FROM b
UNION ALL SELECT p.point_id, p.x, p.y, round(v.z, 6), 'nearest' FROM points p LEFT JOIN dem v ON p.x > -0.5 AND p.x < {NC} - 0.5 AND p.y > -0.5 AND p.y < {NR} - 0.5 AND v.r = round_even(p.y, 0) AND v.c = round_even(p.x, 0)""")
def sample_raster_at_points(x: Inputs) -> DataFrame:
    out = [rounded(G.sample_raster_at_points(x.points, elevation(x), NR, NC, method=m), "value").withColumn("how", F.lit(m)) for m in ("bilinear", "nearest")]
    return out[0].unionByName(out[1])


@query(f"""WITH p AS (SELECT concat(s.sim_name, '_', CAST(i AS STRING), '_', CAST(j AS STRING)) AS id, s.sim_name, i, j, 1.0 + j * 2.5 AS x, 0.5 + i * 2.5 AS y FROM (SELECT DISTINCT sim_name FROM {MOST}) s, range(12) a(i), range(16) b(j)), g AS ({corners("p", MOST, "sim_name")})
SELECT p.sim_name, CAST(i AS INT) AS r, CAST(j AS INT) AS c, round(g.value, 6) AS value FROM p JOIN g ON p.id = g.id""")
def resample_to_reference(x: Inputs) -> DataFrame:
    return rounded(G.resample_to_reference(ppr(x), (NR, NC, 0.0, 0.0, 1.0), (12, 16, 1.0, 0.5, 2.5)), "value")


@query("""WITH n AS (SELECT nr.i AS i, nc.j AS j, v.r, v.c, v.z, abs(nr.i * 2.5 - v.r) AS dr, abs(nc.j * 2.5 - v.c) AS dc FROM dem v JOIN range(16) nr(i) ON abs(nr.i * 2.5 - v.r) <= 2 JOIN range(20) nc(j) ON abs(nc.j * 2.5 - v.c) <= 2),
w AS (SELECT i, j, z, (CASE WHEN dr <= 1 THEN 1.5 * dr * dr * dr - 2.5 * dr * dr + 1 WHEN dr < 2 THEN -0.5 * dr * dr * dr + 2.5 * dr * dr - 4 * dr + 2 ELSE 0 END) * (CASE WHEN dc <= 1 THEN 1.5 * dc * dc * dc - 2.5 * dc * dc + 1 WHEN dc < 2 THEN -0.5 * dc * dc * dc + 2.5 * dc * dc - 4 * dc + 2 ELSE 0 END) AS w FROM n)
SELECT CAST(i AS INT) AS r, CAST(j AS INT) AS c, round(sum(w * z) / sum(w), 6) AS value FROM w GROUP BY i, j HAVING sum(w) >= 0.5""")
def remesh(x: Inputs) -> DataFrame:
    return rounded(G.remesh(elevation(x), NR, NC, 1.0, 2.5), "value")


LARGER = """n AS (SELECT nr.i AS i, nc.j AS j, v.r, v.c, v.z, abs(nr.i * 2.5 - v.r) AS dr, abs(nc.j * 2.5 - v.c) AS dc FROM dem v JOIN range(17) nr(i) ON abs(nr.i * 2.5 - v.r) <= 2 JOIN range(21) nc(j) ON abs(nc.j * 2.5 - v.c) <= 2),
w AS (SELECT i, j, z, (CASE WHEN dr <= 1 THEN 1.5 * dr * dr * dr - 2.5 * dr * dr + 1 WHEN dr < 2 THEN -0.5 * dr * dr * dr + 2.5 * dr * dr - 4 * dr + 2 ELSE 0 END) * (CASE WHEN dc <= 1 THEN 1.5 * dc * dc * dc - 2.5 * dc * dc + 1 WHEN dc < 2 THEN -0.5 * dc * dc * dc + 2.5 * dc * dc - 4 * dc + 2 ELSE 0 END) AS w FROM n)"""


@query(f"WITH {LARGER} SELECT CAST(i AS INT) AS r, CAST(j AS INT) AS c, round(sum(w * z) / sum(w), 5) AS value FROM w GROUP BY i, j HAVING sum(w) >= 0.5")
def remesh_larger(x: Inputs) -> DataFrame:
    return rounded(G.remesh(elevation(x), NR, NC, 1.0, 2.5, larger=True), "value", digits=5)


@query(f"WITH {LARGER}, k AS (SELECT i, j, round(sum(w * z) / sum(w), 5) AS value FROM w GROUP BY i, j HAVING sum(w) >= 0.5) SELECT CAST(a.i AS INT) AS r, CAST(b.j AS INT) AS c, k.value, reused FROM range(17) a(i) CROSS JOIN range(21) b(j) CROSS JOIN (VALUES (false), (true)) AS z(reused) LEFT JOIN k ON k.i = a.i AND k.j = b.j")
def remesh_lookup(x: Inputs) -> DataFrame:
    folder = new_path(x.spark, "remeshed")
    out = []
    for size in (2.5, 2.5004):  # the second is within the threshold of the first
        cells, reused = remeshed_raster(elevation(x), (NR, NC, 0.0, 0.0, 1.0), "terrain", size, folder, larger=True)
        out.append(rounded(cells, "value", digits=5).withColumn("reused", F.lit(reused)))
    return out[0].unionByName(out[1])


@query(f"""WITH p AS (SELECT i * {NC} + j AS id, i, j, j * cos(radians(20)) + i * sin(radians(20)) AS x, -j * sin(radians(20)) + i * cos(radians(20)) AS y FROM range({NR}) a(i), range({NC}) b(j)), g AS ({corners("p", "(SELECT r, c, z AS value FROM dem)")})
SELECT CAST(id // {NC} AS INT) AS r, CAST(id % {NC} AS INT) AS c, round(value, 6) AS value FROM g""")
def rotate_raster(x: Inputs) -> DataFrame:
    return rounded(G.rotate_raster(elevation(x), NR, NC, 20.0), "value")


@query(f"""WITH p AS (SELECT concat(s.sim_name, '_', CAST(i * {NC} + j AS STRING)) AS id, s.sim_name, i * {NC} + j AS k, j * cos(radians(d)) + i * sin(radians(d)) AS x, -j * sin(radians(d)) + i * cos(radians(d)) AS y FROM (SELECT DISTINCT sim_name, CAST(substr(sim_name, 4) AS BIGINT) * 3 - 6 AS d FROM {MOST}) s, range({NR}) a(i), range({NC}) b(j)), g AS ({corners("p", MOST, "sim_name")})
SELECT p.sim_name, 'ppr' AS res_type, CAST(k // {NC} AS INT) AS r, CAST(k % {NC} AS INT) AS c, round(g.value, 6) AS value FROM p JOIN g ON p.id = g.id""")
def rotate_results(x: Inputs) -> DataFrame:
    angles = x.sims.select("sim_name", (F.substring("sim_name", 4, 9).cast("double") * 3).alias("degrees"))
    return rounded(G.rotate_results(x.cells.where("res_type = 'ppr'"), angles, NR, NC, 6.0), "value")


NORMALS = """k AS (SELECT r, c, z, lag(z) OVER (PARTITION BY r ORDER BY c) AS w, lead(z) OVER (PARTITION BY r ORDER BY c) AS e, lag(z) OVER (PARTITION BY c ORDER BY r) AS s, lead(z) OVER (PARTITION BY c ORDER BY r) AS n FROM dem),
g AS (SELECT r, c, z, (coalesce(e, z) - coalesce(w, z)) / CASE WHEN e IS NULL OR w IS NULL THEN 1 ELSE 2 END / 5 AS dx, (coalesce(n, z) - coalesce(s, z)) / CASE WHEN n IS NULL OR s IS NULL THEN 1 ELSE 2 END / 5 AS dy FROM k),
normals AS (SELECT r, c, z, -dx / sqrt(dx * dx + dy * dy + 1) AS nx, -dy / sqrt(dx * dx + dy * dy + 1) AS ny, 1 / sqrt(dx * dx + dy * dy + 1) AS nz, 25 * sqrt(dx * dx + dy * dy + 1) AS area, degrees(acos(1 / sqrt(dx * dx + dy * dy + 1))) AS slope FROM g)"""


@query(f"WITH {NORMALS} SELECT r, c, z, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz, round(area, 6) AS area, round(slope, 6) AS slope FROM normals")
def surface_normals(x: Inputs) -> DataFrame:
    return rounded(G.surface_normals(x.dem, 5.0), "nx", "ny", "nz", "area", "slope")


@query(f"WITH {NORMALS} SELECT r, c, round(area, 6) AS area FROM normals")
def cell_area(x: Inputs) -> DataFrame:
    return rounded(G.surface_normals(x.dem, 5.0).select("r", "c", "area"), "area")


@query(f"WITH {NORMALS} SELECT r, c, round(slope, 6) AS slope FROM normals")
def slope_angle(x: Inputs) -> DataFrame:
    return rounded(G.surface_normals(x.dem, 5.0).select("r", "c", "slope"), "slope")


@query(f"WITH {NORMALS} SELECT v.sim_name, v.r, v.c, round(v.value * nz, 6) AS value, round(slope, 6) AS slope FROM {MOST} v JOIN normals n ON v.r = n.r AND v.c = n.c")
def depth_thickness(x: Inputs) -> DataFrame:
    return rounded(G.depth_thickness(ppr(x), G.surface_normals(x.dem, 5.0), "thickness"), "value", "slope")


@query(f"""SELECT CAST(tr AS INT) AS tile_r, CAST(tc AS INT) AS tile_c, CAST(v.r - tr * 12 AS INT) AS r, CAST(v.c - tc * 12 AS INT) AS c, v.r AS gr, v.c AS gc, z, (tr = 0 OR v.r - tr * 12 >= 2) AND (tr = 2 OR v.r - tr * 12 < 14) AND (tc = 0 OR v.c - tc * 12 >= 2) AND (tc = 3 OR v.c - tc * 12 < 14) AS inner
FROM dem v, range(3) a(tr), range(4) b(tc) WHERE v.r >= tr * 12 AND v.r < tr * 12 + 16 AND v.c >= tc * 12 AND v.c < tc * 12 + 16""".replace("AS inner", 'AS "inner"'))
def tile_grid(x: Inputs) -> DataFrame:
    return G.tile_grid(x.dem, NR, NC, 16, 2)


@query("""WITH b AS (SELECT f.grp, min(x) - 3 AS x0, max(x) + 3 AS x1, min(y) - 3 AS y0, max(y) + 3 AS y1 FROM vertices v JOIN features f ON v.feature_id = f.feature_id GROUP BY 1) SELECT b.grp, d.r, d.c, d.z FROM b JOIN dem d ON d.c BETWEEN x0 AND x1 AND d.r BETWEEN y0 AND y1""")
def clip_grid_by_group(x: Inputs) -> DataFrame:
    return G.clip_grid_by_group(x.dem, x.vertices, x.features, 3.0)


@query(f"""WITH {NORMALS}, ch AS (SELECT sim_name, t, r, c, max(value) FILTER (WHERE res_type = 'ppr') / 100 AS a, max(value) FILTER (WHERE res_type = 'pft') / 100 AS b, max(value) FILTER (WHERE res_type = 'pfv') / 100 AS e FROM cells_t GROUP BY 1, 2, 3, 4),
s AS (SELECT *, sum(coalesce(a, 0) + coalesce(b, 0) - coalesce(e, 0)) OVER (PARTITION BY sim_name, r, c ORDER BY t) AS d FROM ch)
SELECT s.sim_name, s.t, s.r, s.c, round(n.z + d / nz, 6) AS z FROM s JOIN normals n ON s.r = n.r AND s.c = n.c""")
def update_surface(x: Inputs) -> DataFrame:
    part = lambda k: F.max(F.when(F.col("res_type") == k, F.col("value") / 100))
    ch = x.cells_t.groupBy("sim_name", "t", "r", "c").agg(part("ppr").alias("stopped"), part("pft").alias("detrained"), part("pfv").alias("entrained"))
    return rounded(G.update_surface(ch, x.dem, G.surface_normals(x.dem, 5.0)), "z")


@query(f"WITH {NORMALS} SELECT v.sim_name, v.res_type, v.r, v.c, round(CASE v.res_type WHEN 'ppr' THEN v.value * 0.001 WHEN 'pft' THEN v.value * 0.001 / n.area ELSE v.value / (200 * n.area) END, 9) AS value FROM cells v LEFT JOIN normals n ON v.r = n.r AND v.c = n.c".replace("v.res_type,", "CASE v.res_type WHEN 'pft' THEN 'pke' WHEN 'pfv' THEN 'FTDet' ELSE 'ppr' END AS res_type,"))
def export_field_units(x: Inputs) -> DataFrame:
    named = x.cells.replace({"pft": "pke", "pfv": "FTDet"}, subset=["res_type"])
    return rounded(G.export_field_units(named, G.surface_normals(x.dem, 5.0)).select("sim_name", "res_type", "r", "c", "value"), "value", digits=9)


@query("SELECT sim_name, res_type, r, c, CASE WHEN value < 10 THEN 0 ELSE value END AS value FROM cells")
def fill_nodata(x: Inputs) -> DataFrame:
    return G.fill_nodata(x.cells.withColumn("value", F.when(F.col("value") >= 10, F.col("value"))))


@query("""WITH p AS (SELECT s_suppkey AS k, CAST(s_suppkey % 40 AS DOUBLE) AS x, CAST(s_suppkey % 30 AS DOUBLE) AS y, 1500.0 - s_suppkey AS z, 30.0 + s_suppkey % 9 AS dip, CAST(s_suppkey * 10 % 360 AS DOUBLE) AS azimuth FROM supplier),
t AS (SELECT d.r, d.c, d.z AS ground, max(p.z - ((d.c - p.x) * sin(radians(azimuth)) + (d.r - p.y) * cos(radians(azimuth))) * tan(radians(dip))) AS plane FROM dem d, p GROUP BY 1, 2, 3) SELECT r, c, round(least(ground, plane), 6) AS scarp, round(ground - least(ground, plane), 6) AS release FROM t""")
def scarp_surface(x: Inputs) -> DataFrame:
    k = F.col("s_suppkey")
    planes = x.supplier.select((k % 40).cast("double").alias("x"), (k % 30).cast("double").alias("y"), (1500.0 - k).alias("z"), (30.0 + k % 9).alias("dip"), (k * 10 % 360).cast("double").alias("azimuth"))
    return rounded(G.scarp_surface(x.dem, planes), "scarp", "release")


@query("""WITH p AS (SELECT CAST(s_suppkey * 7 % 50 AS DOUBLE) AS x, CAST(s_suppkey * 3 % 40 AS DOUBLE) AS y, 20.0 + s_suppkey % 11 AS depth, 4.0 + s_suppkey % 5 AS a, 6.0 + s_suppkey % 4 AS b, CAST(s_suppkey % 8 AS DOUBLE) AS tilt, radians(CAST(s_suppkey * 10 % 360 AS DOUBLE)) AS azimuth FROM supplier),
k AS (SELECT r, c, d.z AS ground, depth, tilt, (d.c - x) * sin(azimuth) + (d.r - y) * cos(azimuth) AS along, 1 - pow(((d.c - x) * cos(azimuth) - (d.r - y) * sin(azimuth)) / a, 2) - pow(((d.c - x) * sin(azimuth) + (d.r - y) * cos(azimuth)) / b, 2) AS inside FROM dem d, p),
t AS (SELECT r, c, ground, least(ground, coalesce(min(CASE WHEN inside > 0 THEN ground - depth * sqrt(CASE WHEN inside > 0 THEN inside ELSE 0 END) - along * tan(radians(tilt)) END), ground)) AS scarp FROM k GROUP BY 1, 2, 3) SELECT r, c, round(scarp, 6) AS scarp, round(ground - scarp, 6) AS release FROM t""")
def scarp_ellipsoids(x: Inputs) -> DataFrame:
    k = F.col("s_suppkey")
    forms = x.supplier.select((k * 7 % 50).cast("double").alias("x"), (k * 3 % 40).cast("double").alias("y"), (20.0 + k % 11).alias("depth"), (4.0 + k % 5).alias("a"), (6.0 + k % 4).alias("b"), (k % 8).cast("double").alias("tilt"), (k * 10 % 360).cast("double").alias("azimuth"))
    return rounded(G.scarp_surface(x.dem, forms, form="ellipsoid"), "scarp", "release")


@query("""WITH b AS (SELECT a.r, a.c, a.z AS sw, b.z AS se, d.z AS nw, e.z AS ne FROM dem a JOIN dem b ON a.r = b.r AND a.c + 1 = b.c JOIN dem d ON a.r + 1 = d.r AND a.c = d.c JOIN dem e ON a.r + 1 = e.r AND a.c + 1 = e.c),
k AS (SELECT r, c, list_filter([CASE WHEN (sw > 1501.3) <> (se > 1501.3) THEN {'x': c + (1501.3 - sw) / (se - sw), 'y': CAST(r AS DOUBLE)} END, CASE WHEN (se > 1501.3) <> (ne > 1501.3) THEN {'x': CAST(c + 1 AS DOUBLE), 'y': r + (1501.3 - se) / (ne - se)} END,
CASE WHEN (nw > 1501.3) <> (ne > 1501.3) THEN {'x': c + (1501.3 - nw) / (ne - nw), 'y': CAST(r + 1 AS DOUBLE)} END, CASE WHEN (sw > 1501.3) <> (nw > 1501.3) THEN {'x': CAST(c AS DOUBLE), 'y': r + (1501.3 - sw) / (nw - sw)} END], lambda e: e IS NOT NULL) AS k FROM b),
p AS (SELECT r, c, k, unnest(range(0, len(k) - 1, 2)) AS i FROM k WHERE len(k) >= 2) SELECT r, c, round(k[i + 1].x, 6) AS x1, round(k[i + 1].y, 6) AS y1, round(k[i + 2].x, 6) AS x2, round(k[i + 2].y, 6) AS y2 FROM p""")
def contour_segments(x: Inputs) -> DataFrame:
    return rounded(G.contour_segments(elevation(x), 1501.3), "x1", "y1", "x2", "y2")


@query(f"""WITH l AS (SELECT path_id, i, x / 4 AS x, y / 4 AS y FROM path), q AS (SELECT path_id, i, CAST(floor(y) AS INT) + di AS r, CAST(floor(x) AS INT) + dj AS c, (CASE WHEN di = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN dj = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM l, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(di, dj) WHERE x >= 0 AND x < {NC - 1} AND y >= 0 AND y < {NR - 1}),
m AS {MOST}, g AS (SELECT path_id, i, CASE WHEN count(z) = 4 THEN sum(w * z) END AS z FROM q JOIN dem ON q.r = dem.r AND q.c = dem.c GROUP BY 1, 2), v AS (SELECT sim_name, path_id, i, CASE WHEN count(value) = 4 THEN sum(w * value) END AS value FROM q JOIN m ON q.r = m.r AND q.c = m.c GROUP BY 1, 2, 3)
SELECT s.sim_name, l.path_id, l.i, l.x, l.y, round(g.z, 9) AS z, round(v.value, 9) AS value, round(g.z + coalesce(v.value, 0), 9) AS surface FROM (SELECT DISTINCT sim_name FROM m) s CROSS JOIN l LEFT JOIN g ON l.path_id = g.path_id AND l.i = g.i LEFT JOIN v ON s.sim_name = v.sim_name AND l.path_id = v.path_id AND l.i = v.i""")
def profile_at_line(x: Inputs) -> DataFrame:
    line = x.path.select("path_id", "i", (F.col("x") / 4).alias("x"), (F.col("y") / 4).alias("y"))
    return G.profile_at_line(line, ppr(x), x.dem, NR, NC, digits=9)


def triangle_sql(n: int) -> str:
    """SQL: normals by n triangles, from nine self joins."""
    z = lambda i, j: f"z{i + 1}{j + 1}"
    if n == 1:
        pairs = [((1, 1), (1, -1), f"({z(max(i, 0), max(j, 0))} - {z(min(i, 0), min(j, 0))})", f"({z(max(i, 0), min(j, 0))} - {z(min(i, 0), max(j, 0))})") for i, j in ((1, 1), (1, -1), (-1, -1), (-1, 1))]
    else:
        ring = G.AROUND[n]
        pairs = [(a, b, f"({z(*a)} - {z(0, 0)})", f"({z(*b)} - {z(0, 0)})") for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    up = " + ".join(f"CASE WHEN {p} + {q} IS NULL THEN 0 ELSE {5.0 * (a[1] * b[0] - a[0] * b[1])} END" for a, b, p, q in pairs)
    gr = " + ".join(f"coalesce({a[0]} * {q} - {b[0]} * {p}, 0)" for a, b, p, q in pairs)
    gc = " + ".join(f"coalesce({b[1]} * {p} - {a[1]} * {q}, 0)" for a, b, p, q in pairs)
    near = "".join(f", d{i + 1}{j + 1}.z AS {z(i, j)}" for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0))
    joins = " ".join(f"LEFT JOIN dem d{i + 1}{j + 1} ON d{i + 1}{j + 1}.r = o.r + {i} AND d{i + 1}{j + 1}.c = o.c + {j}" for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0))
    return f"SELECT {n} AS triangles, r, c, CASE WHEN u > 0 THEN u ELSE 1 END AS u, a, b FROM (SELECT r, c, {up} AS u, {gr} AS a, {gc} AS b FROM (SELECT o.r, o.c, o.z AS z11{near} FROM dem o {joins}) t) t"


@query(f"WITH t AS ({' UNION ALL '.join(triangle_sql(n) for n in (1, 4, 6, 8))}), n AS (SELECT *, sqrt(a * a + b * b + u * u) AS n FROM t) SELECT triangles, r, c, round(a / n, 6) AS nx, round(b / n, 6) AS ny, round(u / n, 6) AS nz, round(25 * n / u, 6) AS area, round(degrees(acos(u / n)), 5) AS slope FROM n")
def surface_normals_by_triangles(x: Inputs) -> DataFrame:
    out = None
    for n in (1, 4, 6, 8):
        one = G.triangle_normals(x.dem, 5.0, n).select(F.lit(n).alias("triangles"), "r", "c", "nx", "ny", "nz", "area", "slope")
        out = one if out is None else out.union(one)
    return rounded(rounded(out, "nx", "ny", "nz", "area"), "slope", digits=5)


# ---- shapes ----
SHOELACE = "s AS (SELECT feature_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM vertices WINDOW w AS (PARTITION BY feature_id ORDER BY seq))"
INSIDE = "(y1 > {y}) <> (y2 > {y}) AND {x} < (x2 - x1) * ({y} - y1) / (y2 - y1) + x1"
EDGES = "e AS (SELECT feature_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM vertices WINDOW w AS (PARTITION BY feature_id ORDER BY seq))"
IN_CELL = f"{EDGES}, cell AS (SELECT CAST(i AS INT) AS r, CAST(j AS INT) AS c FROM range({NR}) a(i), range({NC}) b(j)), ras AS (SELECT feature_id, r, c FROM cell, e GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE {INSIDE.format(x='c', y='r')}) % 2 = 1)"


@query(f"WITH {SHOELACE} SELECT feature_id, round(sum(x * y2 - x2 * y) / 2, 6) AS signed_area, round(abs(sum(x * y2 - x2 * y) / 2), 6) AS area FROM s GROUP BY 1")
def polygon_area(x: Inputs) -> DataFrame:
    return rounded(P.polygon_area(x.vertices), "signed_area", "area")


@query(f"WITH {EDGES} SELECT point_id, any_value(x) AS x, any_value(y) AS y, feature_id FROM points, e GROUP BY point_id, feature_id HAVING count(*) FILTER (WHERE {INSIDE.format(x='x', y='y')}) % 2 = 1")
def point_in_polygon(x: Inputs) -> DataFrame:
    return P.point_in_polygon(x.points, x.vertices)


@query(f"""WITH {EDGES}, d AS (SELECT id, sim_name, t, feature_id, count(*) FILTER (WHERE {INSIDE.format(x='x', y='y')}) % 2 = 1 AS ins, min(sqrt(pow(x - x1 - k * (x2 - x1), 2) + pow(y - y1 - k * (y2 - y1), 2))) AS d FROM (SELECT p.*, e.*, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS k FROM particles p, e) q GROUP BY 1, 2, 3, 4)
SELECT DISTINCT sim_name, t, id FROM d WHERE ins OR d <= 0.3""")
def particles_in_release(x: Inputs) -> DataFrame:
    return P.particles_in_release(x.particles.select("sim_name", "t", "id", "x", "y", "m"), x.vertices, 0.3).select("sim_name", "t", "id")


@query(f"WITH {IN_CELL} SELECT r, c, max(coalesce(thickness, 1)) AS value, CAST(count(*) AS INT) AS n FROM ras JOIN features f ON ras.feature_id = f.feature_id GROUP BY 1, 2")
def rasterize_polygon(x: Inputs) -> DataFrame:
    return P.rasterize_polygon(x.vertices, x.features, NR, NC)


@query(f"WITH {IN_CELL} SELECT v.sim_name, v.r, v.c, CASE WHEN k.r IS NOT NULL THEN 0 ELSE v.value END AS value FROM {MOST} v LEFT JOIN (SELECT DISTINCT r, c FROM ras) k ON v.r = k.r AND v.c = k.c")
def crop_overlap(x: Inputs) -> DataFrame:
    return P.crop_overlap(ppr(x), P.rasterize_polygon(x.vertices, x.features, NR, NC))


@query(f"""WITH s AS (SELECT path_id, x / 8 AS x1, y / 8 AS y1, lead(x / 8) OVER w AS x2, lead(y / 8) OVER w AS y2 FROM path WINDOW w AS (PARTITION BY path_id ORDER BY i))
SELECT DISTINCT path_id, CAST(i AS INT) AS r, CAST(j AS INT) AS c FROM (SELECT s.*, i, j, greatest(0.0, least(1.0, ((j - x1) * (x2 - x1) + (i - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS k FROM s, range({NR}) a(i), range({NC}) b(j) WHERE x2 IS NOT NULL AND j BETWEEN least(x1, x2) - 2 AND greatest(x1, x2) + 2 AND i BETWEEN least(y1, y2) - 2 AND greatest(y1, y2) + 2) q WHERE sqrt(pow(j - x1 - k * (x2 - x1), 2) + pow(i - y1 - k * (y2 - y1), 2)) <= 1.4""")
def rasterize_line(x: Inputs) -> DataFrame:
    line = x.path.select("path_id", "i", (F.col("x") / 8).alias("x"), (F.col("y") / 8).alias("y"))
    return P.rasterize_line(line, NR, NC, 1.4, "path_id", "i")


CROSSED = f"""s AS (SELECT path_id, x / 8 AS x1, y / 8 AS y1, lead(x / 8) OVER w - x / 8 AS dx, lead(y / 8) OVER w - y / 8 AS dy FROM path WINDOW w AS (PARTITION BY path_id ORDER BY i)),
k AS (SELECT path_id, CAST(i AS INT) AS r, CAST(j AS INT) AS c, greatest(0.0, (j - 0.5 - x1) / dx, (i - 0.5 - y1) / dy) AS t0, least(1.0, (j + 0.5 - x1) / dx, (i + 0.5 - y1) / dy) AS t1 FROM s, range({NR}) a(i), range({NC}) b(j) WHERE dx > 0 AND dy > 0 AND j BETWEEN x1 - 1 AND x1 + dx + 1 AND i BETWEEN y1 - 1 AND y1 + dy + 1), crossed AS (SELECT DISTINCT path_id, r, c FROM k WHERE t1 - t0 > 1e-12)"""


@query(f"WITH {CROSSED} SELECT path_id, r, c FROM crossed")
def rasterize_line_crossed(x: Inputs) -> DataFrame:
    line = x.path.select("path_id", "i", (F.col("x") / 8).alias("x"), (F.col("y") / 8).alias("y"))
    return P.rasterize_line(line, NR, NC, None, "path_id", "i")


@query(f"WITH {CROSSED} SELECT DISTINCT path_id, CAST(r + di AS INT) AS r, CAST(c + dj AS INT) AS c FROM crossed, range(-1, 2) a(di), range(-1, 2) b(dj) WHERE r + di BETWEEN 0 AND {NR - 1} AND c + dj BETWEEN 0 AND {NC - 1}")
def rasterize_line_neighbours(x: Inputs) -> DataFrame:
    line = x.path.select("path_id", "i", (F.col("x") / 8).alias("x"), (F.col("y") / 8).alias("y"))
    return P.rasterize_line(line, NR, NC, None, "path_id", "i", rings=1)


@query("""WITH b AS (SELECT p.point_id, p.x, p.y, l.path_id, l.i, sqrt(pow(p.x - l.x, 2) + pow(p.y - l.y, 2)) AS d, row_number() OVER (PARTITION BY p.point_id ORDER BY sqrt(pow(p.x - l.x, 2) + pow(p.y - l.y, 2)), l.i) AS n FROM points p JOIN path l ON l.path_id = 1 + p.point_id % 149) SELECT point_id, x, y, path_id, i, round(d, 6) AS distance FROM b WHERE n = 1""")
def snap_points_to_line(x: Inputs) -> DataFrame:
    points = x.points.withColumn("path_id", 1 + F.col("point_id") % 149)
    return rounded(P.snap_points_to_line(points, x.path), "distance")


@query(f"WITH {IN_CELL}, {NORMALS} SELECT feature_id, max(z) AS z_max, round(avg(z), 6) AS z_mean, min(z) AS z_min, round(avg(slope), 6) AS slope, CAST(count(*) AS DOUBLE) AS projected_area, round(sum(area), 6) AS actual_area FROM ras JOIN normals n ON ras.r = n.r AND ras.c = n.c GROUP BY 1")
def release_stats(x: Inputs) -> DataFrame:
    return rounded(P.release_stats(P.cells_of(x.vertices, NR, NC), G.surface_normals(x.dem, 5.0)), "z_mean", "slope", "actual_area")


VOLUME = f"WITH {IN_CELL}, {NORMALS}, vol AS (SELECT ras.feature_id, sum(coalesce(thickness, 1) * area) AS volume FROM ras JOIN normals n ON ras.r = n.r AND ras.c = n.c JOIN features f ON ras.feature_id = f.feature_id GROUP BY 1)"


def volume(x: Inputs) -> DataFrame:
    return P.release_volume(P.cells_of(x.vertices, NR, NC), G.surface_normals(x.dem, 5.0), x.features)


@query(f"{VOLUME} SELECT feature_id, round(volume, 6) AS volume FROM vol")
def release_volume(x: Inputs) -> DataFrame:
    return rounded(volume(x), "volume")


@query(f"{VOLUME} SELECT feature_id, round(volume, 6) AS volume, CASE WHEN volume < 1500 THEN 'S' WHEN volume <= 3500 THEN 'M' ELSE 'L' END AS size FROM vol")
def volume_class(x: Inputs) -> DataFrame:
    return rounded(P.volume_class(volume(x), 1500.0, 3500.0), "volume")


@query("SELECT scenario, coalesce(max(thickness), 0.9) AS thickness FROM features GROUP BY 1")
def max_release_thickness(x: Inputs) -> DataFrame:
    return P.max_release_thickness(x.features, 0.9)


@query("""WITH k AS (SELECT v.feature_id, f.grp, avg(x) AS cx, avg(y) AS cy FROM vertices v JOIN features f ON v.feature_id = f.feature_id WHERE grp <> '' GROUP BY 1, 2)
SELECT a.grp, a.feature_id FROM k a WHERE (SELECT count(*) FROM k b WHERE a.grp = b.grp) > 1 AND NOT EXISTS (SELECT 1 FROM k b WHERE a.grp = b.grp AND a.feature_id <> b.feature_id AND abs(a.cx - b.cx) <= 10 AND abs(a.cy - b.cy) <= 10)""")
def feature_isolation(x: Inputs) -> DataFrame:
    return P.feature_isolation(x.vertices, x.features, 5.0)


@query("""WITH o AS (SELECT feature_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM vertices GROUP BY 1), b AS (SELECT concat('n', CAST(n_nationkey AS STRING)) AS name, n_nationkey * 1.5 AS x0, n_nationkey * 1.5 + 6 AS x1, CAST(n_nationkey AS DOUBLE) AS y0, n_nationkey + 9.0 AS y1 FROM nation)
SELECT name, feature_id, greatest(o.x0, b.x0) AS x_min, least(o.x1, b.x1) AS x_max, greatest(o.y0, b.y0) AS y_min, least(o.y1, b.y1) AS y_max FROM o JOIN b ON o.x0 <= b.x1 AND b.x0 <= o.x1 AND o.y0 <= b.y1 AND b.y0 <= o.y1""")
def features_in_extent(x: Inputs) -> DataFrame:
    k = F.col("n_nationkey")
    boxes = x.nation.select(F.concat(F.lit("n"), k.cast("string")).alias("name"), (k * 1.5).alias("x_min"), (k * 1.5 + 6).alias("x_max"), k.cast("double").alias("y_min"), (k + 9.0).alias("y_max"))
    return P.features_in_extent(x.vertices, boxes)
