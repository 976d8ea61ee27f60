"""Small literal cases: known results, boundary cells, ties, invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgrid.functions import vectors
from flowgrid.operators import ensemble, grids, particles, profiles, sampling, shapes, simulations, thalweg
from flowgrid.sources import rasters


def cells(spark, grid, sim="s", res="ppr"):
    """Rows of a grid given from north to south."""
    n = len(grid)
    return spark.createDataFrame([(sim, res, n - 1 - i, j, float(v)) for i, row in enumerate(grid) for j, v in enumerate(row) if v is not None], "sim_name string, res_type string, r int, c int, value double")


A, B = [[0, 1, 0], [0, 2, 2], [0, 4, 1]], [[0, 10, 0], [2, 2, 1], [1, 4, 1]]


def test_field_stats_masked_by_itself(spark):
    both = cells(spark, A, "a").unionByName(cells(spark, B, "b"))
    got = {r.sim_name: (r.v_max, r.v_mean, r.v_min) for r in ensemble.field_stats(both, mask_type="ppr").collect()}
    assert got == {"a": (4.0, 2.0, 1.0), "b": (10.0, 3.0, 1.0)}


def test_probability_is_strict_and_counts_missing_cells(spark):
    both = cells(spark, [[1, None], [2, 0]], "a").unionByName(cells(spark, [[2, 3], [1, 0]], "b"))
    got = {(r.r, r.c): r.probability for r in ensemble.exceedance_probability(both, 1.0, grid=both).collect()}
    assert got == {(1, 0): 0.5, (1, 1): 0.5, (0, 0): 0.5, (0, 1): 0.0}


def test_area_confusion_of_equal_rasters(spark):
    a = cells(spark, A)
    got = ensemble.area_confusion(a, a, 0.9, 0.9).first()
    assert (got.tp, got.fp, got.fn) == (5, 0, 0)


def test_error_norms(spark):
    pairs = spark.createDataFrame([(1, float(i), float(i + 2)) for i in range(6)], "k int, a double, b double")
    got = ensemble.error_norms(pairs, ("k",), 2.0, 0.5).first()
    assert math.isclose(got.l2, math.sqrt(4 / 0.5 * 24)) and got.l_max == 2.0 and math.isclose(got.l_max_rel, 0.4)


def test_bilinear_and_nearest_edges(spark):
    z = [[float(10 * r + c) for c in range(4)] for r in (2, 1, 0)]
    grid = cells(spark, z)
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.999, 1.999), (2, 3.0, 1.0), (3, 1.5, 0.5), (4, -0.4, 0.0), (5, 2.5, 1.5), (6, -0.5, 0.0)], "id int, x double, y double")
    smooth = {r.id: r.value for r in grids.sample_raster_at_points(points, grid, 3, 4).collect()}
    assert smooth[0] == 0.0 and smooth[2] is None and smooth[4] is None and math.isclose(smooth[3], 6.5) and math.isclose(smooth[1], 22.989)
    near = {r.id: r.value for r in grids.sample_raster_at_points(points, grid, 3, 4, method="nearest").collect()}
    assert near[4] == 0.0 and near[6] is None and near[5] == 22.0  # 2.5 and 1.5 go to the even 2


def test_rotate_by_nothing_keeps_inner_cells(spark):
    a = cells(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    got = {(r.r, r.c): r.value for r in grids.rotate_raster(a, 3, 3, 0.0).collect()}
    assert got[0, 0] == 7.0 and got[1, 1] == 5.0 and got[2, 2] is None


def test_merge_of_tiles_is_the_grid(spark):
    a = cells(spark, [[i * 30 + j for j in range(30)] for i in range(23)])
    tiles = grids.tile_grid(a, 23, 30, 8, 2)
    back = {(r.gr, r.gc): r.value for r in ensemble.merge_tiles(tiles, "max").collect()}
    assert back == {(r.r, r.c): r.value for r in a.collect()}
    assert {(r.gr, r.gc) for r in tiles.where("inner").collect()} == set(back)  # each cell is inner somewhere


def test_merge_tiles_sentinel(spark):
    rows = spark.createDataFrame([(0, 0, -9999.0), (0, 0, 3.0), (0, 0, 2.0), (0, 1, -9999.0)], "gr int, gc int, value double")
    assert {(r.gr, r.gc): r.value for r in ensemble.merge_tiles(rows, "min").collect()} == {(0, 0): 2.0, (0, 1): -9999.0}


def test_remesh_keeps_a_plane(spark):
    a = cells(spark, [[2.0 * c + 3.0 * r for c in range(12)] for r in range(10, -1, -1)])
    got = grids.remesh(a, 11, 12, 1.0, 1.5).where("r between 2 and 4 and c between 2 and 4").collect()
    assert got and all(math.isclose(r.value, 2.0 * r.c * 1.5 + 3.0 * r.r * 1.5) for r in got)


def test_normals_of_an_inclined_plane(spark):
    dem = spark.createDataFrame([(r, c, -0.75 * c) for r in range(4) for c in range(5)], "r int, c int, z double")
    for r in grids.surface_normals(dem).collect():
        assert math.isclose(r.nz, 0.8) and math.isclose(r.nx, 0.6) and abs(r.ny) < 1e-12 and math.isclose(r.area, 1.25)


def square(k, x, y, d):
    return [(k, i, float(x + a * d), float(y + b * d)) for i, (a, b) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]


def test_polygons_against_a_plain_loop(spark):
    rng = random.Random(4)
    rings = {k: [(20 + rng.uniform(3, 15) * math.cos(t), 20 + rng.uniform(3, 15) * math.sin(t)) for t in [i * 0.7 for i in range(9)]] for k in range(5)}
    vertices = spark.createDataFrame([(k, i, x, y) for k, ring in rings.items() for i, (x, y) in enumerate(ring)], "feature_id long, seq int, x double, y double")
    points = [(i, rng.uniform(0, 40), rng.uniform(0, 40)) for i in range(400)]

    def inside(x, y, ring):
        return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1

    got = {(r.id, r.feature_id) for r in shapes.point_in_polygon(spark.createDataFrame(points, "id long, x double, y double"), vertices).collect()}
    assert got == {(i, k) for i, x, y in points for k, ring in rings.items() if inside(x, y, ring)}


def test_polygon_area_and_overlap(spark):
    vertices = spark.createDataFrame(square(1, 0.5, 0.5, 4) + square(2, 2.5, 2.5, 4), "feature_id long, seq int, x double, y double")
    assert {r.signed_area for r in shapes.polygon_area(vertices).collect()} == {16.0}
    features = spark.createDataFrame([(1, 1.0, 1), (2, 3.0, 2)], "feature_id long, thickness double, ord int")
    got = {(r.r, r.c): (r.value, r.n) for r in shapes.rasterize_polygon(vertices, features, 10, 10, average=True).collect()}
    assert len(got) == 28 and got[3, 3] == (2.0, 2) and got[1, 1] == (1.0, 1)


def test_line_cells(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 1.0)], "feature_id long, seq int, x double, y double")
    got = {(r.r, r.c) for r in shapes.rasterize_line(line, 5, 5).collect()}
    assert got == {(0, 0), (0, 1), (1, 2), (1, 3)} or got == {(0, 0), (0, 1), (1, 1), (1, 2), (1, 3)}


def test_along_line_and_resample(spark):
    path = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0), (1, 1, 3.0, 4.0, 5.0), (1, 2, 3.0, 4.0, 5.0), (1, 3, 3.0, 10.0, 0.0)], "path_id long, i int, x double, y double, z double")
    assert [r.s for r in profiles.along_line_distance(path).orderBy("i").collect()] == [0.0, 5.0, 5.0, 11.0]
    got = profiles.resample_line(path, 3.0).orderBy("i").collect()
    assert len(got) == 5 and got[0].s == 0.0 and got[-1].s == 11.0 and (got[-1].x, got[-1].y, got[-1].z) == (3.0, 10.0, 0.0)


def test_quadratic_fit_is_exact(spark):
    path = spark.createDataFrame([(1, i, 10.0 * i, 0.002 * (10.0 * i) ** 2 - 3 * 10.0 * i + 900) for i in range(8)], "path_id long, i int, s double, z double")
    got = profiles.quadratic_fit(path).first()
    assert math.isclose(got.a, 0.002, rel_tol=1e-9) and math.isclose(got.b, -3, rel_tol=1e-9) and math.isclose(got.c, 900, rel_tol=1e-9)
    got = profiles.parabolic_fit(path).first()
    assert math.isclose(got.a, 0.002, rel_tol=1e-9) and math.isclose(got.c, 900, rel_tol=1e-9)


def test_first_sustained_slope_needs_a_stretch(spark):
    angles = [30, 30, 8, 30, 7, 6, 5, 4]
    path = spark.createDataFrame([(1, i, 10.0 * i, float(a)) for i, a in enumerate(angles)], "path_id long, i int, s double, angle double")
    assert profiles.first_sustained_slope(path, 10.0, 20.0).first().i == 4


def test_weighted_path(spark):
    rows = [("s", 0.0, i, float(v), 0.0, 0.0, 0.0, 0.0, float(w)) for i, (v, w) in enumerate(zip([1, 2, 3, 4, 5], [2, 1, 2, 1, 2], strict=True))]
    df = spark.createDataFrame(rows, "sim_name string, t double, id long, x double, ux double, uy double, uz double, s double, m double")
    got = particles.mass_averaged_path(df, ("x",)).first()
    assert math.isclose(got.x, 3.0) and math.isclose(got.x_std, 1.5)
    far = particles.mass_averaged_path(df.withColumn("x", F.col("x") + 4e8), ("x",)).first()
    assert math.isclose(far.x_std, 1.5)  # large coordinates don't cancel


def test_scattered_mass_is_kept(spark):
    rng = random.Random(6)
    rows = [("s", 0.0, i, rng.uniform(1, 9), rng.uniform(1, 9), 1.0, 0.0, 0.0, rng.uniform(1, 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "sim_name string, t double, id long, x double, y double, ux double, uy double, uz double, m double")
    got = particles.particles_to_fields(df, 1.0).agg(F.sum("mass").alias("m"), F.max("v").alias("v")).first()
    assert math.isclose(got.m, sum(r[-1] for r in rows)) and math.isclose(got.v, 1.0)


def test_range_time(spark):
    grid = [[2, 2, 4, 5], [1, 1, 4, 9], [2, 2, 3, 9], [2, 2, 4, 4], [2, 2, 5, 5]]
    flow = cells(spark, grid).withColumn("t", F.lit(1.0))
    view = spark.createDataFrame([(r, c, float(c)) for r in range(5) for c in range(4)], "r int, c int, range double")
    mti, front = particles.range_time(flow, view, 3.1, 2.0, "mean", step=1.0)
    assert front.first().range == 2.0
    assert {r.gate: r.value for r in mti.collect()} == {2: 17 / 4, 3: 32 / 5}  # range 3 is on the edge of gate 2 and not in it


@pytest.mark.parametrize(("times", "ranges", "want"), [([0, 1, 2, 3, 7, 8, 10], [12, 10, 7.5, 4.5, 4, 2, 0], (2.5, 10.0, 1.0)), ([0, 2, 3, 7, 8, 9, 10], [0, None, 4, 6, 7, 10, 12], (3.0, 7.0, 8.0))])
def test_approach_velocity(spark, times, ranges, want):
    rows = [("s", float(t), None if r is None else float(r)) for t, r in zip(times, ranges, strict=True)]
    got = particles.approach_velocity(spark.createDataFrame(rows, "sim_name string, t double, range double")).first()
    assert (got.velocity, got.range, got.t) == want


def test_backtrack_follows_the_path(spark):
    edges = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 3), (1, 2, 3), (1, 3, 4)], "start_id long, parent long, child long")
    values = spark.createDataFrame([(1, 0, 0.0), (1, 1, 2.0), (1, 2, 0.0), (1, 3, 1.0), (1, 4, 0.0)], "start_id long, node long, value double")
    assert {r.node: r.value for r in particles.backtrack_max(edges, values).collect()} == {0: 2.0, 1: 2.0, 2: 1.0, 3: 1.0, 4: 0.0}


def test_visit_layers_with_a_hot_cell(spark):
    df = spark.range(2000).select(F.col("id").alias("start_id"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(1.0).alias("z_delta"), *[F.lit(1.0).alias(c) for c in ("flux", "flux_dep", "fp_gamma", "sl_gamma", "dist")])
    got = particles.path_visit_layers(df.union(df)).first()
    assert (got.n_starts, got.z_delta_sum, got.flux_sum) == (2000, 2000.0, 4000.0)


def test_filters(spark):
    sims = spark.createDataFrame([("a", 0.5, "x"), ("b", 0.75, "y"), ("c", None, "x")], "sim_name string, th double, kind string")
    names = lambda **p: sorted(r.sim_name for r in simulations.filter_sims(sims, p).collect())
    assert names(th=[0.50000001]) == ["a"] and names(th="<0.7") == ["a"] and names(kind=["x"]) == ["a", "c"]
    assert sorted(r.sim_name for r in simulations.filter_sims(sims, {"~th": [0.5]}).collect()) == ["b", "c"]
    assert simulations.parse_filter_spec({"a": "1:3:3", "b": "2$50$3", "c": "x|y"}) == {"a": [1.0, 2.0, 3.0], "b": [1.0, 2.0, 3.0], "c": ["x", "y"]}


def test_volume_class_limit_is_medium(spark):
    got = shapes.volume_class(spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.1), (4, 9.9)], "feature_id long, volume double"), 10.0, 20.0)
    assert [r.size for r in got.orderBy("feature_id").collect()] == ["M", "M", "L", "S"]


def test_latin_and_morris_designs(spark):
    draws = spark.range(50)
    got = simulations.sample_latin(draws, ["a", "b"], 3).collect()
    for d in ("a", "b"):
        assert sorted(int(r[d] * 50) for r in got) == list(range(50))
    assert sorted(got) == sorted(simulations.sample_latin(draws.repartition(7), ["a", "b"], 3).collect())  # whatever the partitions
    steps = {}
    for r in sampling.sample_morris(draws, ["a", "b", "c"], 3).collect():
        steps.setdefault(r.id, {})[r.step] = (r.a, r.b, r.c)
    for own in steps.values():
        assert all(sum(p != q for p, q in zip(own[k], own[k + 1], strict=True)) == 1 for k in range(3))


@pytest.mark.parametrize("kind", ["uniform", "normal", "pert"])
def test_quantiles(kind):
    got = sampling.quantiles(kind, 101, 1.0, 5.0, mode=3.0, std=0.8)
    assert got == sorted(got) and 1.0 <= got[0] and got[-1] <= 5.0 and math.isclose(got[50], 3.0, abs_tol=1e-3)


def test_file_names(spark):
    names = ["release1_AF_0dcd58fc86_C_M_null_dfa_ppr_t12.50.asc", "relX_0.888_entres_dfa_pft.asc", "bad.asc"]
    got = rasters.parse_result_names(spark.createDataFrame([(n,) for n in names], "path string")).collect()
    assert tuple(got[0])[1:] == ("release1_AF", "0dcd58fc86", "C", "M", "null", "dfa", "ppr", 12.5)
    assert tuple(got[1])[1:] == ("relX", "0.888", None, None, "entres", "dfa", "pft", None)
    assert got[2].release_area is None


def test_runout_is_found_in_the_first_section(spark):
    grid = spark.createDataFrame([(1, s, m, float(s), float(m), float(s), float(m), 1.0) for s in range(4) for m in range(3)], "path_id int, i_s int, i_l int, s double, l double, x double, y double, area double")
    one = spark.createDataFrame([("a", "ppr", 1, s, m, 5.0 if (s, m) == (0, 1) else 0.0) for s in range(4) for m in range(3)], "sim_name string, res_type string, path_id int, i_s int, i_l int, value double")
    middle = grid.where("i_l = 1").select("path_id", "i_s", "s", "x", "y", (100 - F.col("s")).alias("z"))
    got = thalweg.runout(one, grid, middle, 1.0).first()
    assert (got.s_release, got.s_runout, got.l) == (0.0, 0.0, 1.0) and (got.z_release, got.delta_z, got.runout_angle, got.s_mean) == (100.0, 0.0, None, 0.0)
    two = one.withColumn("value", F.when(F.col("i_s") <= 2, 5.0).otherwise(0.0))
    got = thalweg.runout(two, grid, middle, 1.0).first()
    assert (got.s_runout, got.l, got.delta_s, got.delta_z, got.s_mean) == (2.0, 0.0, 2.0, 2.0, 2.0) and math.isclose(got.runout_angle, 45.0)


def test_backtracking_on_circles_and_long_paths(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(70)] + [(2, 0, 1), (2, 1, 2), (2, 2, 0)], "start_id int, parent long, child long")
    values = spark.createDataFrame([(1, 70, 9.0), (1, 0, 1.0), (2, 1, 3.0), (2, 0, 1.0), (2, 2, 0.0), (3, 5, 4.0)], "start_id int, node long, value double")
    got = {(r.start_id, r.node): r.value for r in particles.backtrack_max(edges, values).collect()}
    assert got == {(1, i): 9.0 for i in range(71)} | {(2, i): 3.0 for i in range(3)} | {(3, 5): 4.0}


def test_normals_of_an_inclined_plane(spark):
    """All forms give the plane's normal, at edges and corners too; a lonely cell stands upright."""
    dem = spark.createDataFrame([(r, c, 2.0 * c * 5 - 1.0 * r * 5) for r in range(4) for c in range(5)] + [(20, 20, 7.0)], "r int, c int, z double")
    n = math.sqrt(6)
    for k in (1, 4, 6, 8):
        for row in grids.triangle_normals(dem, 5.0, k).collect():
            want = (0.0, 0.0, 1.0) if row.r == 20 else (-2 / n, 1 / n, 1 / n)
            assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip((row.nx, row.ny, row.nz), want, strict=True))


def test_vectors(spark):
    a, b = tuple(F.lit(float(v)) for v in (1, 2, 2)), tuple(F.lit(float(v)) for v in (0, 0, 3))
    got = spark.range(1).select(vectors.norm(a).alias("n"), vectors.dot(a, b).alias("d"), vectors.cross(a, b)[0].alias("x"), vectors.normalize(a)[2].alias("u")).first()
    assert (got.n, got.d, got.x) == (3.0, 6.0, 6.0) and math.isclose(got.u, 2 / 3)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9])
def test_spline_by_its_conditions(n):
    """Against the system of all conditions of the pieces, solved at once."""
    rng = np.random.default_rng(n)
    u, y = np.cumsum(rng.uniform(0.5, 2, n)), rng.normal(size=(n, 1))
    at = np.linspace(u[0], u[-1], 50)
    got = profiles.spline(u, y, at)[:, 0]
    if n < 4:
        assert np.allclose(got, np.polyval(np.polyfit(u, y[:, 0], n - 1), at))
        return
    rows, right = [], []
    term = lambda k, x, d: np.concatenate([np.zeros(4 * k), [[x**3, x**2, x, 1], [3 * x**2, 2 * x, 1, 0], [6 * x, 2, 0, 0], [6, 0, 0, 0]][d], np.zeros(4 * (n - 2 - k))])
    for k in range(n - 1):
        rows += [term(k, u[k], 0), term(k, u[k + 1], 0)]
        right += [y[k, 0], y[k + 1, 0]]
    for k in range(n - 2):
        rows += [term(k, u[k + 1], d) - term(k + 1, u[k + 1], d) for d in (1, 2)]
        right += [0, 0]
    rows += [term(0, 0, 3) - term(1, 0, 3), term(n - 3, 0, 3) - term(n - 2, 0, 3)]
    coefficients = np.linalg.solve(np.array(rows), np.array([*right, 0, 0])).reshape(-1, 4)
    piece = np.clip(np.searchsorted(u, at, side="right") - 1, 0, n - 2)
    assert np.allclose(got, [np.polyval(coefficients[k], x) for k, x in zip(piece, at, strict=True)])


def test_spline_of_paths(spark):
    line = [(1, i, 3.0 * i, 4.0 * i) for i in range(5)] + [(1, 5, 12.0, 16.0), (2, 0, 1.0, 1.0)]
    got = sorted(profiles.resample_line_spline(spark.createDataFrame(line, "path_id int, i int, x double, y double"), 6.0).collect())
    assert [r.path_id for r in got] == [1] * 5 + [2] and np.allclose([(r.s, r.x, r.y) for r in got[:5]], [(5 * k, 3 * k, 4 * k) for k in range(5)])
    assert tuple(got[-1]) == (2, 0, 0.0, 1.0, 1.0)
