"""Operators that go on by frontier, in blocks or by small shares: against plain loops, and what their plans and rounds look like."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgrid.operators import ensemble, grids, particles, profiles, shapes
from flowgrid.queries import files, registry
from flowgrid.sources import rasters
from flowgrid.sources.shared import new_path

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def reached(edges, values):
    """The largest value downstream, by a plain search."""
    down, out = {}, {}
    for s, p, c in edges:
        down.setdefault((s, p), set()).add(c)
    own = {(s, n): v for s, n, v in values if v is not None and v == v}
    for s, n in set(down) | set(own) | {(s, c) for s, _, c in edges if c is not None}:
        seen, todo = {n}, [n]
        while todo:
            new = down.get((s, todo.pop()), set()) - seen
            seen |= new
            todo += new
        found = [own[s, k] for k in seen if (s, k) in own]
        if n is not None and found:
            out[s, n] = max(found)
    return out


EDGES, VALUES = "start_id long, parent long, child long", "start_id long, node long, value double"


@pytest.mark.parametrize("block", [1, 4, 256])
def test_backtracking_against_a_plain_search(spark, block):
    rng = random.Random(block)
    edges = [(s, rng.randrange(-20, 20), rng.randrange(-20, 20)) for s in range(4) for _ in range(15 * (s + 1))] + [(0, 3, None), (0, None, 2), (1, 5, 5)]
    values = [(s, n, rng.choice([None, float("nan"), *map(float, range(9))])) for s in range(5) for n in range(-20, 20) if rng.random() < 0.5] + [(0, 1, 3.0), (0, 1, 4.0)]
    values = [v for v in values if not (v[:2] == (0, 1) and v[2] not in (3.0, 4.0))]
    got = {(r.start_id, r.node): r.value for r in particles.backtrack_max(spark.createDataFrame(edges, EDGES), spark.createDataFrame(values, VALUES), block).collect()}
    assert got == reached([e for e in edges if None not in e], values)


def test_backtracking_rounds_take_only_what_rose(spark, monkeypatch):
    """A wide graph and a path of 1,500 nodes: rows of the frontier fall, and a round crosses a whole block."""
    tables = []
    monkeypatch.setattr(particles, "kept", lambda df, label, keep=particles.kept: tables.append((label, keep(df, label))) or tables[-1][1])
    wide = [(1, 0, 1000 * i) for i in range(1, 400)] + [(1, 1000 * i, 1000 * i + 1) for i in range(1, 400)]
    long = [(2, i, i + 1) for i in range(1500)]
    values = [(1, 1000 * i + 1, float(i)) for i in range(1, 400)] + [(1, 0, 5.0), (2, 1500, 7.0), (2, 0, 1.0)]
    got = {(r.start_id, r.node): r.value for r in particles.backtrack_max(spark.createDataFrame(wide + long, EDGES), spark.createDataFrame(values, VALUES)).collect()}
    assert got[1, 0] == 399.0 and got[1, 7000] == 7.0 and all(got[2, i] == 7.0 for i in range(1501)) and len(got) == 799 + 1501
    sizes = [df.count() for label, df in tables if label == "frontier"]
    assert len(sizes) <= 1500 // 256 + 2 and sizes[-1] == 0 and max(sizes[1:]) <= 2


def test_backtracking_of_small_starts_in_one_go(spark, monkeypatch):
    """Many small starts, with circles, beside a large one: no round and no table of theirs, and groups that span batches stay whole."""
    labels = []
    monkeypatch.setattr(particles, "kept", lambda df, label, keep=particles.kept: labels.append(label) or keep(df, label))
    monkeypatch.setattr("flowgrid.functions.batches.ROWS", 50)
    rng = random.Random(11)
    names = "start_id string, parent long, child long", "start_id string, node long, value double"
    edges = [(f"s{s}", rng.randrange(6) * 1000, rng.randrange(6) * 1000) for s in range(300) for _ in range(rng.randrange(9))]
    values = [(f"s{s}", n * 1000, float(rng.randrange(9))) for s in range(301) for n in range(6) if rng.random() < 0.5] + [("s7", 1000, float("-inf")), (None, 1, 2.0)]
    values = [v for v in values if v[:2] != ("s7", 1000)] + [("s7", 1000, 3.0)]
    run = lambda e, v: {(r.start_id, r.node): r.value for r in particles.backtrack_max(spark.createDataFrame(e, names[0]), spark.createDataFrame(v, names[1])).collect()}
    assert run(edges, values) == reached(edges, values) and labels == ["large"]
    more = edges + [("big", i, i + 700) for i in range(0, 1400)]
    got = run(more, values + [("big", 2099, 8.0)])
    assert got == reached(more, values + [("big", 2099, 8.0)]) and "frontier" in labels


@pytest.mark.parametrize("name", ["resample_to_reference", "rotate_raster", "rotate_results"])
def test_grids_are_not_broadcast(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["snap_points_to_line", "rasterize_line_neighbours", "all_particle_fields", "area_confusion_in_runout", "backtrack_max_branching"])
def test_no_pairs_of_all(spark, name):
    assert "CartesianProduct" not in plan(registry.queries()[name](spark, SF))


def test_large_grid_made_in_blocks(spark):
    """Two rasters with few cells on a grid of 10^6 places: all places come, and the values are those of the corners."""
    rows = [(k, r, c, float(10 * r + c)) for k in "ab" for r in range(4) for c in range(4)]
    small = spark.createDataFrame(rows, "sim_name string, r int, c int, value double")
    got = grids.resample_to_reference(small, (4, 4, 0.0, 0.0, 1.0), (500, 1000, 0.0, 0.0, 0.01))
    assert got.groupBy("sim_name").agg(F.count("*").alias("n"), F.count("value").alias("v")).orderBy("sim_name").collect() == [("a", 500_000, 90_000), ("b", 500_000, 90_000)]
    assert got.where("value is not null").agg(F.max(F.abs(F.col("value") - (F.col("r") * 0.1 + F.col("c") * 0.01)))).first()[0] < 1e-9
    assert grids.places_of(small, ("sim_name",), 3, 5).count() == 30 == grids.places_of(small, (), 3, 10).count()


def test_turned_rasters_against_a_plain_loop(spark):
    rng = random.Random(2)
    cells = {(k, r, c): rng.uniform(0, 9) for k in ("a", "b") for r in range(9) for c in range(12) if rng.random() < 0.95}
    df = spark.createDataFrame([(k, "ppr", r, c, v) for (k, r, c), v in cells.items()] + [("a", "ppr", 20, 20, None)], "sim_name string, res_type string, r int, c int, value double")
    angles = {"a": 33.0, "b": -70.0}
    got = {(r.sim_name, r.r, r.c): r.value for r in grids.rotate_results(df, spark.createDataFrame(list(angles.items()), "sim_name string, degrees double"), 9, 12, 5.0).collect()}
    assert len(got) == 2 * 9 * 12
    for (k, r, c), value in got.items():
        a = math.radians(angles[k] - 5)
        x, y = c * math.cos(a) + r * math.sin(a), -c * math.sin(a) + r * math.cos(a)
        i, j = math.floor(y), math.floor(x)
        corners = [cells.get((k, i + di, j + dj)) for di in (0, 1) for dj in (0, 1)]
        if 0 <= x < 11 and 0 <= y < 8 and None not in corners:
            fy, fx = y - i, x - j
            assert math.isclose(value, sum(w * v for w, v in zip(((1 - fy) * (1 - fx), (1 - fy) * fx, fy * (1 - fx), fy * fx), corners, strict=True)))
        else:
            assert value is None


def test_areas_along_the_path(spark):
    """The known areas of two blocks of ones, half a cell beside the nodes of 500 sections of 100 nodes, from section 400 on."""
    block = lambda lows, far: spark.range(50 * far).select((lows + F.col("id") / far).cast("int").alias("r"), (F.col("id") % far).cast("int").alias("c"), F.lit(1.0).alias("value"))
    rest = spark.range(100 * 500).select((F.col("id") / 500).cast("int").alias("r"), (F.col("id") % 500).cast("int").alias("c"))
    fields = [rest.join(b, ["r", "c"], "left").fillna(0.4, ["value"]).withColumn("sim_name", F.lit(k)) for k, b in (("ref", block(30, 450)), ("sim", block(40, 420)))]
    nodes = spark.range(500 * 100).select((F.col("id") / 100).cast("int").alias("i_s"), (F.col("id") % 100).cast("int").alias("i_l"))
    nodes = nodes.select("*", F.col("i_s").cast("double").alias("x"), F.col("i_l").cast("double").alias("y"))
    on = [grids.sample_raster_at_points(nodes, f, 100, 500, 0.5, 0.5).withColumn("sim_name", F.lit(k)) for f, k in zip(fields, ("ref", "sim"), strict=True)]
    area = nodes.where("i_s >= 400").select("i_s", "i_l", F.lit(1.0).alias("cell_area"))
    got = {r.sim_name: r for r in ensemble.area_confusion_within(on[0], on[0].unionByName(on[1]), area, 0.9, 0.9, on=("i_s", "i_l")).collect()}
    assert (got["sim"].tp, got["sim"].fn, got["sim"].fp, got["sim"].tn) == (780, 1670, 200, 7350)
    assert (got["sim"].a_tp, got["sim"].a_fn, got["sim"].a_fp, got["sim"].a_tn) == (780, 1670, 200, 7350)
    assert (got["ref"].tp, got["ref"].fn, got["ref"].fp, got["ref"].tn) == (2450, 0, 0, 7550)


FLAKES = "sim_name string, t double, x double, y double, m double, ux double, uy double, uz double, dm_det double, travel_angle double"


def test_detrained_mass_on_the_grid(spark):
    """Known fields of four particles on nodes, and on the middles between them."""
    make = lambda d: spark.createDataFrame([("s", 0.0, x + d, y + d, 100.0, 10.0, 10.0, 10.0, 1.0, 10.0 * x) for x in (2.0, 1.0) for y in (2.0, 1.0)], FLAKES)
    area = spark.range(25).select((F.col("id") / 5).cast("int").alias("r"), (F.col("id") % 5).cast("int").alias("c"), F.lit(25.0).alias("area"))
    got = {(r.r, r.c): r for r in particles.all_particle_fields(make(0.0), 1.0, area=area).collect()}
    assert {k: r.m_det for k, r in got.items()} == {(a, b): 1.0 for a in (1, 2) for b in (1, 2)}
    one = got[2, 1]
    assert (one.mass, one.ft, one.vx, one.ta, one.ft_det, one.m_ent, one.ft_stop) == (100.0, 0.02, 10.0, 10.0, -1 / 5000, 0.0, 0.0) and math.isclose(one.p, 200 * 300)
    got = {(r.r, r.c): r for r in particles.all_particle_fields(make(0.5), 1.0, area=area, stopped=make(0.5).limit(1)).collect()}
    assert {k: r.m_det for k, r in got.items()} == {(i, j): a * b for i, a in ((1, 0.5), (2, 1.0), (3, 0.5)) for j, b in ((1, 0.5), (2, 1.0), (3, 0.5))}
    assert {k: r.ta for k, r in got.items() if r.ta} == {(r, c): 10.0 * (c - 1) for r in (2, 3) for c in (2, 3)}  # halves go upwards
    assert sum(r.m_stop for r in got.values()) == 100.0 and sum(r.mass for r in got.values()) == 400.0


def test_stopped_particles_alone_make_nodes_without_mass(spark):
    none = spark.createDataFrame([], FLAKES)
    stopped = spark.createDataFrame([("s", 0.0, 1.0, 1.0, 4.0)], "sim_name string, t double, x double, y double, m double")
    (row,) = particles.all_particle_fields(none, 1.0, stopped=stopped).collect()
    assert (row.mass, row.v, row.ft, row.m_stop, row.ft_stop) == (0.0, 0.0, 0.0, 4.0, 0.02)


def test_neighbours_of_cells(spark):
    rng = random.Random(8)
    cells = {(rng.randrange(2), rng.randrange(12), rng.randrange(9)) for _ in range(12)}
    df = spark.createDataFrame(list(cells), "feature_id int, r int, c int")
    for rings in (1, 2):
        near = range(-rings, rings + 1)
        want = {(k, r + i, c + j) for k, r, c in cells for i in near for j in near if 0 <= r + i < 12 and 0 <= c + j < 9}
        got = shapes.dilated(df, 12, 9, rings).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_points_on_a_long_path(spark):
    """A path of 100,000 vertices: points near it meet a few of them, far ones find theirs too."""
    line = spark.range(100_000).select(F.lit(1).alias("path_id"), F.col("id").cast("int").alias("i"), F.col("id").cast("double").alias("x"), (50 * F.sin(F.col("id") / 900)).alias("y"))
    rng = random.Random(5)
    rows = [(k, 1, rng.uniform(-10, 100_010), rng.uniform(-70, 70)) for k in range(200)] + [(500, 1, -3000.0, 100.0), (501, 1, 50_000.0, 4000.0), (502, 1, None, 1.0), (503, 2, 1.0, 1.0), (504, 1, 7.0, float("nan"))]
    points = spark.createDataFrame(rows, "point_id int, path_id int, x double, y double")
    got = {r.point_id: r for r in shapes.snap_points_to_line(points, line).collect()}
    xs = np.arange(100_000.0)
    ys = 50 * np.sin(xs / 900)
    for k, _, x, y in rows[:202]:
        d = np.hypot(xs - x, ys - y)
        assert got[k].i == int(d.argmin()) and math.isclose(got[k].distance, d.min(), rel_tol=1e-9)
    assert 503 not in got and got[502].i is None and got[504].distance is None
    assert shapes.snap_points_to_line(points.where("point_id > 501"), line).count() == 2


def test_points_of_short_paths_are_not_written(spark, monkeypatch):
    """Short and long paths, near and far points; only paths with points are kept, and only points of the long one go in rounds."""
    tables = {}
    monkeypatch.setattr(shapes, "kept", lambda df, label, keep=shapes.kept: tables.setdefault(label, []).append(keep(df, label)) or tables[label][-1])
    rng = random.Random(6)
    line = [(p, i, rng.uniform(-20, 20), rng.uniform(-20, 20)) for p in range(40) for i in range(1 + p % 9)] + [(50, i, 3.0 * i, 0.0) for i in range(300)] + [(51, 0, None, 1.0), (52, 0, 1.0, 0.0), (52, 1, -1.0, 0.0)]
    rows = [(k, p, rng.uniform(-r, r), rng.uniform(-r, r)) for k, (p, r) in enumerate((p, r) for p in [*range(12), 50] for r in (5, 100, 10_000) for _ in range(6))]
    rows += [(900, 3, None, 1.0), (901, 51, 1.0, 1.0), (902, 77, 1.0, 1.0), (903, 52, 0.0, 3.0)]
    points, path = spark.createDataFrame(rows, "point_id int, path_id int, x double, y double"), spark.createDataFrame(line, "path_id int, i int, x double, y double")
    got = {r.point_id: (r.i, r.distance) for r in shapes.snap_points_to_line(points, path).collect()}
    for k, p, x, y in rows[:-4]:
        d, i = min((math.hypot(x - a, y - b), i) for q, i, a, b in line if q == p)
        assert got[k][0] == i and math.isclose(got[k][1], d)
    assert got[900] == (None, None) and 901 not in got and 902 not in got and got[903][0] == 0 and len(got) == len(rows) - 2
    assert tables["vertices"][0].select("path_id").distinct().count() == 14 and tables["points"][0].count() == 18
    tables.clear()
    assert shapes.snap_points_to_line(points.where("path_id < 12"), path).count() == 12 * 18 + 1
    assert set(tables) == {"vertices", "long"}


def test_profiles_without_an_exchange_of_the_result(spark):
    """Against a plain loop: gaps, places outside or missing, points of one place; nothing is grouped by simulation and point."""
    rng = random.Random(12)
    cells = {(k, r, c): rng.uniform(0, 9) for k in ("a", "b", "c") for r in range(6) for c in range(7) if k != "c" and rng.random() < 0.93 or (r, c) == (0, 0)}
    dem = {(r, c): 100.0 - r - c * c for r in range(6) for c in range(7) if (r, c) != (5, 6)}
    line = [(p, i, rng.choice([0.0, 1.0, 2.5, 4.75, 5.5, -0.5, 6.0]), rng.choice([0.0, 0.25, 3.0, 4.5, 5.0])) for p in range(40) for i in range(5)] + [(50, 0, None, 1.0), (50, 1, float("nan"), 1.0)]
    df = grids.profile_at_line(spark.createDataFrame(line, "path_id int, i int, x double, y double"), spark.createDataFrame([(*k, v) for k, v in cells.items()], "sim_name string, r int, c int, value double"), spark.createDataFrame([(*k, v) for k, v in dem.items()], "r int, c int, z double"), 6, 7, digits=7)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(keys=\[|hashpartitioning\()[^\])]*sim_name[^\])]*path_id", text)

    def at(known, x, y):
        if x is None or not (0 <= x < 6 and 0 <= y < 5):
            return None
        i, j = math.floor(y), math.floor(x)
        four = [known.get((i + a, j + b)) for a in (0, 1) for b in (0, 1)]
        w = [(y - i if a else 1 - y + i) * (x - j if b else 1 - x + j) for a in (0, 1) for b in (0, 1)]
        return None if None in four else sum(p * q for p, q in zip(w, four, strict=True))

    got = {(r.sim_name, r.path_id, r.i): (r.z, r.value, r.surface) for r in df.collect()}
    assert len(got) == 3 * len(line) == df.count()
    for k in ("a", "b", "c"):
        for p, i, x, y in line:
            z, v = at(dem, x, y), at({(r, c): q for (n, r, c), q in cells.items() if n == k}, x, y)
            want = (z, v, None if z is None else z + (v or 0.0))
            assert all((a is None and b is None) or math.isclose(a, b, abs_tol=1e-7) for a, b in zip(got[k, p, i], want, strict=True))


def test_mass_series_in_few_files(spark, monkeypatch, tmp_path):
    """One file for each task that writes, not one for each simulation and task."""
    monkeypatch.setattr(files, "new_path", lambda spark, label: str(tmp_path / label))
    assert registry.queries()["read_mass_series"](spark, SF).select("sim_name").distinct().count() > 4
    assert len(list((tmp_path / "mass").glob("*.csv"))) <= 4 and not [p for p in (tmp_path / "mass").iterdir() if p.is_dir()]


def overlapping(n):
    """Vertices of n polygons of three outlines, one of them listed from another corner, and points on a few places."""
    forms = [((0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)), ((2.0, 1.0), (9.0, 1.0), (2.0, 9.0)), ((4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (0.0, 0.0))]
    vertices = [(k, i, x, y) for k in range(n) for i, (x, y) in enumerate(forms[k % 3])]
    points = [(k, 0.75 * (k % 11), 0.75 * (k % 7)) for k in range(20 * n)] + [(-1, None, 1.0), (-2, float("nan"), 1.0)]
    return forms, vertices, points


def odd(x, y, form):
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(form, form[1:] + form[:1], strict=True)) % 2 == 1


def meetings(monkeypatch):
    """Tables of places and outlines that meet."""
    met = []
    monkeypatch.setattr(shapes, "shapes_at", lambda places, own, radius=0.0, meet=shapes.shapes_at: met.append((places.count(), own.count())) or meet(places, own, radius))
    return met


def test_points_in_many_equal_polygons(spark, monkeypatch):
    """Places and outlines are tested once each, and every point still gets every polygon."""
    met = meetings(monkeypatch)
    forms, vertices, points = overlapping(45)
    got = shapes.point_in_polygon(spark.createDataFrame(points, "k int, x double, y double"), spark.createDataFrame(vertices, "feature_id int, seq int, x double, y double")).collect()
    want = {(k, f) for k, x, y in points[:-2] for f in range(45) if odd(x, y, forms[f % 3])}
    assert {(r.k, r.feature_id) for r in got} == want and len(got) == len(want)
    assert met == [(78 + 1, 3)]  # one of the places is not a number


def test_particles_at_few_places_in_many_equal_polygons(spark, monkeypatch):
    met = meetings(monkeypatch)
    forms, vertices, points = overlapping(45)
    rows = [(k, x, y, float(k % 4)) for k, x, y in points]
    got = shapes.particles_in_release(spark.createDataFrame(rows + rows[:9], "k int, x double, y double, m double"), spark.createDataFrame(vertices, "feature_id int, seq int, x double, y double"), 0.0).collect()
    want = {k for k, x, y, m in rows[:-2] if m > 0 and any(odd(x, y, f) for f in forms)}
    assert {r.k for r in got} == want and len(got) == len(want)
    assert met == [(len({(x, y) for k, x, y, m in rows[:-2] if m > 0}) + sum(m > 0 for *_, m in rows[-2:]), 3)]


def test_remeshed_raster_is_found_again(spark):
    folder = new_path(spark, "remeshed")
    dem = spark.createDataFrame([(r, c, 2.0 * c + 3.0 * r) for r in range(11) for c in range(12)], "r int, c int, value double")
    header = (11, 12, 100.0, 200.0, 1.0)
    first, reused = rasters.remeshed_raster(dem, header, "dem", 1.5, folder)
    again, found = rasters.remeshed_raster(dem.limit(0), header, "dem", 1.5005, folder)
    assert (reused, found) == (False, True) and sorted(first.collect()) == sorted(again.collect())
    assert rasters.remeshed_raster(dem, header, "dem", 2.0, folder)[1] is False  # beside the first
    assert rasters.remeshed_raster(dem, header, "other", 1.5, folder)[1] is False
    assert rasters.remeshed_raster(dem, header, "dem", 1.5, folder)[1] is True
    assert rasters.remeshed_raster(dem, header, "dem", 1.0004, folder)[0] is dem
    known = {r.raster_id: (r.nrows, r.ncols, r.xll, r.yll, r.cellsize) for r in rasters.raster_catalog(spark, folder).collect()}
    assert known == {"dem_remeshed1.5": (7, 8, 100.0, 200.0, 1.5), "dem_remeshed2": (6, 6, 100.0, 200.0, 2.0), "other_remeshed1.5": (7, 8, 100.0, 200.0, 1.5)}
    assert grids.remeshed_shape(11, 12, 1.0, 1.5) == (7, 8) and grids.remeshed_shape(11, 12, 1.0, 1.5, True) == (8, 9)
    assert grids.remeshed_shape(11, 13, 1.0, 1.5, True) == (7, 9)  # columns end exactly: no larger


def bending(u, m):
    h = np.diff(u)
    return float((h[:, None] / 3 * (m[:-1] ** 2 + m[:-1] * m[1:] + m[1:] ** 2)).sum())


@pytest.mark.parametrize(("n", "bound"), [(4, 0.05), (5, 0.3), (30, 0.01), (30, 5.0), (200, 20.0)])
def test_smoothing_by_its_conditions(n, bound):
    """The bound is met, ends are straight, and what is left over is the jump of the third derivative: the conditions of the smoothest curve."""
    rng = np.random.default_rng(n)
    u = np.cumsum(rng.uniform(0.2, 2, n))
    y = np.stack([np.sin(u / 3) + rng.normal(size=n), rng.normal(size=n)], axis=1)
    values, m, k = profiles.smoothed(u, y, bound)
    left = ((y - values) ** 2).sum()
    assert left <= bound * (1 + 1e-9) and math.isclose(left, bound, rel_tol=1e-6) and np.allclose(m[[0, -1]], 0)
    h = np.diff(u)
    slope = np.diff(values, axis=0) / h[:, None]
    smooth = h[:-1, None] * m[:-2] + 2 * (h[:-1] + h[1:])[:, None] * m[1:-1] + h[1:, None] * m[2:]
    assert np.allclose(smooth, 6 * np.diff(slope, axis=0))  # the first derivative has no jump
    third = np.concatenate([np.zeros((1, 2)), np.diff(m, axis=0) / h[:, None], np.zeros((1, 2))])
    assert np.allclose(y - values, k * np.diff(third, axis=0), atol=1e-8)
    for _ in range(20):  # other curves that keep the bound bend more
        other = y + (values - y) * 0.999 + rng.normal(size=y.shape) * 1e-4
        if ((y - other) ** 2).sum() <= bound:
            a, b = 1 / h[:-1], 1 / h[1:]
            jumps = a[:, None] * other[:-2] - (a + b)[:, None] * other[1:-1] + b[:, None] * other[2:]
            full = profiles.five_band((h[:-1] + h[1:]) / 3, h[1:-1] / 6, np.zeros(max(0, n - 4)), jumps)
            assert bending(u, np.pad(full, ((1, 1), (0, 0)))) > bending(u, m)


def test_smoothing_from_none_to_a_line():
    rng = np.random.default_rng(9)
    u, y = np.cumsum(rng.uniform(0.5, 2, 12)), rng.normal(size=(12, 2))
    at = np.linspace(u[0], u[-1], 40)
    assert np.array_equal(profiles.smoothing_spline(u, y, at, 0.0), profiles.spline(u, y, at))
    line = np.stack([np.polyval(np.polyfit(u, y[:, j], 1), at) for j in (0, 1)], axis=1)
    assert np.allclose(profiles.smoothing_spline(u, y, at, 1e9), line)
    values, _, _ = profiles.smoothed(u, y, 1e-12)
    assert np.allclose(values, y, atol=1e-5)


def test_smoothed_paths(spark):
    rng = random.Random(7)
    path = spark.createDataFrame([(k, i, 5.0 * i + rng.uniform(-1, 1), rng.uniform(-1, 1)) for k in (1, 2) for i in range(20)] + [(3, i, float(i), float(i * i)) for i in range(3)], "path_id int, i int, x double, y double")
    rough, smooth = (profiles.resample_line_spline(path, 5.0, s).where("path_id < 3").orderBy("path_id", "i").toPandas() for s in (0.0, None))
    turn = lambda d: np.abs(np.diff(np.arctan2(np.diff(d["y"]), np.diff(d["x"])))).sum()
    assert len(rough) == len(smooth) and turn(smooth[:20]) < turn(rough[:20])
    short = [tuple(r) for r in profiles.resample_line_spline(path, 1.0, None).where("path_id = 3").collect()]
    assert np.allclose(short, [tuple(r) for r in profiles.resample_line_spline(path, 1.0, 0.0).where("path_id = 3").collect()])


@pytest.mark.parametrize("smoothing", [0.0, None, 2.0])
def test_many_paths_are_solved_together(spark, monkeypatch, smoothing):
    """Paths of 1 to 12 vertices, some repeated or straight, in batches that paths span: each as by itself, and few calls of the solvers."""
    calls = []
    for name in ("bends", "smoothed"):
        monkeypatch.setattr(profiles, name, lambda *a, name=name, solve=getattr(profiles, name): calls.append(name) or solve(*a))
    rng = np.random.default_rng(4)
    lines = {f"p{k}": np.stack([10.0 * np.arange(n) + rng.integers(0, 7, n), rng.integers(0, 9, n).astype(float)], axis=1) for k, n in enumerate(rng.integers(1, 13, 300))}
    lines |= {"twice": np.array([[0.0, 0], [0, 0], [35, 0], [35, 0], [70, 0]]), "one": np.array([[3.0, 3], [3, 3]]), "straight": np.stack([np.arange(9.0), np.zeros(9)], axis=1)}
    xy, path = np.concatenate(list(lines.values())), np.repeat(np.arange(len(lines)), [len(v) for v in lines.values()])
    got = profiles.even_splines(xy, path, 7.0, smoothing)
    assert len(calls) <= 9
    rows = [(k, i, float(x), float(y)) for k, v in lines.items() for i, (x, y) in enumerate(v)]
    rng.shuffle(rows)
    monkeypatch.setattr("flowgrid.functions.batches.ROWS", 64)
    made = {(r.path_id, r.i): (r.s, r.x, r.y) for r in profiles.resample_line_spline(spark.createDataFrame([(str(k), int(i), float(x), float(y)) for k, i, x, y in rows], "path_id string, i int, x double, y double"), 7.0, smoothing).collect()}
    assert len(made) == len(got[0])
    for j, (k, v) in enumerate(lines.items()):
        v = v[np.append(True, (np.diff(v, axis=0) != 0).any(axis=1))]
        u = np.append(0.0, np.cumsum(np.hypot(*np.diff(v, axis=0).T)))
        want = profiles.smoothing_spline(u, v, np.linspace(0, u[-1], int(np.ceil(u[-1] / 7)) + 1), len(u) - np.sqrt(2 * len(u)) if smoothing is None else smoothing)
        assert np.allclose(got[3][got[0] == j], want, atol=1e-9) and (got[1][got[0] == j] == np.arange(len(want))).all()
        assert np.allclose([made[k, i][1:] for i in range(len(want))], want, atol=1e-9) and made[k, 0][0] == 0


def test_path_of_fields(spark):
    rows = [("s", t, r, c, 1.0 if c < 4 else 0.0, float(c + 1), 2.0) for t in (0.0, 1.0) for r in range(3) for c in range(int(t), 6)] + [("s", 0.0, 9, 9, 5.0, 7.0, 1.0), ("s", 0.0, 0, 5, None, 7.0, 1.0)]
    fields = spark.createDataFrame(rows, "sim_name string, t double, r int, c int, ft double, fm double, fv double")
    dem = spark.createDataFrame([(r, c, 100.0 - c) for r in range(3) for c in range(6)], "r int, c int, z double")
    a, b = particles.mass_averaged_path_of_fields(fields, dem, 10.0).orderBy("t").collect()
    assert math.isclose(a.x, 20.0) and math.isclose(a.z, 98.0) and math.isclose(a.y, 10.0) and math.isclose(a.e_kin, 60.0) and math.isclose(a.ekin, 6.0) and math.isclose(a.u2, 4.0)
    assert math.isclose(b.x, 10 * (2 + 6 + 12) / 9) and a.s == 0 and math.isclose(b.s, b.x - a.x)
