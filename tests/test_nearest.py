"""The nearest node of the path grid, however far it is."""

import random

from flowgrid.operators import thalweg


def test_nearest_node_of_far_particles(spark):
    rng = random.Random(3)
    nodes = [(p, s, l, 2.0 * s + 0.25 * p, 1.5 * l - 3.0 * p) for p in range(2) for s in range(8) for l in range(5)]
    places = [(rng.uniform(-r, r), rng.uniform(-r, r)) for r in (3, 15, 60, 900, 20_000) for _ in range(12)] + [(1.0, 0.75), (-13.0, 0.0)]
    rows = [(i, x, y) for i, (x, y) in enumerate(places)] + [(900, None, 1.0), (901, 1.0, float("nan"))]
    grid = spark.createDataFrame(nodes, "path_id int, i_s int, i_l int, x double, y double")
    particles = spark.createDataFrame(rows, "id int, x double, y double")
    got = {r.id: (r.path_id, r.i_s, r.i_l) for r in thalweg.nearest_sl_for_particles(particles, grid).collect()}
    want = {i: min(nodes, key=lambda n: ((n[3] - x) ** 2 + (n[4] - y) ** 2, n[:3]))[:3] for i, (x, y) in enumerate(places)}
    assert got == want | {900: (None,) * 3, 901: (None,) * 3}
    none = thalweg.nearest_sl_for_particles(particles, grid.limit(0)).collect()
    assert len(none) == len(rows) and all(r.path_id is None for r in none)


def test_equal_places_are_looked_up_once(spark, monkeypatch):
    """4,000 particles on 12 places and 300 paths over the same nodes: tables of places, not of particles."""
    tables = {}
    monkeypatch.setattr(thalweg, "kept", lambda df, label, keep=thalweg.kept: tables.setdefault(label, keep(df, label)))
    grid = spark.createDataFrame([(p, s, l, 2.0 * s, 1.5 * l) for p in range(300) for s in range(6) for l in range(3)], "path_id int, i_s int, i_l int, x double, y double")
    particles = spark.createDataFrame([(i, 3.0 * (i % 4), 1.25 * (i % 3)) for i in range(4000)], "id int, x double, y double")
    got = {tuple(r)[1:] for r in thalweg.nearest_sl_for_particles(particles, grid).collect()}
    assert len(got) == 12 and {r[2] for r in got} == {0}
    assert tables["places"].count() == 12 and tables["nodes"].count() == 18 and "particles" not in tables


def test_equal_to_nine_digits(spark):
    """The place of path 0 is further by the last bit only; as in the SQL, the lower path counts.  Denser nodes than a block is wide are found too."""
    grid = spark.createDataFrame([(0, 0, 0, 0.1 + 0.2, 0.0), (1, 0, 0, 0.3, 0.0)] + [(2, s, 0, 5 + s / 500, 5.0) for s in range(1000)], "path_id int, i_s int, i_l int, x double, y double")
    particles = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.5001, 5.0), (3, 30.0, 5.0)], "id int, x double, y double")
    assert {r.id: (r.path_id, r.i_s) for r in thalweg.nearest_sl_for_particles(particles, grid).collect()} == {1: (0, 0), 2: (2, 250), 3: (2, 999)}
