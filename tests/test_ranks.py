"""Percentiles of groups in parts against numpy."""

import random

import numpy as np
import pytest

from flowgrid.functions import ranks


@pytest.mark.parametrize("accuracy", [5000, 40])
def test_percentiles_of_groups_of_any_size(spark, monkeypatch, accuracy):
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    rng, rows = random.Random(1), [("none", None)]
    for name, n in (("a", 1), ("b", 2), ("c", 3), ("d", 7), ("e", 1000), ("f", 20_000), (None, 5)):
        rows += [(name, rng.choice([1.0, 2.5, rng.gauss(0, 9), rng.random()])) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99, "p100": 1.0}
    got = ranks.percentiles(df, "v", shares, ["g"]).collect()
    assert len(got) == 7
    for r in got:
        assert np.allclose(np.quantile([v for g, v in rows if g == r.g and v is not None], list(shares.values())), [r[k] for k in shares])
    whole = ranks.percentiles(df, "v", shares, []).first()
    assert np.allclose(np.quantile([v for _, v in rows if v is not None], list(shares.values())), [whole[k] for k in shares])


def test_numbers_of_rows(spark):
    rng = random.Random(2)
    values = [rng.randint(0, 10**6) * 1.5 for _ in range(3000)]
    got = ranks.numbered(spark.createDataFrame([(v,) for v in sorted(set(values), key=lambda v: rng.random())], "v double"), "v", "n").collect()
    assert [r.v for r in sorted(got, key=lambda r: r.n)] == sorted(set(values)) and sorted(r.n for r in got) == list(range(1, len(got) + 1))
    assert ranks.numbered(spark.createDataFrame([], "v double"), "v", "n").collect() == []
