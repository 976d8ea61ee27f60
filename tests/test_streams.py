"""Streams: windows that close once, and a table that batches are merged into."""

import random

import pytest

from flowgrid.sources.shared import new_path
from flowgrid.streaming import fields
from flowgrid.streaming.merged import MergedPeaks

SCHEMA = "sim_name string, t double, res_type string, r int, c int, value double"


def steps(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_front_windows_close_once_and_leave_the_state(spark):
    source, table, log = (new_path(spark, x) for x in ("in", "out", "log"))
    view = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(3) for c in range(3)], "r int, c int, range double")

    def run():
        stream = fields.field_stream(spark, source, SCHEMA, files=1, delay="10 seconds")
        query = fields.run_appending(fields.stream_front(stream, view, 1.0), table, log)
        return [(p["stateOperators"][0]["numRowsTotal"], p["stateOperators"][0]["numRowsDroppedByWatermark"]) for p in query.recentProgress if p["stateOperators"]]

    read = lambda: sorted((r.sim_name, int(r.start.timestamp()), r.range) for r in spark.read.parquet(table).collect())
    steps(spark, source, [(s, float(t), "pfv", r, c, 5.0) for s in "ab" for t in range(30) for r, c in ((2, 1), (1, 2))])
    first = run()
    assert read() == sorted((s, t, 12.0) for s in "ab" for t in range(19))  # 29 - 10 and later stay open
    assert first[-1][0] == 2 * 11  # of 60 windows
    steps(spark, source, [("a", 100.0, "pfv", 0, 1, 0.5), ("a", 25.0, "pfv", 0, 1, 5.0)])  # nothing flows at 100, but time goes on
    run()
    assert ("a", 25, 1.0) in read() and ("b", 25, 12.0) in read() and len(read()) == 60
    steps(spark, source, [("a", 20.0, "pfv", 0, 0, 9.0), ("a", 95.0, "pfv", 0, 2, 9.0)])
    late = run()
    assert sum(n for _, n in late) >= 1 and len(read()) == 60  # the row at 20 is dropped, the one at 95 waits
    steps(spark, source, [("b", 200.0, "pfv", 0, 0, None)])
    run()
    got = read()
    assert len(got) == len(set(got)) == 61 and ("a", 95, 2.0) in got and ("a", 20, 12.0) in got


def test_peaks_are_merged_by_key(spark):
    source, log = new_path(spark, "in"), new_path(spark, "log")
    table = MergedPeaks(new_path(spark, "peaks"), buckets=8)
    rng, known = random.Random(1), {}
    for n in range(5):
        rows = [(rng.choice("ab"), float(n), "ppr", rng.randrange(3 if n else 6), rng.randrange(4), rng.choice([None, *map(float, range(50))])) for _ in range(30)]
        for s, _, k, r, c, v in rows:
            if v is not None:
                known[s, k, r, c] = max(v, known.get((s, k, r, c), v))
        steps(spark, source, rows)
        query = fields.run_merging(fields.field_stream(spark, source, SCHEMA, files=1), table, log)
        assert not any(p["stateOperators"] for p in query.recentProgress)
        got = table.read(spark, "sim_name string, res_type string, r int, c int, value double").collect()
        assert {tuple(x)[:4]: x.value for x in got} == known and len(got) == len(known)
    stored = spark.read.schema("value double").option("recursiveFileLookup", "true").parquet(f"{table.path}/versions").count()
    assert stored <= 3 * len(known)  # and not all five batches' history


def test_replayed_batches_change_nothing(spark):
    table = MergedPeaks(new_path(spark, "peaks"), ("k",), "v", buckets=4)
    batch = lambda rows: spark.createDataFrame(rows, "k int, v double")
    read = lambda: sorted(map(tuple, table.read(spark, "k int, v double").collect()))
    assert read() == [] and table.latest(spark) == -1
    table.merge(batch([(1, 1.0), (2, 2.0)]), 0)
    table.merge(batch([(1, 5.0), (3, None)]), 1)
    table.merge(batch([(2, 1.0), (4, 4.0)]), 2)
    want = [(1, 5.0), (2, 2.0), (4, 4.0)]
    assert read() == want
    table.merge(batch([(2, 1.0), (4, 4.0)]), 2)  # again, as after a lost driver
    assert read() == want
    table.merge(batch([]), 3)
    assert read() == want and table.latest(spark) == 3
    # A batch that broke off before its list was written does not count, and runs again from the same versions.
    batch([(1, 99.0)]).selectExpr("0 as bucket", "k", "v").write.partitionBy("bucket").parquet(f"{table.path}/versions/4")
    assert read() == want
    table.merge(batch([(1, 6.0)]), 4)
    assert read() == [(1, 6.0), (2, 2.0), (4, 4.0)]
    with pytest.raises(Exception, match="(?i)path"):
        table.merge(batch([(1, 6.0)]), 9)  # batches have to follow each other
