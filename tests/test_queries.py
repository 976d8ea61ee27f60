"""Every registered query of the library against its SQL, and what the plans look like."""

import os

import duckdb
import pandas as pd
import pytest

from flowgrid.queries import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(df):
    """Sorted rows with missing values as None; doubles to 8 digits."""
    out = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple(None if v is None or v is pd.NA or v is pd.NaT or v != v else float(f"{v:.8g}") + 0.0 if isinstance(v, float) else float(v) if hasattr(v, "dtype") and v.dtype.kind in "iuf" else v for v in row))
    return sorted(out, key=repr)


def close(a, b):
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    return len(a) == len(b) and all(all((number(p) and number(q) and abs(p - q) <= 1e-6 * max(1, abs(p))) or p == q for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert close(rows(got), rows(want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert {"r", "c", "probability"} == set(__spark_entry__.entry(spark).columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["exceedance_probability", "field_stats", "path_visit_layers", "sample_raster_at_points", "point_in_polygon", "rasterize_polygon", "feature_isolation", "peak_over_time", "mosaic_rasters", "contour_segments"])
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(QUERIES[name](spark, SF))


def test_flagship_reads_few_columns_and_aggregates_before_the_exchange(spark):
    text = plan(QUERIES["exceedance_probability"](spark, SF))
    assert "partial_count" in text or "partial_max" in text
    assert all(c not in text for c in ("l_tax:", "l_discount:", "l_shipdate:", "l_linestatus:"))
