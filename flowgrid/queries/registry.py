"""Registered queries of the library with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .inputs import frame, with_inputs

Query = Callable[[SparkSession, str], DataFrame]
ENTRIES: dict[str, tuple[Query, str | None]] = {}
MODULES = ("ensembles", "simulations", "geometry", "paths", "particles", "files", "streams", "workloads")


class Inputs:
    """Given tables and derived inputs as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)


def query(sql: str | None = None) -> Callable[[Callable[[Inputs], DataFrame]], Query]:
    """Register a function of Inputs under its name, with SQL over the same inputs."""

    def put(make: Callable[[Inputs], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(Inputs(spark, sf_dir))

        run.__module__, run.__name__ = make.__module__, make.__name__
        ENTRIES[make.__name__] = (run, sql and with_inputs(sql))
        return run

    return put


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the order of sums differs."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"flowgrid.queries.{name}")


def queries() -> dict[str, Query]:
    load()
    return {name: run for name, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
