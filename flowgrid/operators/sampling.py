"""Designs and distributions of parameter samples."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .simulations import uniform

LEVELS = 6


def sample_morris(trajectories: DataFrame, dimensions: list[str], seed: int) -> DataFrame:
    """id, step, dimensions: for each trajectory (id) d + 1 points on LEVELS levels, of which each moves one dimension by half the levels.

    The start is on the lower half; the order of the dimensions is random.  All draws depend on seed and id only.
    """
    half = LEVELS // 2
    order = F.array_sort(F.array(*[F.struct(uniform(seed, F.lit(d), F.col("id")).alias("u"), F.lit(d).alias("d")) for d in dimensions]))
    rank = lambda d: F.array_position(F.transform("_order", lambda x: x["d"]), F.lit(d))
    steps = trajectories.select("id", order.alias("_order"), F.explode(F.sequence(F.lit(0), F.lit(len(dimensions)))).alias("step"))
    start = lambda d: F.floor(uniform(seed + 1, F.lit(d), F.col("id")) * half)
    return steps.select("id", "step", *[((start(d) + F.when(rank(d) <= F.col("step"), half).otherwise(0)) / float(LEVELS - 1)).alias(d) for d in dimensions])


def quantiles(kind: str, n: int, low: float, high: float, mode: float | None = None, std: float | None = None) -> list[float]:
    """n values at the middles of n equal shares of a distribution: uniform, normal (cut to low..high), pert (low, mode, high)."""
    p = (np.arange(n) + 0.5) / n
    if kind == "uniform":
        return (low + p * (high - low)).tolist()
    if kind == "normal":
        d = NormalDist((low + high) / 2 if mode is None else mode, std)
        a, b = d.cdf(low), d.cdf(high)
        return [d.inv_cdf(a + q * (b - a)) for q in p.tolist()]
    a, b = 1 + 4 * (mode - low) / (high - low), 1 + 4 * (high - mode) / (high - low)
    x = np.linspace(0, 1, 4001)
    density = x ** (a - 1) * (1 - x) ** (b - 1)
    cdf = np.append(0.0, np.cumsum((density[1:] + density[:-1]) / 2))
    return (low + np.interp(p, cdf / cdf[-1], x) * (high - low)).tolist()


def sample_distribution(spark: SparkSession, rows: DataFrame, key: str, kind: str, n: int, **limits: float) -> DataFrame:
    """rows with `value`: the (key mod n)-th of n quantiles of a distribution (a table of n rows)."""
    table = spark.createDataFrame(list(enumerate(quantiles(kind, n, **limits))), "_q long, value double")
    return rows.withColumn("_q", F.pmod(F.col(key), F.lit(n)).cast("long")).join(table, "_q").drop("_q")
