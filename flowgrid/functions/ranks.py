"""Exact percentiles of groups and row numbers of tables of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowgrid.sources.shared import kept

ACCURACY = 5000


def percentiles(df: DataFrame, column: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """by and, for each name in shares, the value below which that share of a group's values lies, between neighbours in proportion.

    A sketch gives bounds about each percentile; values below are counted, and only those within the bounds, some
    4 / ACCURACY of a group, are put in order, besides the nearest on either side.  So no task holds a group.  Missing
    values don't count; a group without others has none.
    """
    own = df.select(*by, F.col(column).cast("double").alias("v")).where("v is not null")
    names, eps = list(shares), 2 / ACCURACY
    wanted = [min(1.0, max(0.0, p + d)) for p in shares.values() for d in (-eps, eps)]
    ends = own.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", wanted, ACCURACY).alias("q"))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by], F.lit(True))
    on = own.alias("a").join(ends.alias("b"), same("a", "b")).select(*[F.col(f"a.{c}") for c in by], "v", "n", "q") if by else own.join(F.broadcast(ends))  # one row without groups
    low, high = (lambda i: F.col("q")[2 * i]), (lambda i: F.col("q")[2 * i + 1])
    about = lambda i: F.struct(F.lit(i).alias("i"), F.count_if(F.col("v") < low(i)).alias("below"), F.max(F.when(F.col("v") < low(i), F.col("v"))).alias("prev"), F.min(F.when(F.col("v") > high(i), F.col("v"))).alias("next"))
    told = on.groupBy(*by).agg(F.first("n").alias("n"), F.array(*[about(i) for i in range(len(names))]).alias("k")).select(*by, "n", F.explode("k").alias("k")).select(*by, "n", "k.*")
    inside = on.select(*by, "v", F.explode(F.filter(F.array(*[F.when(F.col("v").between(low(i), high(i)), F.lit(i)) for i in range(len(names))]), lambda x: x.isNotNull())).alias("i")).groupBy(*by, "i", "v").agg(F.count("*").alias("m"))
    order = Window.partitionBy(*by, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    listed = inside.withColumn("last", F.sum("m").over(order)).withColumn("first", F.col("last") - F.col("m"))
    keys = [*by, "i"]
    both = listed.alias("a").join(told.alias("b"), same("a", "b") & (F.col("a.i") == F.col("b.i"))).select(*[F.col(f"b.{c}") for c in [*keys, "n", "below", "prev", "next"]], "v", "first", "last")
    share = F.element_at(F.array(*[F.lit(float(p)) for p in shares.values()]), F.col("i") + 1)
    at = share * (F.col("n") - 1) - F.col("below")  # place among the values within the bounds
    holds = lambda place: F.max(F.when((F.col("first") <= place) & (place < F.col("last")), F.col("v")))
    side = lambda place: F.coalesce(holds(place), F.max(F.when(place < 0, F.col("prev"))), F.max("next"))
    found = both.withColumns({"lo": F.floor(at), "hi": F.ceil(at), "f": at - F.floor(at)}).groupBy(*keys).agg(side(F.col("lo")).alias("x"), side(F.col("hi")).alias("y"), F.max("f").alias("f"))
    value = F.col("x") + F.col("f") * (F.col("y") - F.col("x"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, value)).alias(name) for i, name in enumerate(names)])


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with its rows' numbers by `order`, from 1: ranges of it are numbered apart, after the rows of the ranges before.

    The ranges are written to the shared folder, as they would be drawn anew each time.
    """
    ranges = kept(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranges.join(before, "_range").withColumn(name, F.col("_before") + own).drop("_range", "_before")
