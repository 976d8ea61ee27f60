"""Filters, joins and tables of simulations: sims(sim_name, parameters ...), one row each."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flowgrid.functions.ranks import numbered

NUMERIC = (T.NumericType,)


def predicate(column: Column, wanted: list, numeric: bool) -> Column:
    """`<v` and `>v` strictly by the first value; else any of the list: numbers within 1e-7 + 1e-8 * |listed|, strings equal."""
    first = str(wanted[0])
    if first[:1] in "<>" and first:
        v = F.lit(float(first[1:]))
        return column < v if first[0] == "<" else column > v
    if numeric:
        return reduce(lambda a, b: a | b, [F.abs(column - float(w)) <= 1e-7 + 1e-8 * abs(float(w)) for w in wanted])
    return column.isin([str(w) for w in wanted])


def filter_sims(sims: DataFrame, parameters: dict[str, list | str | float]) -> DataFrame:
    """Simulations that meet all predicates; a leading `~` in a name negates.  A missing value meets none, and so a negated one."""
    kinds = {f.name: isinstance(f.dataType, NUMERIC) for f in sims.schema.fields}
    for name, wanted in parameters.items():
        wanted = wanted if isinstance(wanted, list) else [wanted]
        plain = name.lstrip("~")
        met = F.coalesce(predicate(F.col(plain), wanted, kinds[plain]), F.lit(False))
        sims = sims.where(~met if name.startswith("~") else met)
    return sims


def filter_thickness(sims: DataFrame, features: str, wanted: list, negate: bool = False) -> DataFrame:
    """Simulations all of whose features (an array column of thicknesses) match one of the values; an empty array matches none."""
    met = F.coalesce(F.forall(features, lambda v: predicate(v, wanted, True)) & (F.size(features) > 0), F.lit(False))
    return sims.where(~met if negate else met)


def filter_benchmarks(tests: DataFrame, wanted: list[str], how: str = "or", column: str = "tags") -> DataFrame:
    """Tests by name, or by tags: any of them (or), all of them (and)."""
    if how == "name":
        return tests.where(F.col("name").isin(wanted))
    tags = F.array(*[F.lit(w) for w in wanted])
    return tests.where(F.arrays_overlap(column, tags) if how == "or" else F.size(F.array_except(tags, F.col(column))) == 0)


def require_result_types(results: DataFrame, wanted: list[str]) -> DataFrame:
    """sim_name, missing: the wanted types that a simulation lacks, in order; only simulations that lack some."""
    have = results.groupBy("sim_name").agg(F.collect_set("res_type").alias("have"))
    missing = F.array_except(F.array(*[F.lit(w) for w in wanted]), "have")
    return have.select("sim_name", F.array_join(F.array_sort(missing), ",").alias("missing")).where("missing <> ''")


def select_reference_sim(sims: DataFrame, parameter: str, value: float | str, order: list[str], in_name: str | None = None) -> DataFrame:
    """One row: the simulation with the nearest number, or with the string (upper or lower case alike); the first in order wins.

    in_name: where the parameter says nothing (no number, or no equal string), the first whose sim_name holds it, and
    else the first of all.
    """
    if isinstance(value, str):
        rank = F.when(F.lower(parameter) == value.lower(), 0)
    else:
        rank = F.when(F.col(parameter).isNotNull(), 0)
    if in_name is not None:
        rank = rank.when(F.contains("sim_name", F.lit(in_name)), 1)
    far = F.lit(0.0) if isinstance(value, str) else F.abs(F.col(parameter) - value)
    return sims.orderBy(rank.otherwise(2), far, *order).limit(1)


def corner_shifts(headers: DataFrame, reference: str, threshold: float = 0.1) -> DataFrame:
    """Per layer: shift of its lower left and upper right corner against the reference layer's, and whether all are within threshold x cellsize.

    headers: layer, nrows, ncols, xll, yll, cellsize.
    """
    corners = headers.select("layer", "cellsize", "xll", "yll", (F.col("xll") + F.col("ncols") * F.col("cellsize")).alias("xur"), (F.col("yll") + F.col("nrows") * F.col("cellsize")).alias("yur"))
    ref = corners.where(F.col("layer") == reference).select(F.col("cellsize").alias("_size"), *[F.col(c).alias(f"_{c}") for c in ("xll", "yll", "xur", "yur")]).limit(1)
    on = corners.join(F.broadcast(ref))  # one row
    shift = lambda a, b: F.greatest(F.abs(F.col(a) - F.col(f"_{a}")), F.abs(F.col(b) - F.col(f"_{b}")))
    out = on.select("layer", shift("xll", "yll").alias("shift_ll"), shift("xur", "yur").alias("shift_ur"), (F.col("cellsize") == F.col("_size")).alias("same_size"), "_size")
    return out.withColumn("fits", F.col("same_size") & (F.greatest("shift_ll", "shift_ur") <= threshold * F.col("_size"))).drop("_size")


def validate_layers(layers: DataFrame, low: float, high: float) -> DataFrame:
    """Per layer: cells, missing ones, negative ones (nodata), values out of range, extent, whether it equals the extent most layers have."""
    v = F.col("value")
    own = layers.groupBy("layer").agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("n_null"), F.count_if(v < 0).alias("n_negative"), F.count_if((v > high) | ((v >= 0) & (v < low))).alias("n_out"), F.max("r").alias("r_max"), F.max("c").alias("c_max"))
    most = own.groupBy("r_max", "c_max").agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("r_max"), F.desc("c_max")).limit(1).select(F.col("r_max").alias("mr"), F.col("c_max").alias("mc"))
    return own.join(F.broadcast(most)).withColumn("same_extent", (F.col("r_max") == F.col("mr")) & (F.col("c_max") == F.col("mc"))).drop("mr", "mc")


def join_results_config(results: DataFrame, sims: DataFrame, on: list[str]) -> DataFrame:
    """Results with the parameters of their simulation."""
    return results.join(sims, on)


def exclude_existing_sims(new: DataFrame, old: DataFrame) -> DataFrame:
    """New simulations whose name is not present yet."""
    return new.join(old.select("sim_name"), "sim_name", "left_anti")


def order_sims(sims: DataFrame, by: list[str], ascending: bool = True) -> DataFrame:
    return sims.orderBy(*[F.asc(b) if ascending else F.desc(b) for b in by])


def union_ref_comp(reference: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of both with `is_ref`, the names that occur more than once: an error if there are any)."""
    both = reference.withColumn("is_ref", F.lit(True)).unionByName(other.withColumn("is_ref", F.lit(False)), allowMissingColumns=True)
    return both, both.groupBy("sim_name").agg(F.count("*").alias("n")).where("n > 1")


def common_types(a: DataFrame, b: DataFrame, column: str = "res_type") -> DataFrame:
    """Each name with whether both have it (intersection) or only one (symmetric difference)."""
    x, y = a.select(column).distinct().withColumn("in_a", F.lit(True)), b.select(column).distinct().withColumn("in_b", F.lit(True))
    return x.join(y, column, "full_outer").select(column, (F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("common"))


def latest_time_steps(steps: DataFrame, now: float) -> DataFrame:
    """Save times after now (by more than 1e-8), without time 0."""
    return steps.where((F.col("t") > now + 1e-8) & (F.col("t") > 0))


def coerce_numeric(table: DataFrame, keep: tuple[str, ...] = ("tSteps",)) -> DataFrame:
    """String columns whose values are all digits once `.` and `-` are gone, and hold no `|`, as doubles; "nan" is null.

    One pass decides for all columns.
    """
    names = [f.name for f in table.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep]
    plain = lambda c: F.regexp_replace(F.col(c), "[.-]", "")
    told = table.agg(*[F.coalesce(F.every(F.col(c).isNull() | (F.lower(c) == "nan") | plain(c).rlike("^[0-9]+$")), F.lit(False)).alias(c) for c in names], *[F.count_if(F.col(c).isNotNull() & (F.lower(c) != "nan")).alias(f"{c} n") for c in names]).first()
    return table.withColumns({c: F.when(F.lower(c) == "nan", None).otherwise(F.col(c)).try_cast("double") for c in names if told[c] and told[f"{c} n"]})


def config_diff(config: DataFrame, default: DataFrame) -> DataFrame:
    """sim_name, key, value, default_value, state (changed or added) where a simulation's key differs from the default.

    Numbers are compared as numbers, so that 1 and 1.0 are the same.
    """
    both = config.join(default.withColumnRenamed("value", "default_value"), "key", "left")  # keys of one file
    number = lambda c: F.col(c).try_cast("double")
    same = F.coalesce(number("value") == number("default_value"), F.col("value") == F.col("default_value"))
    return both.where(F.col("default_value").isNull() | ~same).select("sim_name", "key", "value", "default_value", F.when(F.col("default_value").isNull(), "added").otherwise("changed").alias("state"))


def sim_display_name(sims: DataFrame, parameters: list[str]) -> DataFrame:
    """sim_name, display_name: chosen parameters (name_value) put in after the hash, the second part of the name."""
    put = F.concat_ws("_", *[F.concat(F.lit(f"{p}_"), F.col(p).cast("string")) for p in parameters])
    return sims.select("sim_name", F.regexp_replace("sim_name", r"^([^_]+_[^_]+)(_|$)", F.concat(F.lit("$1_"), put, F.lit("$2"))).alias("display_name"))


# ---- value specifications ----
def expand_value_spec(specs: DataFrame, column: str = "spec") -> DataFrame:
    """Rows of specs with `i` and `value` for each number of its specification.

    `a:b:n` n values from a to b; `v$p$n` n values from v - p % to v + p %; `a|b` a list; a leading `&` only marks that
    the values are added to others.
    """
    s = F.regexp_replace(F.col(column), "^&", "")
    colon, dollar = F.split(s, ":"), F.split(s, r"\$")
    num = lambda parts, i: F.get(parts, F.lit(i)).cast("double")
    line = lambda a, b, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(n == 1, a).otherwise(a + i * (b - a) / F.greatest(n - 1, F.lit(1))))
    low, high = num(dollar, 0) * (1 - num(dollar, 1) / 100), num(dollar, 0) * (1 + num(dollar, 1) / 100)
    values = F.when(F.size(colon) == 3, line(num(colon, 0), num(colon, 1), F.get(colon, F.lit(2)).cast("int"))).when(F.size(dollar) == 3, line(low, high, F.get(dollar, F.lit(2)).cast("int"))).otherwise(F.transform(F.split(s, r"\|"), lambda x: x.cast("double")))
    return specs.select("*", F.posexplode(values).alias("i", "value"))


def parse_filter_spec(section: dict[str, str]) -> dict[str, list]:
    """A configuration section as predicates of filter_sims: lists by `|`, `a:b:n` and `v$p$n` as numbers, the rest as it is."""
    out: dict[str, list] = {}
    for key, text in section.items():
        if re.fullmatch(r"[^:|$]+:[^:|$]+:\d+", text):
            a, b, n = text.split(":")
            a, b, n = float(a), float(b), int(n)
            out[key] = [a + i * (b - a) / max(n - 1, 1) for i in range(n)]
        elif text.count("$") == 2:
            v, p, n = text.split("$")
            v, p, n = float(v), float(p) / 100, int(n)
            out[key] = [v * (1 - p) + i * 2 * v * p / max(n - 1, 1) for i in range(n)]
        else:
            out[key] = [x for x in text.split("|") if x]
    return {k: v for k, v in out.items() if v}


# ---- variations ----
def variation_grid(values: DataFrame, scenarios: DataFrame, sim_types: list[str]) -> DataFrame:
    """One row per combination of parameter values, release scenario and simulation type, with hash and name.

    values(name, value) is a small table of the values of each parameter; the product is taken lazily.  The hash is
    the first 10 hexadecimal digits of SHA-256 over the sorted parameters.
    """
    names = sorted(r[0] for r in values.select("name").distinct().collect())  # parameters, not rows
    product = scenarios.select("scenario").distinct().crossJoin(F.broadcast(values.sparkSession.createDataFrame([(t,) for t in sim_types], "sim_type string")))
    for n in names:
        product = product.crossJoin(values.where(F.col("name") == n).select(F.col("value").alias(n)).distinct())
    text = F.concat_ws(";", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in [*names, "scenario", "sim_type"]])
    product = product.withColumn("sim_hash", F.substring(F.sha2(text, 256), 1, 10))
    return product.withColumn("sim_name", F.concat_ws("_", "scenario", "sim_hash", "sim_type"))


def expand_thickness_variation(features: DataFrame, percent: float, steps: int) -> DataFrame:
    """Each feature's thickness in `steps` values from -percent to +percent: variation number, factor, thickness."""
    i = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("variation")
    factor = 1 - percent / 100 + F.col("variation") * (2 * percent / 100 / max(steps - 1, 1))
    return features.where("thickness is not null").select("feature_id", "scenario", "thickness", i).select("feature_id", "scenario", "variation", factor.alias("factor"), (F.col("thickness") * factor).alias("thickness"))


def resolve_thickness(features: DataFrame, default: float, configured: DataFrame | None = None) -> DataFrame:
    """Per scenario the ids and thicknesses of its features, joined by `|`, and a state: ok, default (all missing) or error (some missing)."""
    own = features
    if configured is not None:
        own = own.join(configured.withColumnRenamed("thickness", "set_thickness"), "feature_id", "left").withColumn("thickness", F.coalesce("set_thickness", "thickness")).drop("set_thickness")
    per = own.groupBy("scenario").agg(F.count("*").alias("n"), F.count("thickness").alias("known"), F.array_sort(F.collect_list(F.struct("feature_id", "thickness"))).alias("all"))
    state = F.when(F.col("known") == F.col("n"), "ok").when(F.col("known") == 0, "default").otherwise("error")
    value = lambda x: F.coalesce(x["thickness"], F.lit(default)).cast("string")
    return per.select("scenario", F.array_join(F.transform("all", lambda x: x["feature_id"].cast("string")), "|").alias("ids"), F.when(state != "error", F.array_join(F.transform("all", value), "|")).alias("thicknesses"), state.alias("state"))


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) that depends on seed and keys only, whatever the partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + 0.5) / float(1 << 53)


def sample_latin(draws: DataFrame, dimensions: list[str], seed: int, blocks: int = 256) -> DataFrame:
    """Latin hypercube over the rows of draws (id): each dimension has exactly one draw in each of n equal strata.

    A draw's stratum is its rank by a random number.  Ranks are counted in blocks of that number: the rows of the blocks
    before, then the place within the block, so that no window holds all draws.
    """
    total = draws.agg(F.count("*").alias("_n"))  # one row
    out = draws.join(F.broadcast(total))
    for d in dimensions:
        u = uniform(seed, F.lit(d), F.col("id"))
        out = out.withColumn("_u", u).withColumn("_b", F.floor(u * blocks).cast("int"))
        counts = out.groupBy("_b").agg(F.count("*").alias("_k"))  # `blocks` rows at most
        before = counts.select("_b", F.coalesce(F.sum("_k").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        rank = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_u", "id"))
        out = out.join(F.broadcast(before), "_b").withColumn(d, (rank - 1 + uniform(seed + 1, F.lit(d), F.col("id"))) / F.col("_n")).drop("_u", "_b", "_before")
    return out.drop("_n")


def scale_sample(sample: DataFrame, bounds: DataFrame) -> DataFrame:
    """Long draws (id, name, u) scaled to bounds (name, base, percent): value between base -+ percent."""
    low, width = F.col("base") * (1 - F.col("percent") / 100), 2 * F.col("base") * F.col("percent") / 100
    return sample.join(F.broadcast(bounds), "name").select("id", "name", (low + F.col("u") * width).alias("value"))  # a row for each parameter


def scenario_groups(features: DataFrame) -> DataFrame:
    """grp, scenario, n, names: features of each group and scenario.

    Blank group names get a running number by `ord`; scenario lists are split by comma and trimmed; blank is "NULL".
    """
    blank = F.trim("grp") == ""
    number = numbered(features.where(blank), "ord", "_number").withColumn("grp", F.lpad(F.col("_number").cast("string"), 5, "0")).drop("_number")
    named = features.where(~blank).withColumn("grp", F.trim("grp")).unionByName(number)
    each = named.withColumn("scenario", F.explode(F.split("scenario", ","))).withColumn("scenario", F.when(F.trim("scenario") == "", "NULL").otherwise(F.trim("scenario")))
    return each.groupBy("grp", "scenario").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
