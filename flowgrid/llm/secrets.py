"""Secret scans with DataFrame functions only.

Base spans come from three patterns.  Further candidates are all runs of token characters of at least a window's length:
for each character class a window slides along the candidate and its Shannon entropy is kept up by incremental counts
(one character leaves, one enters).  A candidate whose highest window entropy reaches the threshold of its class, and
that no allow-list entry suppresses, is added as a span of kind `entropy`; base spans always stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more characters; shorter runs hold no longer match
HEX = r"[0-9a-f]{24,}"
#: A whole run of token characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Counts of a window (at most 20) kept in one long, and bits of each.
PACKED, BITS = 12, 5
#: Character classes, narrowest first, with the entropy (bits) that a window has to reach.  Runs of one case only are
#: told from words by a window that hardly repeats a letter; shorter ones of these can't be told apart and stay out.
CLASSES = (("hex", r"^[0-9a-fA-F-]+$", 3.0), ("one case", r"^([a-z_=/+-]+|[A-Z_=/+-]+)$", 4.1), ("upper", r"^[A-Z0-9_=-]+$", 3.5), ("letters", r"^[A-Za-z_=/+-]+$", 3.85), ("mixed", r"^.+$", 3.8))
# What is known not to be a secret.
ALLOWED = (
    r"^[0-9_=+/-]+$",  # digits only: numbers, not keys
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?(key|token|secret)",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"(?i)^0123456789abcdef|abcdefghijklmnop",
    r"^[a-z]++(?:[_/-][a-z]++)*+[_/-]?[0-9]{1,4}$",  # words with a number at the end; possessive, as other groups recurse for each word
    r"^([A-Z]?[a-z]{2,24}+(?![a-z])|(?:An|As|At|Be|By|Do|Go|Id|If|In|Is|It|My|No|Of|On|Or|To|Up|We)(?![a-z])|[A-Z]{2,24}+(?![A-Z])|(?<![A-Za-z])[A-Za-z](?![A-Za-z])|[_/=+-])++$",  # words, in any case, one after another
    r"^sha(256|384|512)-",
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, body), offsets in code points, ends exclusive.

    The pieces between matches and the matches themselves take turns; lengths before a match add up to its start.
    The lengths are summed by blocks first, so that n matches take n * sqrt(n) steps at most.
    """
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    turns = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, b: F.struct(F.length(p).alias("skip"), F.length(b).alias("own"), b.alias("body")))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, z: s + z["skip"] + z["own"])

    def placed(z: Column) -> Column:
        side = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(z))).cast("int"))
        sums = lambda w: F.transform(F.sequence(F.lit(0), F.size(z) - 1, w), lambda a: total(F.slice(z, a + 1, w)))
        before = lambda w: F.aggregate(sums(w), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

        def one(x: Column, i: Column, w: Column, starts: Column) -> Column:
            block = F.floor(i / w).cast("int")
            start = F.get(starts, block) + total(F.slice(z, block * w + 1, i - block * w)) + x["skip"]
            return F.struct(start.alias("start"), (start + x["own"]).alias("end"), x["body"].alias("body"))

        return bound(side, lambda w: bound(before(w), lambda starts: F.transform(z, lambda x, i: one(x, i, w, starts))))

    return bound(turns, lambda z: F.when(F.size(z) > 0, placed(z)).otherwise(F.array().cast("array<struct<start:int,end:int,body:string>>")))


def window_entropy(body: Column) -> Column:
    """Highest Shannon entropy (bits) of a window of WINDOW characters sliding along a string of ALPHABET characters.

    With counts c in a window of w characters the entropy is log2(w) - sum(c * log2(c)) / w.  Counts, packed in a few
    longs, and sum are carried along; a step takes one character out of the counts and one in.
    """
    term = F.lit([0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)])
    place = F.lit([max(0, ALPHABET.find(chr(i))) for i in range(128)])
    ones = F.lit([1 << BITS * k for k in range(PACKED)])
    width, mask = F.lit(PACKED), F.lit((1 << BITS) - 1)
    word = lambda x: F.floor(x / width).cast("int")
    unit = lambda x: F.get(ones, x % width)
    count = lambda counts, x: F.floor(F.get(counts, word(x)) / unit(x)).cast("long").bitwiseAND(mask).cast("int")
    changed = lambda counts, x, by: F.transform(counts, lambda c, k: F.when(k == word(x), c + by * unit(x)).otherwise(c))
    none = F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // PACKED))
    state = lambda counts, total, least: F.struct(counts.alias("counts"), total.alias("sum"), least.alias("least"))

    def enter(acc: Column, x: Column) -> Column:
        came = count(acc["counts"], x)
        return state(changed(acc["counts"], x, 1), acc["sum"] + F.get(term, came + 1) - F.get(term, came), F.lit(math.inf))

    def slide(acc: Column, z: Column) -> Column:
        out, new = z["out"], z["new"]
        left, came = count(acc["counts"], out), count(acc["counts"], new)
        total = acc["sum"] + F.get(term, left - 1) - F.get(term, left) + F.get(term, came + 1) - F.get(term, came)
        moved = bound(total, lambda t: state(changed(changed(acc["counts"], out, -1), new, 1), t, F.least(acc["least"], t)))
        return F.when(out == new, acc).otherwise(moved)

    def along(ids: Column) -> Column:
        first = F.aggregate(F.slice(ids, 1, WINDOW), state(none, F.lit(0.0), F.lit(math.inf)), enter)
        turns = F.zip_with(F.slice(ids, 1, F.greatest(F.size(ids) - WINDOW, F.lit(0))), F.slice(ids, WINDOW + 1, F.size(ids)), lambda a, b: F.struct(a.alias("out"), b.alias("new")))
        return F.aggregate(turns, bound(first, lambda f: state(f["counts"], f["sum"], f["sum"])), slide)["least"]

    ids = F.transform(F.split(body, "", -1), lambda c: F.get(place, F.ascii(c)))
    return F.lit(math.log2(WINDOW)) - bound(F.slice(ids, 1, F.length(body)), along) / WINDOW


def is_secret(body: Column) -> Column:
    """Whether a candidate's highest window entropy reaches the threshold of its character class and nothing suppresses it."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | body.rlike(pattern)
    needed = F.lit(math.inf)
    for _, pattern, bits in reversed(CLASSES):
        needed = F.when(body.rlike(pattern), bits).otherwise(needed)
    return ~allowed & (window_entropy(body) >= needed - 1e-9)  # sums may end a little apart


def spans_of(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def joined(spans: Column) -> Column:
    name = lambda x: F.element_at(F.lit(list(KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat(name(x), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def secret_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (base and added) of each row.

    A null text counts as empty and has no spans; rows keep their number and repeats; an empty table gives none; further
    columns are ignored.  No shuffle: every step is a column expression, and texts without a trace of a pattern skip it.
    A long candidate takes steps in proportion to its length, a text of n candidates n * sqrt(n).
    """
    t = F.col("text")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    value = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
    assigned = F.filter(F.zip_with(spans_of(matches(t, ASSIGN), 0), value, lambda s, v: F.when(F.length(v) >= 6, s)), lambda s: s.isNotNull())
    rows = rows.withColumn("a", F.when(t.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"'\x20]*[:=]"), assigned).otherwise(none))
    rows = rows.withColumn("k", F.when(t.contains("AKIA"), spans_of(matches(t, ACCESS), 1)).otherwise(none))
    rows = rows.withColumn("h", F.when(t.rlike(HEX), spans_of(matches(t, HEX), 2)).otherwise(none))
    rows = rows.withColumn("base", F.array_sort(F.concat("a", "k", "h")))
    free = lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    added = F.filter(matches(t, CANDIDATE), lambda m: free(m) & is_secret(m["body"]))
    rows = rows.withColumn("e", F.when(t.rlike(CANDIDATE), spans_of(added, 3)).otherwise(none))
    return rows.select("doc_id", *[F.size(c).cast("long").alias(n) for c, n in (("a", "n_assign"), ("k", "n_access"), ("h", "n_hex"))], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "e"))).alias("spans"))
