"""Order MinHash fingerprints with DataFrame functions only.

Words are taken in k-mers, each k-mer is numbered by its occurrence in the text, and every slot of a signature takes
the TUPLE occurrence-numbered k-mers that come first under the slot's own random order, a hash of its own.  A tuple
keeps the order of the text and is hashed; two texts agree in a slot if they share the k-mers and their order, which
follows edit distance.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_or_empty

K = 3  # words of a k-mer
SLOTS = 32  # tuples of a signature
TUPLE = 2  # k-mers of a tuple
#: Words, or what stands for them in long runs without white space: runs of letters of one case or of digits, and other
#: characters (as of scripts without spaces) one by one, so that an insertion changes the words around it only.
WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,16}(?![^\x20\x09-\x0D])|[a-z]+|[A-Z]+|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9]"
#: Bits of a k-mer's place while equal ones are numbered; a text has fewer than 2^31 characters.
PLACE = 31
#: Documents that lie side by side in one bucket, and buckets at most (their bounds are held by the driver).
SIDE_BY_SIDE, MOST_BUCKETS = 1000, 1 << 17


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def numbered_kmers(text: Column) -> Column:
    """The hashes of a text's k-mers, numbered by occurrence, and their places, as a struct of two arrays.

    A text of fewer than K words is one k-mer.  Equal k-mers lie side by side once sorted; each run of them is
    numbered by a sequence from 0, and flattening the sequences numbers all.
    """
    low = (1 << PLACE) - 1
    place = lambda s: F.transform(s, lambda x: x.bitwiseAND(F.lit(low)).cast("int"))

    def kmers(words: Column) -> Column:
        hash_of = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(K)])
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - K, F.lit(0))), lambda i: F.shiftleft(hash_of(i), PLACE).bitwiseOR(i.cast("long"))))

    def numbered(s: Column) -> Column:
        own = F.transform(s, lambda x: F.shiftright(x, PLACE))
        differs = lambda h: F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
        runs = lambda h, starts: F.transform(starts, lambda a, j: F.sequence(F.lit(0), F.coalesce(F.get(starts, j + 1), F.size(h)) - a - 1))
        again = lambda h, occ: F.zip_with(h, occ, lambda x, o: F.when(o == 0, x).otherwise(F.xxhash64(x, o)))
        marked = lambda h: bound(differs(h), lambda starts: F.when(F.size(starts) == F.size(h), h).otherwise(again(h, F.flatten(runs(h, starts)))))
        return F.struct(bound(own, marked).alias("hash"), place(s).alias("at"))

    return bound(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda words: bound(kmers(words), numbered))


def signature(kmers: Column) -> Column:
    """The tuples' hashes: for each slot its first k-mers under its own order, in the order of the text."""
    hashes, places = kmers["hash"], kmers["at"]

    def tuple_of(order: Column, slot: Column, found: tuple[Column, ...] = ()) -> Column:
        if len(found) < TUPLE:
            left = order
            for x in found:
                left = F.array_remove(left, x)
            return bound(F.array_min(left), lambda x: tuple_of(order, slot, (*found, x)))
        own = F.filter(F.array(*found), lambda x: x.isNotNull())
        with_place = F.transform(own, lambda x: F.struct(F.get(places, F.array_position(order, x).cast("int") - 1).alias("at"), x.alias("kmer")))
        return F.xxhash64(slot, F.transform(F.sort_array(with_place), lambda x: x["kmer"])).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda slot: bound(F.transform(hashes, lambda h: F.xxhash64(h, slot)), lambda order: tuple_of(order, slot)))


def signed(text: Column) -> Column:
    """The signature of a text column."""
    return bound(numbered_kmers(text), signature)


def likeness(a: str, b: str) -> Column:
    """Share of slots in which two signatures agree."""
    return F.size(F.filter(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), lambda z: z["x"] == z["y"])) / F.lit(float(SLOTS))


def as_text(signature_: str) -> Column:
    """A signature as a string of 8 hexadecimal digits for each slot."""
    return F.lower(F.array_join(F.transform(signature_, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint of each row; a null text counts as empty.  Equal texts have equal fingerprints.  Map-only."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), as_text(signed(text_or_empty(text))).alias("fingerprint"))


def in_buckets(df: DataFrame, order: str, tie: str) -> tuple[DataFrame, list]:
    """df with bucket: contiguous ranges of (order, tie) of about SIDE_BY_SIDE rows, and the first (order, tie) of each bucket in use.

    Bounds come from approximate percentiles of order (any bounds are right); they are looked up in two levels.  Nulls are
    first.  A range that one value (or null) fills with far more rows is cut by tie, a hash, into even parts; what follows
    that value in the range comes after them.  At most twice MOST_BUCKETS parts are made.
    """
    n = df.count()
    buckets = max(16, min(MOST_BUCKETS, n // SIDE_BY_SIDE))
    cuts = sorted(set(df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or []))
    side = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    if not blocks:
        bucket = F.lit(0)
    else:
        array = lambda xs: F.expr(f"array({', '.join(f'{x}L' for x in xs)})")
        top = F.size(F.filter(array([b[0] for b in blocks]), lambda c: c <= F.col(order)))
        part = F.get(F.array(*[array(b) for b in blocks]), F.col("_top") - 1)
        df = df.withColumn("_top", top)
        # 0 is for nulls, 1 for what is below all bounds.
        bucket = F.when(F.col("_top") == 0, 1).otherwise((F.col("_top") - 1) * side + F.size(F.filter(part, lambda c: c <= F.col(order))) + 1)
    df = df.withColumn("range", F.when(F.col(order).isNull(), 0).otherwise(bucket).cast("int")).drop("_top")
    sizes = df.groupBy("range").agg(F.min(order).alias("least"), F.count("*").alias("n")).orderBy("range").collect()
    step = max(1, n // max(1, buckets))  # rows of a part
    hot, made = [], 0
    for r in sizes:
        parts = -(-r.n // step) if r.n > 4 * step else 1
        hot.append((r["range"], r.least, parts, made))
        made += parts + (parts > 1)
    # As many rows as there are ranges, MOST_BUCKETS + 1 at most.
    df = df.join(F.broadcast(df.sparkSession.createDataFrame(hot, "range int, least long, parts int, made int")), "range")
    share = F.floor((F.shiftright(F.col(tie), 32) + (1 << 31)) * F.col("parts") / float(1 << 32)).cast("int")  # tie is even over all longs
    within = F.when(F.col("parts") == 1, 0).when(F.col(order).eqNullSafe(F.col("least")), share).otherwise(F.col("parts"))
    df = df.withColumn("bucket", F.col("made") + within).drop("range", "least", "parts", "made")
    firsts = df.groupBy("bucket").agg(F.min(F.struct(order, tie)).alias("least")).orderBy("bucket").collect()
    return df, [(r.bucket, tuple(r.least)) for r in firsts]


def edited_fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """Each text against its edited form, whose last quarter is replaced by the beginning of the next document's text.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  Documents follow
    each other by doc_id (nulls first), repeated ones by a hash of their text; after the last comes the first.
    A null text counts as empty; an empty table gives none; further columns are ignored.

    Texts are dealt once, by ranges of doc_id and hash, so that neither rows without a doc_id nor those of one doc_id meet in
    one task; each range also gets the first document of the next one, and all that follows (neighbours, k-mers, minima)
    stays within a range.
    """
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    docs, firsts = in_buckets(docs, "doc_id", "hash")
    if not firsts:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_chars"), *[F.lit("").alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[F.lit(0.0).alias(c) for c in ("near_edited", "near_next")]).limit(0)
    after = [(before, *first) for (before, _), (_, first) in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    follow = F.broadcast(spark.createDataFrame(after, "bucket int, first long, first_hash long"))  # twice MOST_BUCKETS rows at most
    same = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("hash") == F.col("first_hash"))
    guests = docs.drop("bucket").join(follow, same).dropDuplicates(["bucket"]).select("doc_id", "text", "hash", "bucket", F.lit(1).alias("guest"))
    rows = docs.withColumn("guest", F.lit(0)).unionByName(guests)
    side = Window.partitionBy("bucket").orderBy("guest", "doc_id", "hash")
    rows = rows.repartition(len(firsts), "bucket").withColumn("next", F.lead("text").over(side))
    n_chars = F.length("text").cast("long")
    q = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - q), F.substring(F.coalesce("next", F.lit("")), F.lit(1), q))
    rows = rows.select("bucket", "guest", "doc_id", "hash", n_chars.alias("n_chars"), "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    rows = rows.withColumn("own", signed(F.col("text"))).drop("text")
    rows = rows.withColumn("next", F.lead("own").over(side)).where("guest = 0").withColumn("other", signed(F.col("edited")))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("other").alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"), likeness("own", "next").alias("near_next"))
