"""Near-duplicates by SimHash blocks, Hamming distance and exact Jaccard similarity of word shingles.

First the SimHash way (simhash.links): fingerprints of the shingle sets meet on pigeonhole blocks, their Hamming distance is
verified, and pairs of BITS differing bits or fewer are compared in full.  It links the nearest copies, and what it has linked
is not compared again.

A similarity of 0.8 lets 64-bit fingerprints differ in up to a quarter of their bits; blocks that such pairs must share
would be of four bits each, which tells nothing apart.  So the sets also meet on blocks of their shingles, where pairs
farther apart are found: two sets of similarity t or more share a shingle among the first n - ceil(t * n) + 1 of either in any
one order of all shingles, and at the first one they share enough must remain on both sides.  Nothing similar is lost.
Shingles that a sample finds common come last in the order; the sample only decides how many pairs meet, never which are
linked.  Pairs that met are verified by the Hamming distance of their fingerprints (sets of FEW shingles and more), then
compared in full.

In a bucket of more than PAIRS sets all are compared with a leader first: any one, then the one whose fingerprint is
nearest to the majority's, which near copies of one text have in common, then so for what is not with the largest
component; then all pairs that are not yet in one component are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, map_arrow, removed, sent_by_bytes, text_or_empty, written
from .simhash import bits_of, first_of_each, signed
from .simhash import links as near_fingerprints

PAIRS = 4
ROUNDS = 3
#: Bounds of the sample that orders shingles: texts, and common shingles kept.
SAMPLE, COMMON = 10_000, 200_000
#: Fingerprints of sets of FEW shingles and more, of similarity 0.8, differ in 10 bits of 64 give or take 3; FAR is beyond
#: five deviations, and unrelated ones differ in 32 give or take 4.
FEW, FAR = 50, 27
#: Differing bits that the SimHash blocks cover.
BITS = 2
Order = tuple[np.ndarray, np.ndarray]


def shingles(text: str, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)], np.uint64, n))


def name_of(own: np.ndarray) -> int:
    """Equal sets have equal names."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).astype(np.int64))


def needed(n: int, t: float) -> int:
    """Shingles of n that a set of similarity t has to share."""
    return math.ceil(t * n - 1e-9)


def prefix(own: np.ndarray, order: Order, t: float) -> np.ndarray:
    """The first shingles of a set, rare ones first, of which a similar set has at least one."""
    common, count = order
    n = len(own)
    if not n:
        return own.view(np.int64)
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank = np.where(common[at] == own, count[at], 0)
    return own[np.argsort(rank, kind="stable")][: n - needed(n, t) + 1].view(np.int64)


def common_shingles(rows: DataFrame, width: int, seed: int) -> Order:
    """Shingles found in two or more different sets of a sample, sorted, with their counts; at most COMMON of them."""
    total = rows.count()
    part = rows if total <= SAMPLE else rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / total))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [shingles(t, width, seed).view(np.int64) for t in batch.column(0).to_pylist()]
        return pa.record_batch([pa.array([x.tolist() for x in own], pa.list_(pa.int64()))], names=["own"])

    found = map_arrow(part.select("text").distinct(), per_batch, "own array<long>").select(F.explode("own").alias("h")).groupBy("h").count()
    top = found.where("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).toPandas()
    common = top["h"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(common)
    return common[by], top["count"].to_numpy(np.int64)[by]


def similar(pairs: DataFrame, texts: DataFrame, t: float, width: int, seed: int) -> DataFrame:
    """The pairs (a, b) whose sets have similarity t or more, compared in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            stays = []
            for x, ta, tb in zip(a, batch.column(2), batch.column(3), strict=True):
                if x != last:
                    last, own = x, shingles(ta.as_py(), width, seed)
                other = shingles(tb.as_py(), width, seed)
                both = len(np.intersect1d(own, other, assume_unique=True))
                stays.append(both >= t * (len(own) + len(other) - both) - 1e-9)
            yield pa.record_batch([pa.array([x for x, s in zip(a, stays, strict=True) if s], pa.int64()), pa.array([x for x, s in zip(b, stays, strict=True) if s], pa.int64())], names=["a", "b"])

    # The ids that met are a written table, so that Spark knows its size: where it is small texts are not shuffled to find them.
    met, met_path = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "met")
    own, own_path = written(texts.join(met, "doc_id", "left_semi").repartition("doc_id").dropDuplicates(["doc_id", "hash"]), "texts")
    both = sent_by_bytes(pairs).join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    found, _ = written(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "similar")
    removed(pairs.sparkSession, met_path)
    removed(pairs.sparkSession, own_path)
    return found


def leaders(crowd: DataFrame, rest: bool) -> DataFrame:
    """key and one row of each bucket: the nearest to the majority of its fingerprints, or to that of the rows outside its largest component."""
    if rest:
        most = crowd.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", "count").alias("most"))
        crowd = crowd.join(most, "key").where("root <> most").drop("most")
    ones = [F.sum(F.shiftrightunsigned("bits", b).bitwiseAND(F.lit(1))) for b in range(64)]
    bit = [F.when(2 * c > F.count("*"), F.lit(signed(1 << b))).otherwise(F.lit(0).cast("long")) for b, c in enumerate(ones)]
    middle = crowd.groupBy("key").agg(reduce(lambda x, y: x.bitwiseOR(y), bit).alias("middle"))
    far = F.bit_count(F.col("bits").bitwiseXOR(F.col("middle")))
    return crowd.join(middle, "key").groupBy("key").agg(F.min_by(F.struct("id", "n", "i", "bits", "root"), F.struct(far, "id")).alias("y")).select("key", "y.*")


def near_pairs(sets: DataFrame, t: float) -> DataFrame:
    """Pairs (a, b) of sets (id, n, bits) that the SimHash blocks put together, BITS differing bits apart or fewer.

    Sets of one fingerprint are paired with the smallest of them, which stands for them beside other fingerprints; pairs
    whose sizes rule out similarity t are left out.  Of the pairs of each b the one with the smallest a stays, so texts of a
    crowd are compared once each; the shingle buckets compare what that leaves unlinked.
    """
    own, path = written(sets.groupBy("bits").agg(F.min(F.struct("id", "n")).alias("least")).select("bits", F.col("least.id").alias("head"), F.col("least.n").alias("m")), "fingerprints")
    equal = sets.join(own, "bits").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"), F.col("m").alias("x"), F.col("n").alias("y"))
    side = lambda bits, id_, n: own.select(F.col("bits").alias(bits), F.col("head").alias(id_), F.col("m").alias(n))
    apart = near_fingerprints(own.select(F.col("bits").alias("fp")), BITS).join(side("a", "u", "x"), "a").join(side("b", "v", "y"), "b")
    pairs = equal.union(apart.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "x", "y"))
    found, _ = written(pairs.where("a < b").where(F.least("x", "y") >= F.lit(t) * F.greatest("x", "y") - 1e-6).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "near")
    removed(sets.sparkSession, path)
    return found


def links(sets: DataFrame, keys: DataFrame, texts: DataFrame, t: float, width: int, seed: int) -> DataFrame:
    """(node, root) of sets linked by similarity t or more.

    sets: id, n (size), bits (fingerprint); keys: key, id, n, i (place of key in the set's order), bits; texts: doc_id, text,
    hash (of the text).
    """

    def may(x: Column, y: Column) -> Column:
        """Whether two rows of a bucket can be similar, by sizes, places of the key and fingerprints."""
        smaller = F.least(x["n"], y["n"])
        least = F.ceil(F.lit(t / (1 + t)) * (x["n"] + y["n"]) - 1e-6)
        near = (smaller < FEW) | (F.bit_count(x["bits"].bitwiseXOR(y["bits"])) <= FAR)
        return (smaller >= F.lit(t) * F.greatest(x["n"], y["n"]) - 1e-6) & (F.least(x["n"] - x["i"], y["n"] - y["i"]) >= least) & near

    ends = (F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    shared = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met, met_path = written(keys.join(shared, "key"), "buckets")
    few, crowded = met.where(F.col("m") <= PAIRS), met.where(F.col("m") > PAIRS)
    # Large buckets of the same sets are one bucket, with the first place that each set has in any of them.
    same = crowded.groupBy("key").agg(F.bit_xor(F.xxhash64("id")).alias("u"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("v"))
    as_one = crowded.join(same, "key").groupBy(F.xxhash64("m", "u", "v").alias("key"), "id", "n", "bits").agg(F.min("i").alias("i"))
    large, large_path = written(as_one, "large")
    # Near copies share many keys, whose small buckets hold the same pairs: those are put together before they are spread.
    rows = F.array_sort(F.collect_list(F.struct("id", "n", "i", "bits")))
    later = lambda x, k: F.filter(F.slice("own", k + 2, PAIRS), lambda y: (x["id"] < y["id"]) & may(x, y))
    pairs = F.flatten(F.transform("own", lambda x, k: F.transform(later(x, k), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))
    found = few.groupBy("key").agg(rows.alias("own")).select(pairs.alias("pairs")).where("size(pairs) > 0").distinct().select(F.explode("pairs").alias("p")).select("p.a", "p.b")
    near = near_pairs(sets, t)
    edges = similar(near, texts, t, width, seed)
    roots = components(edges)
    # What the SimHash blocks have linked is not compared again.
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    found = found.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    for k in range(ROUNDS + 1):
        named = large.join(roots.withColumnRenamed("node", "id"), "id", "left").select(*large.columns, F.coalesce("root", "id").alias("root"))
        open_ = named.groupBy("key").agg(F.min("root").alias("u"), F.max("root").alias("v")).where("u <> v").select("key")
        crowd, _ = written(named.join(open_, "key", "left_semi"), "crowd")
        if k and crowd.isEmpty():
            break
        if k == 0:
            lead = crowd.groupBy("key").agg(F.min_by(F.struct("id", "n", "i", "bits", "root"), F.xxhash64("id")).alias("y")).select("key", "y.*")
        else:
            lead = leaders(crowd, k > 1) if k < ROUNDS else crowd
        own = [{c: F.col(f"{side}.{c}") for c in ("n", "i", "bits")} for side in "xy"]
        more = crowd.alias("x").join(lead.alias("y"), "key").where("x.root <> y.root").where((F.col("x.id") < F.col("y.id")) | F.lit(k < ROUNDS)).where(may(*own)).select(*ends)
        pairs, pairs_path = written((found.union(more) if k == 0 else more).distinct(), "pairs")
        new = similar(pairs, texts, t, width, seed)
        removed(pairs.sparkSession, pairs_path)
        edges = edges.union(new)
        roots = components(edges)
    removed(keys.sparkSession, met_path)
    removed(keys.sparkSession, large_path)
    return roots


def near_duplicates(df: DataFrame, text: str = "text", t: float = 0.8, width: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, component_id: the smallest doc_id reachable over pairs of Jaccard similarity t or more, itself included.

    Equal sets are one node, named by their smallest doc_id.  Null texts count as empty; empty texts are copies of each
    other, and so are repeated rows.  A row without a doc_id has no class (null).  A doc_id with several texts is in the
    first of their classes.  An empty table gives none; further columns are ignored.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    order = common_shingles(rows, width, seed)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for x in batch.column(1):
            own = shingles(x.as_py(), width, seed)
            out.append((name_of(own), len(own), bits_of(own), prefix(own, order, t)))
        first = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x[3]) for x in out]), pa.int32()), pa.array(np.concatenate([x[3] for x in out])))
        return pa.record_batch([batch.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))), first], names=["doc_id", "fp", "n", "bits", "first"])

    docs, docs_path = written(map_arrow(rows.where("doc_id is not null"), per_batch, "doc_id long, fp long, n int, bits long, first array<long>"), "shingled")
    # Equal sets, and the texts of one doc_id, are one node; the smallest doc_id of equal sets stands for them.
    distinct, _ = written(docs.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    named, _ = written(docs.select("doc_id", "fp").distinct().join(distinct, "fp"), "named")
    heads = docs.join(named.where("doc_id = id").select("doc_id", "fp").distinct(), ["doc_id", "fp"], "left_semi").dropDuplicates(["fp"])
    sets, _ = written(heads.select(F.col("doc_id").alias("id"), "n", "bits"), "sets")
    # Keys are cut to 40 bits, which pack better; two that fall together only make more pairs meet.
    keys = heads.select(F.col("doc_id").alias("id"), "n", "bits", F.posexplode("first").alias("i", "key")).withColumn("key", F.col("key").bitwiseAND(F.lit((1 << 40) - 1)))
    texts = rows.where("doc_id is not null").withColumn("hash", F.xxhash64("text"))
    roots = links(sets, keys, texts, t, width, seed).withColumnRenamed("node", "id")
    classes, _ = written(named.join(roots, "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "id")).alias("component_id")), "classes")
    removed(df.sparkSession, docs_path)
    return df.select(F.col("doc_id").cast("long").alias("doc_id")).join(classes, "doc_id", "left")


def representatives(df: DataFrame, text: str = "text", t: float = 0.8, width: int = 5, seed: int = 42) -> DataFrame:
    """The rows of df that stay when of each group of near-duplicates only the smallest doc_id does; see first_of_each."""
    return first_of_each(df, near_duplicates(df, text, t, width, seed), text)
