"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints that differ in at most `bits` bits agree in all but `bits` of `blocks` blocks.  Distinct fingerprints meet
on the agreeing blocks, and the Hamming distance of each pair is verified.  Buckets of more than PAIRS fingerprints are
not paired: there each fingerprint is listed under itself and under its neighbours one bit away (in the blocks that
may differ), and those listed under one neighbour are linked to the smallest of them.  Two fingerprints two bits apart
share such a neighbour, so no link between different fingerprints gets lost, and the work stays linear.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, map_arrow, removed, text_or_empty, written

#: Largest bucket that is paired; larger ones take the linear way, with the same links.
PAIRS = 16


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of word shingles as a signed integer; 0 for a text without words."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z only, and exactly the white space \x20 \x09-\x0D
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)], np.uint64, n)
    return bits_of(h)


def bits_of(h: np.ndarray) -> int:
    """The fingerprint of hashes (unsigned 64-bit) as a signed integer: a bit is 1 if set in over half of them."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (long) of each row; a null text counts as empty and has fingerprint 0.  Map-only, rows keep repeats."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return map_arrow(rows, per_batch, "doc_id long, fp long")


def masks(bits: int, blocks: int) -> list[int]:
    """The bits that each choice of agreeing blocks covers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(own, blocks - bits)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, bits: int = 2, blocks: int = 5) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints fp within 1 or 2 differing bits (transitively the same as all pairs)."""
    if bits not in (1, 2):
        raise ValueError("bits: 1 or 2")
    chosen = masks(bits, blocks)
    keys = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(chosen)])).alias("k")).select("k.c", "k.key", "fp")
    shared = keys.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1")
    met, path = written(keys.join(shared, ["c", "key"]), "blocks")
    few = met.where(F.col("n") <= PAIRS)
    pairs = few.alias("x").join(few.alias("y"), ["c", "key"]).where("x.fp < y.fp").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    flips = [F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << b)) for b in range(64) if not m >> b & 1]) for m in chosen]
    flip = reduce(lambda out, x: F.when(F.col("c") == x[0], x[1]).otherwise(out), enumerate(flips[1:], 1), flips[0])
    near = met.where(F.col("n") > PAIRS).select("fp", F.explode(flip).alias("f")).select(F.col("fp").bitwiseXOR(F.col("f")).alias("mid"), "fp").distinct()
    # At most 65 fingerprints are within one bit of another value, so no such group is large.
    stars = near.groupBy("mid").agg(F.array_sort(F.collect_set("fp")).alias("all")).where("size(all) > 1").select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 65)).alias("b"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found, _ = written(pairs.union(stars.distinct()).where(apart <= bits), "links")
    removed(distinct.sparkSession, path)
    return found


def near_duplicates(df: DataFrame, text: str = "text", width: int = 3, seed: int = 42, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, itself included.

    Copies share a fingerprint and are one node; a document whose doc_id is null takes part in links, and its class
    is named by the others (null if there are none).  Rows keep repeats; a null text counts as empty; a text of any length
    is read whole; an empty table gives none; further columns are ignored.
    """
    docs, _ = written(fingerprints(df, text, width, seed), "fingerprints")
    distinct, path = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes, _ = written(rooted.join(named, "root").select("fp", "component_id"), "classes")
    removed(df.sparkSession, path)
    return docs.join(classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(df: DataFrame, classes: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df that stay when of each class (doc_id, component_id) only the smallest doc_id does.

    Repeated rows of one doc_id and text count as one document and one of them stays.  Rows without a doc_id cannot be
    named as anyone's copy and all stay.
    """
    first = classes.where("doc_id = component_id").select("doc_id").distinct()
    own = Window.partitionBy("doc_id", F.xxhash64(text)).orderBy(F.length(text))
    stays = df.where("doc_id is not null").join(first, "doc_id", "left_semi").withColumn("_copy", F.row_number().over(own)).where("_copy = 1").drop("_copy")
    return stays.select(df.columns).union(df.where("doc_id is null"))


def representatives(df: DataFrame, text: str = "text", width: int = 3, seed: int = 42, bits: int = 2) -> DataFrame:
    """The rows of df that stay when of each group of near-duplicates only the smallest doc_id does; see first_of_each."""
    return first_of_each(df, near_duplicates(df, text, width, seed, bits), text)
