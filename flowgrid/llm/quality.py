"""Quality selection by importance resampling.

Two generative models over hashed word and word-pair counts, one of target text (labelled good), one of all text, give
each document its importance weight: the ratio of the probabilities of its n-grams, kept as a log, the sum over them.
Gumbel noise is added to the log weights and the k largest keys are the sample: k draws without replacement in proportion
to weight^(1/temperature).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, sent_by_bytes, text_or_empty, written
from .pretokens import WordCache

BUCKETS = 1 << 14
#: Labelled rows used for the target model and the cut, of each class at most, by hash of doc_id.
LABELLED = 20_000
TEMPERATURE = 1.0  # draws in proportion to the weights themselves
PIECES = regex.compile(r"\w+|[^\w\s]+")
BINS = 1024


def _hashes(words: list[str]) -> list[bytes]:
    return [b"".join([zlib.crc32(p.encode("utf-8")).to_bytes(4, "little") for p in PIECES.findall(w)]) for w in words]


_words = WordCache(_hashes)


def ngrams(texts: list[str]) -> list[np.ndarray]:
    """Buckets of the words and of the adjacent word pairs of each whole text, repeats included."""
    lists = [t.split() for t in texts]
    known = _words.ready(lists)
    out = []
    for words in lists:
        one = np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u4").astype(np.uint64)
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
        out.append(np.concatenate([one % np.uint64(BUCKETS), two % np.uint64(BUCKETS)]).astype(np.int64))
    return out


@dataclass
class Model:
    """Log ratio of target to raw probability for each bucket, and the labelled doc_ids it was fitted on."""

    log_ratio: np.ndarray
    labelled: DataFrame


def labelled_sample(labels: DataFrame, n: int = LABELLED) -> DataFrame:
    """doc_id, quality of at most n labelled documents of each class; a document with both labels counts as bad."""
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    part = [one.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c in ("quality >= 1", "quality < 1")]
    return part[0].union(part[1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = LABELLED) -> Model:
    """Raw counts over all rows of docs, target counts over the sampled good ones; one scan, one row per bucket and task shuffled."""
    marked, _ = written(labelled_sample(labels, sample), "labelled")  # bounded by 2 x sample rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.join(F.broadcast(marked), "doc_id", "left").select("text", F.coalesce(F.col("quality") >= 1, F.lit(False)).alias("good"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in by_bytes(batches):
            for got, good in zip(ngrams(batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True):
                n = np.bincount(got, minlength=BUCKETS)
                total[0] += n
                if good:
                    total[1] += n
        at = np.flatnonzero(total[0])
        yield pa.record_batch([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "raw", "target"])

    counts = sent_by_bytes(rows).mapInArrow(counted, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts.bucket], target[counts.bucket] = counts.raw, counts.target
    smooth = lambda x: np.log((x + 1) / (x.sum() + BUCKETS))
    return Model(smooth(target) - smooth(raw), marked)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_grams and log_ratio (sum over the n-grams, the log of the importance weight; 0 for a text without words).  Map-only."""
    ratio = model.log_ratio
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            got = ngrams([t or "" for t in batch.column(at).to_pylist()])
            n = pa.array([len(x) for x in got], pa.int64())
            score = pa.array([float(ratio[x].sum()) for x in got], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n, score], names=[*batch.schema.names, "n_grams", "log_ratio"])

    return sent_by_bytes(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_grams", T.LongType()), T.StructField("log_ratio", T.DoubleType())]))


def sampling_key(temperature: float = TEMPERATURE, seed: int = 7) -> Column:
    """Log weight over temperature plus Gumbel noise; the noise is a function of doc_id and seed, so that a rerun draws the same.

    Rows without a doc_id share one draw, so among them the weight alone decides.
    """
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return F.col("log_ratio") / temperature - F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column, exactly, by narrowing histograms; BINS counts at a time reach the driver."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k > n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    inside, above = df.select(F.col(column).alias("v")), 0
    while n > BINS and low < high:
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            break
        bin_ = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        bins = sorted(inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), key=lambda r: -r["bin"])
        for r in bins:
            if above + r.n >= k:
                break
            above += r.n
        low, high, n = r.low, r.high, r.n
        inside = inside.where(F.col("v").between(F.lit(low), F.lit(high)))
    if low == high:
        return low
    values = inside.groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("v")).limit(BINS).collect()
    for r in values:
        above += r.n
        if above >= k:
            return r.v
    return values[-1].v


def best_cut(scores: list[tuple[float, int]]) -> float:
    """The log weight above which documents count as good: fewest labelled documents on the wrong side, the lowest such cut."""
    order = sorted(scores)
    wrong = sum(1 for _, q in order if q < 1)  # cut below all: every bad one is kept
    best, cut = wrong, float("-inf")
    for i, (score, q) in enumerate(order):
        wrong += 1 if q >= 1 else -1
        if wrong < best and (i + 1 == len(order) or order[i + 1][0] > score):
            best, cut = wrong, score
    return cut


@dataclass
class Selection:
    """What a selection decided: the model, the number of rows to draw and the smallest key drawn."""

    model: Model
    k: int
    threshold: float
    scores: DataFrame


def select(docs: DataFrame, labels: DataFrame, text: str = "text", k: int | None = None, temperature: float = TEMPERATURE, seed: int = 7, sample: int = LABELLED) -> Selection:
    """Fit, score all rows of docs and find the key of the k-th draw.

    k: rows to draw; by default as many as have a weight above the cut that best divides the labelled sample, or all
    rows if there are no labels of both classes.  Which rows these k are, weights and noise decide.  Ties at the last
    key stay, so repeated rows stay or go together.
    """
    model = fit(docs, labels, text, sample)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    scores, _ = written(scored(narrow, model).drop("text").withColumn("key", sampling_key(temperature, seed)), "scores")
    if k is None:
        known = scores.join(F.broadcast(model.labelled), "doc_id").groupBy("doc_id", "quality").agg(F.min("log_ratio").alias("s")).collect()  # 2 x sample rows at most
        cut = best_cut([(r.s, r.quality) for r in known]) if len({r.quality >= 1 for r in known}) == 2 else float("-inf")
        k = scores.where(F.col("log_ratio") > cut).count()
    return Selection(model, k, kth_largest(scores, "key", k), scores)


def sampled(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The drawn rows: doc_id, n_grams, log_ratio, key.

    A null text counts as empty (log weight 0); an empty table gives none; rows keep repeats; further columns are ignored;
    a text of any length is scored whole.
    """
    drawn = select(docs, labels, **options)
    return drawn.scores.where(F.col("key") >= drawn.threshold)


def kept(docs: DataFrame, labels: DataFrame, text: str = "text", temperature: float = TEMPERATURE, seed: int = 7, **options) -> DataFrame:
    """The drawn rows of docs with their own columns, of whatever name; texts are scored again rather than shuffled."""
    drawn = select(docs, labels, text, temperature=temperature, seed=seed, **options)
    columns = docs.columns
    inner = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return scored(inner, drawn.model).where(sampling_key(temperature, seed) >= drawn.threshold).select("row.*")
