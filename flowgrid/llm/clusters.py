"""Centroid clustering with heap-ordered bounds, on integer vectors.

Vectors lie in blocks.  For each block and cluster there is a heap of the cluster's vectors, keyed by the gap between the
distance to the next best centroid and to their own, plus what the cluster's bounds had drifted by when the key was made.
A round adds to each cluster's drift how far its centroid moved and how far any other did; only vectors at the top of a
heap whose key the drift has reached are popped and scanned against all centroids, exactly.  What they change in the
sums of the clusters is all that leaves a block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, removed, sent_by_bytes, written

K, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
#: Vectors of a block.
BLOCK = 1024
#: Components below this give squared distances of 64 components that fit a long.
LIMIT = 1 << 27
#: Bounds are floats and distances exact, so gaps count as smaller by this share.
SLACK = 1e-9
STATE = "ids binary, known binary, vectors binary, sizes array<int>, keys binary, places binary, moved array<long>, scanned long"


def integers(df: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, v: vectors of dim components, none null or not finite, as floor(scale * x).  Beyond LIMIT they are left out."""
    x = F.col("embedding").cast("array<double>")
    inside = F.forall(x, lambda c: c.isNotNull() & (c * scale >= -LIMIT) & (c * scale < LIMIT))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c).cast("int"))
    return df.where((F.size("embedding") == dim) & inside).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column for each centroid."""
    wide = vectors.astype(np.int64)
    return np.stack([np.einsum("ij,ij->i", d, d) for d in (wide - c for c in centroids)], axis=1)


def scan(vectors: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (ties: the smaller number) and its heap key."""
    far = squared(vectors, centroids)
    own = far.argmin(axis=1)
    rows = np.arange(len(own))
    near = np.sqrt(far[rows, own].astype(np.float64))
    far[rows, own] = np.iinfo(np.int64).max
    other = np.sqrt(far.min(axis=1).astype(np.float64)) if len(centroids) > 1 else np.full(len(own), np.inf)
    return own, np.where(np.isinf(other), np.inf, other - near - SLACK * (other + near)) + drift[own]


class Block:
    """Vectors and the heaps of their clusters; heaps are arrays in heap order until something has to be popped or pushed."""

    def __init__(self, vectors: np.ndarray, k: int) -> None:
        self.vectors, self.heaps = vectors, [(np.empty(0), np.empty(0, np.int32))] * k
        self.moved, self.scanned = np.zeros((k, vectors.shape[1] + 1), np.int64), 0

    def expired(self, cluster: int, drift: float) -> list[int]:
        """Pops what the drift has reached."""
        keys, places = self.heaps[cluster]
        reached = drift * (1 + SLACK) + SLACK
        if not len(keys) or keys[0] > reached:
            return []
        heap, out = list(zip(keys.tolist(), places.tolist(), strict=True)), []
        while heap and heap[0][0] <= reached:
            out.append(heapq.heappop(heap)[1])
        self.heaps[cluster] = np.array([x for x, _ in heap]), np.array([p for _, p in heap], np.int32)
        return out

    def pushed(self, cluster: int, keys: np.ndarray, places: np.ndarray) -> None:
        own, at = self.heaps[cluster]
        if len(keys) * 4 > len(own):
            keys, places = np.concatenate([own, keys]), np.concatenate([at, places])
            by = np.argsort(keys, kind="stable")  # sorted is a heap
            self.heaps[cluster] = keys[by], places[by].astype(np.int32)
            return
        heap = list(zip(own.tolist(), at.tolist(), strict=True))
        for x in zip(keys.tolist(), places.tolist(), strict=True):
            heapq.heappush(heap, x)
        self.heaps[cluster] = np.array([x for x, _ in heap]), np.array([p for _, p in heap], np.int32)

    def assign(self, popped: np.ndarray, was: np.ndarray | None, centroids: np.ndarray, drift: np.ndarray) -> None:
        """Scans the popped vectors and pushes them where they belong now; notes the change of counts and sums."""
        own, keys = scan(self.vectors[popped], centroids, drift)
        self.scanned += len(popped)
        for c in range(len(centroids)):
            here = own == c
            if here.any():
                self.pushed(c, keys[here], popped[here])
            for sign, changed in ((1, here if was is None else here & (was != c)), (-1, None if was is None else (was == c) & ~here)):
                if changed is not None and changed.any():
                    self.moved[c, 0] += sign * int(changed.sum())
                    self.moved[c, 1:] += sign * self.vectors[popped[changed]].astype(np.int64).sum(axis=0)

    def round(self, centroids: np.ndarray, drift: np.ndarray) -> None:
        self.moved[:], self.scanned = 0, 0
        out = [(c, p) for c in range(len(centroids)) for p in self.expired(c, float(drift[c]))]
        if out:
            was, popped = np.array(out, np.int64).T
            self.assign(popped, was, centroids, drift)


def packed(ids: bytes, known: bytes, block: Block) -> dict:
    return {
        "ids": ids, "known": known, "vectors": block.vectors.tobytes(), "sizes": [len(k) for k, _ in block.heaps], "keys": np.concatenate([k for k, _ in block.heaps]).tobytes(),
        "places": np.concatenate([p for _, p in block.heaps]).astype(np.int32).tobytes(), "moved": block.moved.ravel().tolist() if block.moved.any() else None, "scanned": block.scanned,
    }


def unpacked(row: dict, dim: int) -> Block:
    n = sum(row["sizes"])
    raw = row["vectors"]
    block = Block(np.frombuffer(raw, np.int16 if len(raw) == 2 * n * dim else np.int32).reshape(n, dim), len(row["sizes"]))
    ends = np.cumsum(row["sizes"])[:-1]
    block.heaps = list(zip(np.split(np.frombuffer(row["keys"]), ends), np.split(np.frombuffer(row["places"], np.int32), ends), strict=True))
    return block


SCHEMA = pa.schema([("ids", pa.binary()), ("known", pa.binary()), ("vectors", pa.binary()), ("sizes", pa.list_(pa.int32())), ("keys", pa.binary()), ("places", pa.binary()), ("moved", pa.list_(pa.int64())), ("scanned", pa.int64())])


def in_blocks(vectors: DataFrame, centroids: np.ndarray, dim: int) -> DataFrame:
    """The first round: vectors in blocks, each scanned."""
    none = np.zeros(len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in by_bytes(batches):
            for at in range(0, big.num_rows, BLOCK):
                batch = big.slice(at, BLOCK)
                own = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dim)
                if np.abs(own).max() < 1 << 15:
                    own = own.astype(np.int16)
                block = Block(own, len(centroids))
                block.assign(np.arange(len(own)), None, centroids, none)
                ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pylist([packed(ids.tobytes(), known.tobytes(), block)], SCHEMA)

    return sent_by_bytes(vectors).mapInArrow(run, STATE)


def next_round(state: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            for row in batch.to_pylist():
                block = unpacked(row, dim)
                block.round(centroids, drift)
                yield pa.RecordBatch.from_pylist([packed(row["ids"], row["known"], block)], SCHEMA)

    return sent_by_bytes(state).mapInArrow(run, STATE)


def clustered(df: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid (integers) of every kept vector.

    Kept are vectors of dim components, none null or not finite, nor of 2^27 / scale or more, whose squared distances no
    long holds.  The first centroids are the k vectors with the smallest sha256 of `seed:vec_id` (equal ones by their
    components), fewer if there are fewer.  Repeated rows are separate vectors, a null vec_id hashes as an empty one.  An
    empty table gives none; further columns are ignored.

    A round reads and writes the blocks once, without a shuffle, and brings k * (dim + 1) sums to the driver.
    """
    spark = df.sparkSession
    vectors = integers(df, dim, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = vectors.orderBy(digest, "v").limit(k).select("v").collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r.v for r in first], np.int64)
    k = len(centroids)
    drift, totals = np.zeros(k), np.zeros((k, dim + 1), object)
    state, path = written(in_blocks(vectors, centroids, dim), "blocks")
    for _ in range(rounds):
        for r in state.select(F.posexplode("moved").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
            totals[r["at"] // (dim + 1), r["at"] % (dim + 1)] += int(r["x"])
        new = np.array([[int(s) // int(t[0]) for s in t[1:]] if t[0] else c for t, c in zip(totals, centroids.tolist(), strict=True)], np.int64)
        step = np.array([math.sqrt(sum(x * x for x in row)) for row in (new - centroids).tolist()])
        if not step.any():
            break  # nothing moves any more: further rounds give the same
        drift = drift + step + np.array([max([0.0, *np.delete(step, c)]) for c in range(k)])
        centroids, old = new, path
        state, path = written(next_round(state, centroids, drift), "blocks")
        removed(spark, old)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            for row in batch.to_pylist():
                block = unpacked(row, dim)
                own = np.empty(len(block.vectors), np.int32)
                for c, (_, places) in enumerate(block.heaps):
                    own[places] = c
                apart = block.vectors.astype(np.int64) - centroids[own]
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["known"], bool))
                yield pa.record_batch([ids, pa.array(own), pa.array(np.einsum("ij,ij->i", apart, apart))], names=["vec_id", "cluster", "distance"])

    found, _ = written(sent_by_bytes(state).mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    removed(spark, path)
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    total = sum(sums.values())
    long = lambda x: x if x < 1 << 63 else None
    rows = [(c, long(s), long(total), centroids[c].tolist()) for c, s in sums.items()]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows


def with_digests(found: DataFrame) -> DataFrame:
    """The rows of clustered() with centroid_sha256 for the centroid."""
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",").cast("binary"), 256)
    return found.withColumn("centroid_sha256", digest).drop("centroid")

