"""Best-fit packing by sum of squares.

Spark encodes the texts, cuts only documents longer than a sequence, and deals the pieces to shards of about SHARD pieces
by a hash.  In each shard every piece is placed, one by one, where the squared counts of open sequences per remaining gap
become smallest; shards are packed in parallel, by the same rule at any size of the corpus, and leave a few sequences
open each.  The rule needs nothing but the counts of a shard's lengths; Spark then numbers the shard's pieces of each
length and joins them to their places.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, text_or_empty, written
from .merging import WordMerger
from .pretokens import WordCache, resolved, vocabulary

#: Pieces of a shard, about.
SHARD = 1 << 16
#: Pieces shorter than this part of a sequence come last.
SHORT = 20


class IdBytes:
    """Token ids of whole texts as little-endian 32-bit integers."""

    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.merger = WordMerger(self.vocab)
        self.cache = WordCache(self.encode_words)

    def encode_words(self, words: list[str]) -> list[bytes]:
        special = [self.vocab.is_special(w) for w in words]
        flat, lengths = self.merger.merge([b"" if s else w.encode("utf-8") for w, s in zip(words, special, strict=True)])
        raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
        out = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for i in np.flatnonzero(special).tolist():
            out[i] = self.vocab.special[words[i][1:]].to_bytes(4, "little")
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        lists = [self.vocab.words(t) for t in texts]
        known = self.cache.ready(lists)
        return [b"".join(map(known.__getitem__, x)) for x in lists]


@lru_cache(maxsize=2)
def id_bytes(path: str) -> IdBytes:
    return IdBytes(path)


def pieces(df: DataFrame, text: str = "text", vocab: str = "word_bpe_49k.json", end_id: int = 1, size: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and end_id, cut every `size` ids where longer.  Null text: empty."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, end = batch.column(0).to_pylist(), end_id.to_bytes(4, "little")
        rows = []
        for doc, raw in zip(docs, id_bytes(resolved(vocab)).encode(batch.column(1).to_pylist()), strict=True):
            whole = memoryview(raw + end)
            rows += [(doc, i // (4 * size), i // 4, (len(part := whole[i : i + 4 * size])) // 4, zlib.crc32(part)) for i in range(0, len(whole), 4 * size)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return map_arrow(rows, per_batch, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int) -> pd.DataFrame:
    """Places of a shard's pieces, from the number of each length: length, rank (among the pieces of the length), seq, offset."""
    gaps: list[list[int]] = [[] for _ in range(size + 1)]  # gap -> its open sequences
    open_count = np.zeros(size + 1, dtype=np.int64)
    lengths = np.repeat(np.array(sorted(counts, reverse=True), np.int64), [counts[n] for n in sorted(counts, reverse=True)])
    # The rule is made for lengths in no order; the shortest come last, longest first, and fill what is left.
    first = int((lengths >= size // SHORT).sum())
    lengths[:first] = np.random.default_rng(size).permutation(lengths[:first])
    rank, new, places = dict.fromkeys(counts, 0), 0, []
    for length in lengths.tolist():
        # Change of the sum of squares for a place in gap h: one sequence fewer there, one more in h - length.
        after = open_count[: size + 1 - length].copy()
        after[0] = 0  # a full sequence is no longer open
        change = 2 * after + 1
        change[0] = 0
        there = open_count[length:]
        change -= 2 * there - 1
        change[there == 0] = np.iinfo(np.int64).max
        change[size - length] = 2 * open_count[size - length] + (length < size)  # a new sequence
        gap = length + int(np.argmin(change))
        if gap == size:
            seq, new = new, new + 1
        else:
            seq = gaps[gap].pop()
            open_count[gap] -= 1
        places.append((length, rank[length], seq, size - gap))
        rank[length] += 1
        if gap > length:
            gaps[gap - length].append(seq)
            open_count[gap - length] += 1
    return pd.DataFrame(places, columns=["length", "rank", "seq", "offset"])


def pack(cut: DataFrame, size: int = 4096, shard: int = SHARD) -> DataFrame:
    """The rows of pieces() with sequence_id and offset: sequences of at most `size` ids, gapless from 0.

    Rows with equal columns are separate pieces.  An empty table gives none.
    """
    cut, _ = written(cut, "pieces")
    shards = max(1, -(-cut.count() // shard))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(shards)))

    def placed(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        out = plan(dict(zip(counts["length"].tolist(), counts["n"].tolist(), strict=True)), size)
        return out.assign(shard=key[0])[["shard", "length", "rank", "seq", "offset"]]

    # A group has a row for each length, `size` at most, and gives a row for each piece of its shard.
    counts = dealt.groupBy("shard", "length").agg(F.count("*").alias("n"))
    places = counts.groupBy("shard").applyInPandas(placed, "shard long, length long, rank long, seq long, offset long")
    own = Window.partitionBy("shard", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", (F.row_number().over(own) - 1).cast("long"))
    sequence = F.shiftleft("shard", 32).bitwiseOR(F.col("seq")).alias("sequence_id")
    return ranked.join(places, ["shard", "length", "rank"]).select(*cut.columns, sequence, "offset")


def pack_texts(df: DataFrame, text: str = "text", vocab: str = "word_bpe_49k.json", end_id: int = 1, size: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of df.

    A null text counts as empty (one piece, the end id); a repeated row is packed again; an empty table gives none; further
    columns are ignored; a text of any length is encoded whole.
    """
    return pack(pieces(df, text, vocab, end_id, size), size)
