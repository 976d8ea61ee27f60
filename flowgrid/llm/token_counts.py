"""Token counts by rank-synchronous array merging (see merging.py)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_or_empty
from .merging import WordMerger
from .pretokens import WordCache, resolved, vocabulary


class Counter:
    """Counts the symbols that survive merging; each new word of a batch is merged once."""

    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.merger = WordMerger(self.vocab)
        self.cache = WordCache(self.count_words)

    def count_words(self, words: list[str]) -> list[int]:
        special = [self.vocab.is_special(w) for w in words]
        _, counts = self.merger.merge([b"" if s else w.encode("utf-8") for w, s in zip(words, special, strict=True)])
        return np.where(special, 1, counts).tolist()

    def count(self, texts: list[str]) -> list[int]:
        lists = [self.vocab.words(t) for t in texts]
        known = self.cache.ready(lists)
        return [sum(map(known.__getitem__, x)) for x in lists]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, text: str = "text", vocab: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; a null text counts as empty (0 tokens).

    Map-only: rows keep their number and repeats, an empty table gives none; further columns of df are ignored.
    A special string inside a text is one token.  Words of 400 symbols and more are merged along links instead of by passes
    over whole arrays, in time about in proportion to their length; the result is the same.  vocab is a file name that public_tokenizers resolves on the
    executors, or an absolute path.
    """

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        n = counter(resolved(vocab)).count(texts)
        return pa.record_batch([batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return map_arrow(rows, per_batch, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
