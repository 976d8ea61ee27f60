"""BPE encoding and decoding by speculation and verification.

A greedy longest match proposes the tokens of each new word.  A segmentation is the one BPE gives exactly when every
token stands for itself and every adjacent pair of tokens, encoded together, stays as it is; numpy looks all adjacent
pairs up in sorted arrays of known verdicts.  Only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_or_empty
from .merging import WordMerger, merge_all
from .pretokens import WordCache, resolved, vocabulary

#: Verdicts on token pairs that one worker keeps before it starts anew.
CACHE_PAIRS = 1_000_000


class Encoder:
    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.base = max(self.vocab.tokens) + 1
        self.reach: dict[str, int] = {}  # longest token by its first two symbols
        for token in self.vocab.ids:
            self.reach[token[:2]] = max(len(token), self.reach.get(token[:2], 1))
        self.codes = np.empty(0, dtype=np.int64)  # sorted pair codes with a verdict; code base*base + t is token t by itself
        self.fine = np.empty(0, dtype=bool)
        self.words = WordCache(self.encode_words)
        self.merger = WordMerger(self.vocab)
        self.spell = lru_cache(maxsize=None)(self.initial)  # as many entries as the vocabulary at most
        self.names = {str(i): s for i, s in self.vocab.tokens.items()}
        self.failed = self.checked = 0

    def initial(self, token: int) -> list[int]:
        """The symbols a token is made of."""
        s, end, ids = self.vocab.tokens[token], self.vocab.suffix, self.vocab.ids
        if end and s.endswith(end) and s != end:
            s = s[: -len(end)]
            return [*(ids[c] for c in s[:-1]), ids[s[-1] + end]]
        return [ids[c] for c in s]

    # -- speculation --
    def proposed(self, spelled: str) -> list[int]:
        s, ids, out, i = spelled, self.vocab.ids, [], 0
        end, n = self.vocab.suffix, len(spelled)
        while i < n:
            reach = self.reach.get(s[i : i + 2], 1)
            token = ids.get(s[i:] + end) if n - i <= reach or n - i < 3 else None
            if token is not None:
                out.append(token)
                break
            for j in range(min(n - 1 if end else n, i + reach), i, -1):
                token = ids.get(s[i:j])
                if token is not None:
                    out.append(token)
                    i = j
                    break
            else:
                out.append(ids[s[i]])  # every byte symbol is in the vocabulary
                i += 1
        return out

    # -- verification --
    def verdicts(self, code: np.ndarray) -> np.ndarray:
        """Whether each pair code is compatible; unknown ones are settled by merging the two tokens' symbols exactly."""
        known = np.zeros(len(code), dtype=bool)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = self.codes[at] == code
        new = np.unique(code[~known])
        if len(new):
            if len(self.codes) + len(new) > CACHE_PAIRS:
                self.codes, self.fine, new = self.codes[:0], self.fine[:0], np.unique(code)
            left, right = np.divmod(new, self.base)
            alone = left == self.base
            parts = [self.spell(b) if single else self.spell(a) + self.spell(b) for a, b, single in zip(left.tolist(), right.tolist(), alone.tolist(), strict=True)]
            lengths = np.array([len(x) for x in parts], dtype=np.int64)
            flat, left_over = merge_all(np.array([s for x in parts for s in x], dtype=np.int64), lengths, self.merger.table)
            start = np.cumsum(left_over) - left_over
            good = (left_over == np.where(alone, 1, 2)) & (flat[start] == np.where(alone, right, left)) & (flat[start + left_over - 1] == right)
            codes, fine = np.append(self.codes, new), np.append(self.fine, good)
            order = np.argsort(codes)
            self.codes, self.fine = codes[order], fine[order]
        return self.fine[np.searchsorted(self.codes, code)]

    def verified(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which ragged proposals are right."""
        seq = np.repeat(np.arange(len(lengths)), lengths)
        alone = self.verdicts(self.base * self.base + flat)
        bad = np.bincount(seq[~alone], minlength=len(lengths))
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        pair = self.verdicts(flat[inside] * self.base + flat[inside + 1])
        bad += np.bincount(seq[inside[~pair]], minlength=len(lengths))
        return bad == 0

    def encode_words(self, words: list[str]) -> list[str]:
        """For each word its ids joined by a space."""
        special = self.vocab.special
        ids = [[special[w[1:]]] if self.vocab.is_special(w) else self.proposed(self.vocab.spelled(w)) for w in words]
        ordinary = np.array([not self.vocab.is_special(w) for w in words])
        lengths = np.where(ordinary, [len(x) for x in ids], 0)
        flat = np.array([t for x, o in zip(ids, ordinary.tolist(), strict=True) if o for t in x], dtype=np.int64)
        failing = np.flatnonzero(~self.verified(flat, lengths))
        flat, lengths = self.merger.merge([words[i].encode("utf-8") for i in failing.tolist()])
        for i, x in zip(failing.tolist(), np.split(flat, np.cumsum(lengths)[:-1]) if len(failing) else [], strict=True):
            ids[i] = x.tolist()
        self.checked += len(words)
        self.failed += len(failing)
        return [" ".join(map(str, x)) for x in ids]

    def encode(self, texts: list[str]) -> list[tuple[int, str]]:
        """(number of tokens, ids joined by one space) of each text."""
        lists = [self.vocab.words(t) for t in texts]
        known = self.words.ready(lists)
        joined = [" ".join(map(known.__getitem__, x)) for x in lists]
        return [(x.count(" ") + 1 if x else 0, x) for x in joined]

    def decode(self, ids: str) -> str:
        """The vocabulary names no decoder, so tokens are joined by a space."""
        names = self.names
        return " ".join([names[t] for t in ids.split(" ")]) if ids else ""


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, text: str = "text", vocab: str = "word_bpe_49k.json") -> DataFrame:
    """df's doc_id with n_tokens and ids (decimal, joined by a space).  Null text counts as empty; rows keep repeats."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = encoder(resolved(vocab)).encode(batch.column(1).to_pylist())
        return pa.record_batch([batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.large_string()).cast(pa.string())], names=["doc_id", "n_tokens", "ids"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return map_arrow(rows, per_batch, "doc_id long, n_tokens long, ids string")


def decode(df: DataFrame, ids: str = "ids", vocab: str = "word_bpe_49k.json") -> DataFrame:
    """df's doc_id with the decoded text of its ids; null ids count as none."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(resolved(vocab))
        return pa.record_batch([batch.column(0), pa.array([enc.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "decoded"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(ids).alias("ids"))
    return map_arrow(rows, per_batch, "doc_id long, decoded string")


def round_trip_digests(df: DataFrame, text: str = "text", vocab: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes each text in one pass over the data.

    A null text counts as empty (no tokens); a text of any length is encoded whole; rows keep repeats, an empty table
    gives none, further columns are ignored.
    """

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(resolved(vocab))
        n, ids, back = [], [], []
        for count, joined in enc.encode(batch.column(1).to_pylist()):
            n.append(count)
            ids.append(hashlib.sha256(joined.encode()).hexdigest())
            back.append(hashlib.sha256(enc.decode(joined).encode("utf-8")).hexdigest())
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return map_arrow(rows, per_batch, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
