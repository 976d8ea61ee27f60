"""Rank-synchronous BPE merging of many words at once, on ragged numpy arrays."""

from __future__ import annotations

import heapq

import numpy as np

from .pretokens import Vocabulary

#: Symbols of a sequence from which on merging follows links instead of looking at all symbols in each round.
LONG = 400
FAR = np.iinfo(np.int64).max


class MergeTable:
    """Merge ranks as sorted arrays: pair code -> rank and merged id."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.base = max(vocab.tokens) + 1
        code = np.array([a * self.base + b for a, b in vocab.merges], dtype=np.int64)
        order = np.argsort(code)
        self.code = code[order]
        self.rank = np.array([r for r, _ in vocab.merges.values()], dtype=np.int64)[order]
        self.made = np.array([m for _, m in vocab.merges.values()], dtype=np.int64)[order]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (FAR: no merge) and its place in the table."""
        code = left * self.base + right
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.rank[at], FAR), at


def merge_all(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every ragged sequence to its end: (symbols left, how many of each sequence).

    In each round every sequence finds its lowest-ranked adjacent pair and all apply theirs together;
    a sequence without a pair left is finished and leaves the arrays.
    """
    seq = np.repeat(np.arange(len(lengths)), lengths)
    sym = symbols.astype(np.int64)
    done_seq, done_sym = [], []
    while len(sym):
        inside = seq[1:] == seq[:-1]
        rank, at = table.find(sym[:-1], sym[1:])
        rank[~inside] = FAR
        rank = np.append(rank, FAR)
        starts = np.flatnonzero(np.append(True, ~inside))
        best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
        open_ = best < FAR
        done_seq.append(seq[~open_])
        done_sym.append(sym[~open_])
        where = np.flatnonzero((rank == best) & open_)
        if len(where) > 1:  # overlapping hits, a run of one symbol, merge from the left: every second one
            run = np.cumsum(np.append(True, np.diff(where) > 1))
            first = where[np.append(True, np.diff(run) > 0)][run - 1]
            where = where[(where - first) % 2 == 0]
        sym[where] = table.made[at[where]]
        open_[where + 1] = False
        sym, seq = sym[open_], seq[open_]
    if not done_seq:
        return sym, lengths * 0
    seq, sym = np.concatenate(done_seq), np.concatenate(done_sym)
    return sym[np.argsort(seq, kind="stable")], np.bincount(seq, minlength=len(lengths))


def merge_long(symbols: np.ndarray, table: MergeTable) -> np.ndarray:
    """The same merging of one long sequence: symbols are linked to their neighbours, and a round touches only the places
    of its lowest rank, so that the work does not grow with rounds times length."""
    n = len(symbols)
    sym = symbols.astype(np.int64)
    after, before = np.append(np.arange(1, n), -1), np.arange(-1, n - 1)
    alive, rank, made = np.ones(n, dtype=bool), np.full(n, FAR), np.zeros(n, dtype=np.int64)
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []  # heap of the ranks in waiting

    def look_up(at: np.ndarray) -> None:
        """Ranks of the pairs that begin at these places."""
        rank[at] = FAR
        at = at[after[at] >= 0]
        rank[at], where = table.find(sym[at], sym[after[at]])
        made[at] = table.made[where]
        at = at[rank[at] < FAR]
        at = at[np.argsort(rank[at], kind="stable")]
        for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else []:
            r = int(rank[part[0]])
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(ranks, r)
            waiting[r].append(part)

    look_up(np.arange(n))
    while ranks:
        r = heapq.heappop(ranks)
        at = np.unique(np.concatenate(waiting.pop(r)))
        at = at[alive[at] & (rank[at] == r)]
        if len(at) > 1:  # in a run of overlapping hits every second one merges, from the left
            run = np.cumsum(np.append(True, after[at[:-1]] != at[1:]))
            first = np.flatnonzero(np.append(True, np.diff(run) > 0))[run - 1]
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        sym[at], alive[gone] = made[at], False
        after[at] = after[gone]
        follow = after[at] >= 0
        before[after[at][follow]] = at[follow]
        look_up(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
    return sym[alive]


class WordMerger:
    """Token ids of whole words of one vocabulary, many at once."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.table = vocab, MergeTable(vocab)
        ids = vocab.ids
        self.byte = np.array([ids[s] for s in vocab.symbols], dtype=np.int64)
        self.last = np.array([ids[s + vocab.suffix] for s in vocab.symbols], dtype=np.int64)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Initial symbols; the last one of a word carries the end-of-word suffix."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        flat = self.byte[raw]
        ends = np.cumsum(lengths)[lengths > 0] - 1
        flat[ends] = self.last[raw[ends]]
        return flat, lengths

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, lengths = self.symbols(words)
        long = np.flatnonzero(lengths > LONG)
        if not len(long):
            return merge_all(flat, lengths, self.table)
        ends = np.cumsum(lengths)
        done = {int(i): merge_long(flat[ends[i] - lengths[i] : ends[i]], self.table) for i in long}
        short = np.repeat(lengths <= LONG, lengths)
        flat, left = merge_all(flat[short], np.where(lengths <= LONG, lengths, 0), self.table)
        parts = np.split(flat, np.cumsum(left)[:-1])
        for i, x in done.items():
            parts[i], left[i] = x, len(x)
        return np.concatenate(parts), left
