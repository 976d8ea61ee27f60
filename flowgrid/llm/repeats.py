"""Substring dedup by fixed-block anchors.

Documents lie in chunks.  Every chunk gives the non-overlapping blocks of BLOCK words of its documents to an index, and
probes it with every rolling window of BLOCK words.  Of two passages of 2 * BLOCK - 1 equal words, each holds a whole
block of its own document, which the other's probes hit; so nothing equal is lost.  Around hits the anchors are extended:
windows of WIDTH words that hold a hit are looked up by 96-bit hashes, on the side of the block as references and on the
side of the probe as questions, and windows found one after another join to maximal exact repeats.

Index, probes and windows go to buckets of their hash, each once for a chunk however often it is in it, so that a passage
of very many documents weighs no more than its chunks, and no pairs of documents are made.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, removed, sent_by_bytes, text_or_empty, written

WIDTH = 13
BLOCK = (WIDTH + 1) // 2
#: Bytes of text and documents of a chunk (one longer text is a chunk of its own), and of probes that meet in a bucket, about.
CHUNK_BYTES, CHUNK_DOCS, BUCKET_BYTES = 4 << 20, 1 << 20, 16 << 20
#: Words are split from so many bytes at once.
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0d]")
NEVER = np.iinfo(np.int64).max
CHUNK = pa.schema([("chunk", pa.int64()), ("n_bytes", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.binary()), ("body", pa.binary())])
ODD = np.uint64(0x9E3779B97F4A7C15)


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """raw cut at white space into pieces of about size bytes."""
    at = 0
    while len(raw) - at > size and (cut := SPACE.search(raw, at + size)):
        yield raw[at : cut.start()]
        at = cut.end()
    yield raw[at:]


def hashed(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of words of each text."""
    digest = xxhash.xxh3_64_intdigest
    parts, counts = [], []
    for raw in texts:
        n = 0
        for piece in pieces(raw):
            words = piece.split()
            parts.append(np.fromiter([digest(w, seed) for w in words], np.uint64, len(words)))
            n += len(words)
        counts.append(n)
    return np.concatenate([np.empty(0, np.uint64), *parts]), np.array(counts, np.int64)


def rolled(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash for every window of width words."""
    n = max(0, len(words) - width + 1)
    out = np.full(n, seed, np.uint64)
    for j in range(width):
        out ^= words[j : j + n]
        out *= ODD
        out ^= out >> np.uint64(31)
    return out


def inside(counts: np.ndarray, width: int) -> np.ndarray:
    """Whether the window that starts at each word stays within its text."""
    ends = np.repeat(np.cumsum(counts), counts)
    return (np.arange(len(ends)) + width <= ends)[: max(0, len(ends) - width + 1)]


def any_ahead(marks: np.ndarray, reach: int) -> np.ndarray:
    """Whether one of marks[i : i + reach] is set."""
    sums = np.append(0, np.cumsum(marks))
    return sums[np.minimum(np.arange(len(marks)) + reach, len(marks))] > sums[:-1]


def folded(texts: list[bytes]) -> dict:
    """Texts as one compressed body and their lengths, which is what moves and is stored of them."""
    raw = b"".join(texts)
    return {"lengths": np.array([len(t) for t in texts], np.int64).tobytes(), "body": pa.Codec("zstd").compress(raw, asbytes=True)}


def unfolded(lengths: bytes, body: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(lengths, np.int64)).tolist()
    raw = pa.Codec("zstd").decompress(body, ends[-1] if ends else 0, asbytes=True)
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def offsets(ids: np.ndarray) -> tuple[int, bytes]:
    """The smallest id, and by how much each is above it, in 4 bytes where that is enough and else in 8."""
    base = int(ids.min()) if len(ids) else 0
    above = ids.view(np.uint64) - np.array(base, np.int64).view(np.uint64)  # wraps, so any two longs are apart
    return base, above.astype("<u4" if not len(above) or int(above.max()) < 1 << 32 else "<u8").tobytes()


def from_offsets(base: int, raw: bytes, n: int) -> np.ndarray:
    above = np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<u8").astype(np.uint64)
    return (above + np.array(base, np.int64).view(np.uint64)).view(np.int64)


def steps(values: np.ndarray) -> bytes:
    """Ascending 32-bit numbers by their differences, of 3 bytes where all fit and else of 4."""
    apart = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return apart.tobytes() if len(apart) and int(apart.max()) >= 1 << 24 else apart.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def from_steps(raw: bytes, n: int) -> np.ndarray:
    if len(raw) == 4 * n:
        return np.cumsum(np.frombuffer(raw, "<u4"), dtype=np.uint32)
    wide = np.zeros((n, 4), np.uint8)
    wide[:, :3] = np.frombuffer(raw, np.uint8).reshape(n, 3)
    return np.cumsum(wide.view("<u4")[:, 0], dtype=np.uint32)


def in_chunks(df: DataFrame, text: str, chunk_bytes: int) -> tuple[DataFrame, str]:
    """chunk, n_bytes, docs, lengths, body: documents that lie side by side, written once so that a chunk stays what it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, texts, n, made = [], [], 0, 0
        first = TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"chunk": first + made, "n_bytes": n, "docs": docs, **folded(texts)}], CHUNK)

        for batch in by_bytes(batches):
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if docs and (n + len(raw) > chunk_bytes or len(docs) >= CHUNK_DOCS):
                    yield row()
                    docs, texts, n, made = [], [], 0, made + 1
                docs.append(doc)
                texts.append(raw)
                n += len(raw)
        if docs:
            yield row()

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
    return written(sent_by_bytes(rows).mapInArrow(run, "chunk long, n_bytes long, docs array<long>, lengths binary, body binary"), "chunks")


def runs(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.empty(0, np.int64)


def pairs_of(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """ids as numbers, and which there are."""
    return np.array([0 if x is None else x for x in ids], np.int64), np.array([x is not None for x in ids], bool)


ASKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n_probes", pa.int32()), ("probe", pa.binary()), ("several", pa.binary()), ("block", pa.binary()), ("base", pa.int64()), ("first", pa.binary())])
FOUND = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("hash", pa.binary()), ("base", pa.int64()), ("first", pa.binary())])


def probes(chunks: DataFrame, bits: int) -> DataFrame:
    """bucket, chunk, n_probes, probe, several, block, base, first: what a chunk asks and what it has, by buckets of the hash.

    probe: distinct hashes (32 bits beside the bucket's, by steps) of rolling windows, with a bit for those of several documents;
    block: distinct hashes of the documents' own blocks, with the smallest doc_id (above base).  Documents without a doc_id take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            for chunk, docs, lengths, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids, known = pairs_of(docs)
                texts = [t for t, k in zip(unfolded(lengths, body), known, strict=True) if k]
                ids = ids[known]
                words, counts = hashed(texts, 0)
                ok = inside(counts, BLOCK)
                keys = rolled(words, BLOCK, 1) >> np.uint64(32 - bits)
                row_of = np.repeat(np.arange(len(ids)), counts)[: len(keys)]
                starts = np.repeat(np.cumsum(counts) - counts, counts)[: len(keys)]
                own = ok & ((np.arange(len(keys)) - starts) % BLOCK == 0)
                by = np.argsort(keys[ok], kind="stable")
                all_, of = keys[ok][by], row_of[ok][by]
                at = runs(all_)
                last = np.append(at[1:], len(all_)) - 1 if len(at) else at
                several = of[at] != of[last]  # stable: rows ascend within a run
                probe = all_[at]
                by = np.lexsort((ids[row_of[own]], keys[own]))
                block, first = keys[own][by], ids[row_of[own]][by]
                at = runs(block)
                block, first = block[at], first[at]
                cuts = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32)
                p, b = np.searchsorted(probe, cuts), np.searchsorted(block, cuts)
                some = [i for i in range(1 << bits) if p[i] < p[i + 1]]
                low = probe.astype(np.uint32), block.astype(np.uint32)
                out = []
                for i in some:
                    base, above = offsets(first[b[i] : b[i + 1]])
                    out.append({"bucket": i, "chunk": chunk, "n_probes": int(p[i + 1] - p[i]), "probe": steps(low[0][p[i] : p[i + 1]]), "several": np.packbits(several[p[i] : p[i + 1]]).tobytes(), "block": low[1][b[i] : b[i + 1]].tobytes(), "base": base, "first": above})
                yield pa.RecordBatch.from_pylist(out, ASKED)

    return sent_by_bytes(chunks.select("chunk", "docs", "lengths", "body")).mapInArrow(run, "bucket int, chunk long, n_probes int, probe binary, several binary, block binary, base long, first binary")


def hits(asked: DataFrame) -> DataFrame:
    """chunk, bucket, hash, base, first: to each chunk those of its probes that are a block somewhere and are found in two documents or more."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        blocks = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["block"]])
        firsts = np.concatenate([from_offsets(base, x, len(b) // 4) for b, base, x in zip(rows["block"], rows["base"], rows["first"], strict=True)])
        by = np.lexsort((firsts, blocks))
        at = runs(blocks[by])
        index, least = blocks[by][at], firsts[by][at]
        seen = np.zeros(len(index), np.int64)
        found = []
        for n, probe, several in zip(rows["n_probes"], rows["probe"], rows["several"], strict=True):
            own = from_steps(probe, n)
            place = np.minimum(np.searchsorted(index, own), max(0, len(index) - 1))
            there = index[place] == own if len(index) else np.zeros(len(own), bool)
            found.append(place[there])
            seen[found[-1]] += 1 + np.unpackbits(np.frombuffer(several, np.uint8), count=len(own))[there]
        out = []
        for chunk, x in zip(rows["chunk"], found, strict=True):
            if len(x := x[seen[x] > 1]):
                base, above = offsets(least[x])
                out.append({"chunk": chunk, "bucket": key[0].as_py(), "hash": index[x].tobytes(), "base": base, "first": above})
        return pa.Table.from_pylist(out, FOUND)

    return asked.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, hash binary, base long, first binary")


def kept(raw: bytes, covered: np.ndarray | None, digest: bool) -> tuple[int, str]:
    """The number of words, and the words that are not covered, joined by one space, or their sha256."""
    n, hashed_, parts = 0, hashlib.sha256(), []
    for piece in pieces(raw):
        words = piece.split()
        here = words if covered is None else [w for w, c in zip(words, covered[n : n + len(words)].tolist(), strict=True) if not c]
        n += len(words)
        if here:
            part = b" ".join(here)
            if digest:
                hashed_.update((b" " if parts else b"") + part)
                parts = [b""]
            else:
                parts.append(part)
    return n, hashed_.hexdigest() if digest else b" ".join(parts).decode("utf-8")


OUT = "doc_id long, n_words long, n_removed long, kept string"
#: of: 0 a finished document, 1 documents of a chunk with questions, 2 windows of a chunk in a bucket.
EXTENDED = pa.schema([("of", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept", pa.string()), ("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.binary()), ("body", pa.binary()), ("asks", pa.binary()), ("bucket", pa.int32()), ("top", pa.int64()), ("n_asked", pa.int32()), ("base", pa.int64()), ("windows", pa.binary())])
ANSWERED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("yes", pa.binary()), ("base", pa.int64()), ("first", pa.binary())])
#: A window: hashes of 64 and 32 bits, the smallest doc_id that has it beside a block, and whether its chunk asks for it.
WINDOW = np.dtype([("a", "<u8"), ("b", "<u4"), ("first", "<i8"), ("asks", "?")])


def moved(kind: str) -> np.dtype:
    """A window on its way: the doc_id is above a base by one less than what is written; 0 is none."""
    return np.dtype([("a", "<u8"), ("b", "<u4"), ("first", kind)])


def packed(w: np.ndarray) -> tuple[int, bytes]:
    """The smallest doc_id of some windows and their bytes, of 16 each, or of 20 after a byte that tells."""
    refers = w["first"] != NEVER
    base = int(w["first"].min())
    above = np.where(refers, np.ascontiguousarray(w["first"]).view(np.uint64) - np.array(base, np.int64).view(np.uint64) + np.uint64(1), np.uint64(0))
    wide = int(above.max()) >= 1 << 32
    out = np.empty(len(w), moved("<u8" if wide else "<u4"))
    out["a"], out["b"], out["first"] = w["a"], w["b"], above
    return base, b"w" * wide + out.tobytes()


def unpacked(base: int, raw: bytes, n_asked: int) -> np.ndarray:
    got = np.frombuffer(raw, moved("<u8"), offset=1) if len(raw) % 2 else np.frombuffer(raw, moved("<u4"))
    out = np.empty(len(got), WINDOW)
    above = got["first"].astype(np.uint64)
    out["a"], out["b"], out["asks"] = got["a"], got["b"], np.arange(len(got)) < n_asked
    out["first"] = np.where(above > 0, (above - np.uint64(1) + np.array(base, np.int64).view(np.uint64)).view(np.int64), NEVER)
    return out


def windows_of(texts: list[bytes], words: np.ndarray | None = None, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of the window at every place, and the texts' counts of words."""
    if words is None:
        words, counts = hashed(texts, 0)
    return rolled(words, WIDTH, 2), (rolled(hashed(texts, 1)[0], WIDTH, 3) >> np.uint64(32)).astype(np.uint32), counts


def extended(chunks: DataFrame, replies: DataFrame, bits: int, digest: bool) -> DataFrame:
    """Around the hits of each chunk, the windows to look up; documents that have none to ask for are finished."""

    def rows(chunk: int, docs: list, lengths: bytes, body: bytes, found: list[dict] | None) -> list[dict]:
        ids, known = pairs_of(docs)
        texts = unfolded(lengths, body)
        open_ = np.zeros(len(docs), bool)
        out = []
        if found:
            hash_ = np.concatenate([np.frombuffer(x["hash"], np.uint32).astype(np.uint64) | np.uint64(x["bucket"] << 32) for x in found])
            first = np.concatenate([from_offsets(x["base"], x["first"], len(x["hash"]) // 4) for x in found])
            by = np.argsort(hash_)
            hash_, first = hash_[by], first[by]
            own = np.flatnonzero(known)
            words, counts = hashed([texts[i] for i in own], 0)
            keys = rolled(words, BLOCK, 1) >> np.uint64(32 - bits)
            place = np.minimum(np.searchsorted(hash_, keys), len(hash_) - 1)
            hit = (hash_[place] == keys) & inside(counts, BLOCK)
            of = np.repeat(own, counts)
            starts = np.repeat(np.cumsum(counts) - counts, counts)[: len(keys)]
            asks = hit & (first[place] < ids[of[: len(keys)]])
            refers = hit & ((np.arange(len(keys)) - starts) % BLOCK == 0)
            ok = inside(counts, WIDTH)
            asks, refers = (any_ahead(x, WIDTH - BLOCK + 1)[: len(ok)] & ok for x in (asks, refers))
            if asks.any() or refers.any():
                some = np.unique(of[: len(ok)][asks | refers])
                some_words = np.isin(of, some)
                a, b, _ = windows_of([texts[i] for i in some], words[some_words], counts)
                # Places within the words of these documents alone; windows within one document stay where they are.
                to = np.cumsum(some_words) - 1
                use = np.flatnonzero(asks | refers)
                w = np.empty(len(use), WINDOW)
                w["a"], w["b"] = a[to[use]], b[to[use]]
                w["first"] = np.where(refers[use], ids[of[use]], NEVER)
                w["asks"] = asks[use]
                w = merged(w)
                asking = np.unique(of[: len(ok)][asks])
                open_[asking] = True
                top = int(ids[asking].max()) if len(asking) else 0
                marks = np.append(asks, np.zeros(len(of) - len(ok), bool))[open_[of]]
                bucket = (w["a"] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(w), np.int64)
                at = runs(bucket)
                for i, j in zip(at, np.append(at[1:], len(w)), strict=True):
                    here = np.concatenate([w[i:j][w[i:j]["asks"]], w[i:j][~w[i:j]["asks"]]])  # those asked for come first
                    base, raw = packed(here)
                    out.append({"of": 2, "chunk": chunk, "bucket": int(bucket[i]), "top": top, "n_asked": int(here["asks"].sum()), "base": base, "windows": raw})
        for i in np.flatnonzero(~open_).tolist():
            n, text = kept(texts[i], None, digest)
            out.append({"of": 0, "doc_id": docs[i], "n_words": n, "kept": text})
        if open_.any():
            out.append({"of": 1, "chunk": chunk, "docs": [docs[i] for i in np.flatnonzero(open_)], **folded([texts[i] for i in np.flatnonzero(open_)]), "asks": np.packbits(marks).tobytes()})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            for x in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                yield pa.RecordBatch.from_pylist(rows(*x), EXTENDED)

    gathered = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "hash", "base", "first")).alias("found"))  # no more than the chunk's words
    both = chunks.select("chunk", "docs", "lengths", "body").join(gathered, "chunk", "left")
    schema = "of int, doc_id long, n_words long, kept string, chunk long, docs array<long>, lengths binary, body binary, asks binary, bucket int, top long, n_asked int, base long, windows binary"
    return sent_by_bytes(both).mapInArrow(run, schema)


def merged(w: np.ndarray) -> np.ndarray:
    """Equal windows as one, sorted by their hashes."""
    w = w[np.lexsort((w["b"], w["a"]))]
    at = np.flatnonzero(np.append(True, (w["a"][1:] != w["a"][:-1]) | (w["b"][1:] != w["b"][:-1]))) if len(w) else np.empty(0, np.int64)
    out = w[at]
    if len(at):
        out["first"], out["asks"] = np.minimum.reduceat(w["first"], at), np.logical_or.reduceat(w["asks"], at)
    return out


def answered(asked: DataFrame) -> DataFrame:
    """chunk, bucket, yes, base, first: a bit for each window that a chunk asked for in a bucket, set if a document before its last one has it; and which."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        own = [unpacked(*x) for x in zip(rows["base"], rows["windows"], rows["n_asked"], strict=True)]
        all_ = merged(np.concatenate(own))
        out = []
        for chunk, top, n, w in zip(rows["chunk"], rows["top"], rows["n_asked"], own, strict=True):
            w = w[:n]
            place = np.searchsorted(all_["a"], w["a"])
            while len(late := np.flatnonzero((all_["a"][place] == w["a"]) & (all_["b"][place] < w["b"]))):
                place[late] += 1
            first = all_["first"][place]
            yes = first < top
            if yes.any():
                base, above = offsets(np.ascontiguousarray(first[yes]))
                out.append({"chunk": chunk, "bucket": key[0].as_py(), "yes": np.packbits(yes).tobytes(), "base": base, "first": above})
        return pa.Table.from_pylist(out, ANSWERED)

    return asked.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, yes binary, base long, first binary")


def removed_from(open_: DataFrame, replies: DataFrame, bits: int, digest: bool) -> DataFrame:
    """The documents of open chunks without the words that answered windows cover."""

    def rows(docs: list[int], lengths: bytes, body: bytes, asks: bytes, found: list[dict] | None) -> list[tuple]:
        texts = unfolded(lengths, body)
        if not found:
            return [(d, (x := kept(t, None, digest))[0], 0, x[1]) for d, t in zip(docs, texts, strict=True)]
        a, b, counts = windows_of(texts)
        at = np.flatnonzero(np.unpackbits(np.frombuffer(asks, np.uint8), count=int(counts.sum())))
        at = at[np.lexsort((b[at], a[at]))]
        # The distinct windows asked for, in the order in which they were sent: by buckets, which are the first bits of a.
        new = np.append(True, (a[at][1:] != a[at][:-1]) | (b[at][1:] != b[at][:-1]))
        known = a[at][new]
        first = np.full(len(known), NEVER)
        for x in found:
            low, high = (int(np.searchsorted(known, np.uint64(k << (64 - bits)))) if k >> bits == 0 else len(known) for k in (x["bucket"], x["bucket"] + 1)) if bits else (0, len(known))
            yes = low + np.flatnonzero(np.unpackbits(np.frombuffer(x["yes"], np.uint8), count=high - low))
            first[yes] = from_offsets(x["base"], x["first"], len(yes))
        hit = at[first[np.cumsum(new) - 1] < np.repeat(np.array(docs, np.int64), counts)[at]]
        turns = np.zeros(int(counts.sum()) + 1, np.int64)
        turns[hit] += 1
        turns[hit + WIDTH] -= 1
        covered = np.cumsum(turns)[:-1] > 0
        out = []
        for doc, raw, part in zip(docs, texts, np.split(covered, np.cumsum(counts)[:-1]), strict=True):
            gone = int(part.sum())
            n, text = kept(raw, part if gone else None, digest)
            out.append((doc, n, gone, text))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            for x in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                out = rows(*x)
                yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept"])

    gathered = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "yes", "base", "first")).alias("found"))
    return sent_by_bytes(open_.join(gathered, "chunk", "left").select("docs", "lengths", "body", "asks", "found")).mapInArrow(run, OUT)


def without_repeats(df: DataFrame, text: str = "text", digest: bool = False, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space, or their sha256) of each row of df.

    Every word goes that a window of WIDTH words covers which also starts in a row with a smaller doc_id.  A null text
    has no words; texts are taken whole, at any length; rows with one doc_id are not before each other; a row without
    a doc_id keeps its words and takes none.  An empty table gives none; further columns are ignored.

    A chunk is what a task holds at once; with chunks of more bytes fewer, longer rows go to the buckets of a large corpus.
    """
    spark = df.sparkSession
    chunks, path = in_chunks(df, text, chunk_bytes)
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(0, (size * 4 // 6 // bucket_bytes).bit_length())  # a probe of 4 bytes for every 6 of text, about
    replies, replies_path = written(hits(probes(chunks, bits)), "hits")
    both, _ = written(extended(chunks, replies, bits, digest), "extended")
    removed(spark, path)
    removed(spark, replies_path)
    answers = answered(both.where("of = 2").select("bucket", "chunk", "top", "n_asked", "base", "windows"))
    late = removed_from(both.where("of = 1").select("chunk", "docs", "lengths", "body", "asks"), answers, bits, digest)
    return both.where("of = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept").unionByName(late)
