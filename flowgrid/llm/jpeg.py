"""Progressive JPEG in numpy: coefficient storage of bytes, and a decoder to full-resolution RGB.

The decoder accumulates the scans of spectral selection and successive approximation into coefficient arrays.  It works
on many images at once: every restart segment of every image is a lane, and a step decodes one symbol in all lanes.
The encoder stores bytes as quantized coefficients (64 to a block, quantizers of 1), which the format keeps exactly.
Coefficients are held in zigzag order throughout.
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

OFFSET = 104  # byte that is stored as coefficient 0; letters lie near it
RESTART = 8  # units of a restart segment
WIDEST = 1024  # MCUs in a row
SLOTS = ((0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (2, 0, 0))  # component, row, column of the blocks of an MCU
SAMPLING = ((2, 2), (1, 1), (1, 1))
#: Scans of the encoder: components, first and last coefficient, high and low bit of the approximation.
SCRIPT = (((0, 1, 2), 0, 0, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 5, 0, 1), ((0,), 6, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), *[((c,), 1, 63, 1, 0) for c in range(3)])
SIZE_OF = np.array([int(x).bit_length() for x in range(2049)], dtype=np.int64)


def zigzag() -> np.ndarray:
    """Place in the block (row * 8 + column) of each coefficient: along antidiagonals in turn upwards and downwards."""
    at = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in at])


@lru_cache(maxsize=1)
def inverse_dct() -> np.ndarray:
    """64 x 64 matrix from zigzag coefficients to samples."""
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    return np.kron(basis, basis).T[zigzag()]


# ---- Huffman tables ----
def code_lengths(weights: dict[int, float]) -> dict[int, int]:
    """Huffman code lengths of at most 16 bits; no code is all ones."""
    heap = [(w, i, (s,)) for i, (s, w) in enumerate(sorted(weights.items()))] + [(0.0, -1, (-1,))]
    heapq.heapify(heap)
    length = dict.fromkeys([*weights, -1], 0)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        n += 1
        heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
    per = [0] * 64
    for x in length.values():
        per[x] += 1
    for i in range(63, 16, -1):  # shorten the longest codes in pairs, at the cost of the next shorter one
        while per[i]:
            j = next(j for j in range(i - 2, 0, -1) if per[j])
            per[i] -= 2
            per[i - 1] += 1
            per[j + 1] += 2
            per[j] -= 1
    order = sorted(length, key=lambda s: (length[s], s == -1, s))
    lengths = [n for n in range(64) for _ in range(per[n])]
    return {s: n for s, n in zip(order, lengths, strict=True) if s != -1}


@dataclass(frozen=True)
class Table:
    """A canonical Huffman table: number of codes by length 1..16 and the symbols in order."""

    counts: tuple[int, ...]
    symbols: tuple[int, ...]

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        code, length, c, i = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
        for n, k in enumerate(self.counts, 1):
            for _ in range(k):
                code[self.symbols[i]], length[self.symbols[i]] = c, n
                c, i = c + 1, i + 1
            c <<= 1
        return code, length

    @lru_cache(maxsize=64)  # noqa: B019
    def lookup(self) -> np.ndarray:
        """symbol << 8 | length for each 16 bits; length 16 with symbol 0 where there is no code."""
        out, at, i = np.full(1 << 16, 16, np.uint16), 0, 0
        for n, k in enumerate(self.counts, 1):
            for _ in range(k):
                out[at : at + (1 << 16 - n)] = self.symbols[i] << 8 | n
                at, i = at + (1 << 16 - n), i + 1
        return out


def table_of(weights: dict[int, float]) -> Table:
    lengths = code_lengths(weights)
    return Table(tuple(sum(n == i for n in lengths.values()) for i in range(1, 17)), tuple(sorted(lengths, key=lambda s: (lengths[s], s))))


@lru_cache(maxsize=1)
def own_tables() -> tuple[Table, Table]:
    """Tables for bytes of text, by rule: long runs are rare, sizes of about 4 bits and of spaces (7 bits) are frequent."""
    size = {0: 2, 1: 8, 2: 14, 3: 20, 4: 24, 5: 3, 6: 14, 7: 3, 8: 3, 9: 1, 10: 0.1, 11: 0.01}
    ac = {r << 4 | s: size[s] * 0.12**r for r in range(16) for s in range(1, 11)} | {0x00: 2.0, 0xF0: 1e-6} | {r << 4: 1e-6 for r in range(1, 15)}
    return table_of(size), table_of(ac)


# ---- encoder ----
@dataclass
class Layout:
    """Where the blocks of an image lie in a batch's coefficient matrix, and the order of blocks in each kind of scan."""

    width: int
    height: int
    sampling: tuple[tuple[int, int], ...]
    base: int = 0

    def __post_init__(self) -> None:
        self.hmax, self.vmax = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        sizes = [self.across * h * self.down * v for h, v in self.sampling]
        self.starts = [self.base + sum(sizes[:i]) for i in range(len(sizes))]
        self.blocks = sum(sizes)

    def order(self, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        """(block numbers in scan order, component of each, blocks in a unit)."""
        at, comp, unit = scan_order(self.width, self.height, self.sampling, components)
        return at + self.base, comp, unit


@lru_cache(maxsize=4096)
def scan_order(width: int, height: int, sampling: tuple[tuple[int, int], ...], components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    own = Layout(width, height, sampling)
    if len(components) == 1:
        c = components[0]
        h, v = sampling[c]
        rows, cols = -(-(-(-height * v // own.vmax)) // 8), -(-(-(-width * h // own.hmax)) // 8)
        at = own.starts[c] + (np.arange(rows)[:, None] * (own.across * h) + np.arange(cols)).ravel()
        return at, np.full(len(at), c), 1
    my, mx = np.divmod(np.arange(own.across * own.down), own.across)
    slots = [(c, r, q) for c in components for r in range(sampling[c][1]) for q in range(sampling[c][0])]
    at = np.stack([own.starts[c] + (my * sampling[c][1] + r) * (own.across * sampling[c][0]) + mx * sampling[c][0] + q for c, r, q in slots], axis=1)
    return at.ravel(), np.tile([c for c, _, _ in slots], len(my)), len(slots)


def packed(values: np.ndarray, bits: np.ndarray, segment: np.ndarray, n: int) -> list[bytes]:
    """Bit strings of n segments, each padded with ones to whole bytes, from items in order (at most 32 bits each)."""
    total = np.bincount(segment, bits, n).astype(np.int64)
    size = (total + 7) // 8
    first = np.cumsum(size) - size
    start = np.cumsum(bits) - bits - (np.cumsum(total) - total)[segment] + first[segment] * 8
    pad = size * 8 - total
    words = np.zeros(int(size.sum()) // 4 + 3, dtype=np.uint64)
    for v, b, s in ((values, bits, start), ((1 << pad) - 1, pad, first * 8 + total)):
        if not len(v):
            continue
        w = s >> 5
        whole = v.astype(np.uint64) << (64 - b - (s & 31)).view(np.uint64) if b.min() else np.where(b > 0, v.astype(np.uint64) << np.minimum(64 - b - (s & 31), 63).astype(np.uint64), 0).astype(np.uint64)
        group = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        words[w[group]] |= np.bitwise_or.reduceat(whole >> np.uint64(32), group)
        words[w[group] + 1] |= np.bitwise_or.reduceat(whole & np.uint64(0xFFFFFFFF), group)
    raw, ends = words.astype(">u4").tobytes(), (first + size).tolist()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(first.tolist(), ends, strict=True)]


def signed_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v >= 0, v, v + (1 << size) - 1)


def dc_items(c: np.ndarray, comp: np.ndarray, segment: np.ndarray, low: int, high: int, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if high:
        return (c >> low) & 1, np.ones(len(c), np.int64), segment
    v = c >> low
    diff = v.copy()
    for k in np.unique(comp):
        at = np.flatnonzero(comp == k)
        before = np.append(0, v[at][:-1])
        before[np.append(True, segment[at][1:] != segment[at][:-1])] = 0
        diff[at] = v[at] - before
    size = SIZE_OF[np.abs(diff)]
    code, length = table.codes()
    return code[size] << size | signed_bits(diff, size), length[size] + size, segment


def ac_first_items(band: np.ndarray, segment: np.ndarray, low: int, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code, length = table.codes()
    mag = np.abs(band) >> low
    blk, k = np.nonzero(mag)
    at = blk * band.shape[1] + k
    x = np.where(band.ravel()[at] < 0, -1, 1) * mag.ravel()[at]
    opens = np.append(True, blk[1:] != blk[:-1])[: len(blk)]
    run = k - np.where(opens, -1, np.append(-1, k[:-1])[: len(k)]) - 1
    skips = run >> 4
    last = np.full(len(mag), -1)
    last[blk] = k  # the last one of a block stays
    eob = last < mag.shape[1] - 1
    before = np.cumsum(eob) - eob
    at = np.arange(len(blk)) + np.cumsum(skips) + before[blk]
    count = np.bincount(blk, minlength=len(mag)) + np.bincount(blk, skips, len(mag)).astype(np.int64) + eob
    n = int(count.sum())
    values, bits = np.full(n, code[0xF0]), np.full(n, length[0xF0])  # what isn't filled is a skip of 16 zeros
    size = SIZE_OF[np.abs(x)]
    symbol = (run & 15) << 4 | size
    values[at], bits[at] = code[symbol] << size | signed_bits(x, size), length[symbol] + size
    ends = (np.cumsum(count) - 1)[eob]
    values[ends], bits[ends] = code[0], length[0]
    return values, bits, np.repeat(segment, count)


def ac_refine_items(band: np.ndarray, segment: np.ndarray, low: int, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code, length = table.codes()
    nb, width = band.shape
    mag = np.abs(band) >> low
    old, new = mag > 1, mag == 1
    zeros = np.cumsum(~old, axis=1)  # zeros of history up to and with k
    zero_at = np.argsort(old, axis=1, kind="stable")  # places of the zeros first
    blk, k = np.nonzero(new)
    opens = np.append(True, blk[1:] != blk[:-1])[: len(blk)]
    from_k = np.where(opens, 0, np.append(0, k[:-1] + 1)[: len(k)])
    rank = zeros[blk, k] - 1
    run = rank - np.where(opens, 0, np.append(0, rank[:-1] + 1)[: len(rank)])
    skips = run >> 4
    symbol = (run & 15) << 4 | 1
    value, bits = code[symbol] << 1 | (band[blk, k] > 0), length[symbol] + 1
    # Skips of 16 zeros go before; the event itself then begins after the last skipped zero.
    own = np.repeat(np.arange(len(blk)), skips)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(skips) - skips, skips)
    first_rank = rank - run
    skip_from = np.where(nth == 0, from_k[own], zero_at[blk[own], np.maximum(first_rank[own] + 16 * nth - 1, 0)] + 1)
    from_k = np.where(skips > 0, zero_at[blk, np.maximum(first_rank + 16 * skips - 1, 0)] + 1, from_k)
    last = np.full(nb, -1)
    last[blk] = k
    eob = np.flatnonzero(last < width - 1)
    e_blk = np.concatenate([blk, blk[own], eob])
    e_from = np.concatenate([from_k, skip_from, last[eob] + 1])
    e_val = np.concatenate([value, np.full(len(own), code[0xF0]), np.full(len(eob), code[0])])
    e_bits = np.concatenate([bits, np.full(len(own), length[0xF0]), np.full(len(eob), length[0])])
    order = np.argsort(e_blk * width + e_from, kind="stable")
    e_blk, e_from, e_val, e_bits = e_blk[order], e_from[order], e_val[order], e_bits[order]
    # Items in order: an event comes before the correction bits of the coefficients it passes.
    events = np.cumsum(np.bincount(e_blk * width + e_from, minlength=nb * width))
    flat = np.flatnonzero(old.ravel())
    c_at = np.arange(len(flat)) + events[flat]
    passed = np.cumsum(old.ravel()) - old.ravel()
    e_at = np.arange(len(e_blk)) + passed[e_blk * width + e_from]
    n = len(flat) + len(e_blk)
    values, sizes, blocks = np.empty(n, np.int64), np.ones(n, np.int64), np.empty(n, np.int64)
    values[c_at], blocks[c_at] = mag.ravel()[flat] & 1, flat // width
    values[e_at], sizes[e_at], blocks[e_at] = e_val, e_bits, e_blk
    return values, sizes, segment[blocks]


def marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def stored(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as a progressive JPEG whose coefficients are its bytes."""
    layouts, base = [], 0
    for p in payloads:
        units = -(-len(p) // 384)
        across = min(units, WIDEST)
        layouts.append(Layout(16 * across, 16 * -(-units // across), SAMPLING, base))
        base += layouts[-1].blocks
    coef = np.zeros((base, 64), dtype=np.int16)
    for p, at in zip(payloads, layouts, strict=True):
        coef[at.order((0, 1, 2))[0][: len(p) // 64]] = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int16) - OFFSET
    bases = np.array([at.base for at in layouts])
    dc, ac = own_tables()
    head = b"".join([marker(0xDB, bytes([0]) + bytes([1] * 64)), marker(0xC4, b"".join([bytes([kind << 4]) + bytes(t.counts) + bytes(t.symbols) for kind, t in ((0, dc), (1, ac))])), marker(0xDD, struct.pack(">H", RESTART))])
    out = [[b"\xff\xd8", marker(0xFE, f"payload={len(p)}".encode()), head, marker(0xC2, struct.pack(">BHHB", 8, at.height, at.width, 3) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(SAMPLING)))] for p, at in zip(payloads, layouts, strict=True)]
    for components, a, b, high, low in SCRIPT:
        orders = [scan_order(at.width, at.height, at.sampling, components) for at in layouts]
        unit, sizes = RESTART * orders[0][2], np.array([len(o[0]) for o in orders])
        firsts = np.cumsum([0, *-(-sizes // unit)])
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        segment = np.repeat(firsts[:-1], sizes) + within // unit
        blocks, comp = np.concatenate([o[0] for o in orders]) + np.repeat(bases, sizes), np.concatenate([o[1] for o in orders])
        if a == 0:
            items = dc_items(coef[blocks, 0], comp, segment, low, high, dc)
        elif high:
            items = ac_refine_items(coef[blocks, a : b + 1], segment, low, ac)
        else:
            items = ac_first_items(coef[blocks, a : b + 1], segment, low, ac)
        coded = packed(*items, int(firsts[-1]))
        scan = marker(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, 0]) for c in components) + bytes([a, b, high << 4 | low]))
        for i, parts in enumerate(out):
            own = coded[firsts[i] : firsts[i + 1]]
            parts.append(scan + own[0] + b"".join([bytes([0xFF, 0xD0 + j % 8]) + s for j, s in enumerate(own[1:])]))
    return [b"".join(parts) + b"\xff\xd9" for parts in out]


# ---- decoder ----
#: What a file that is broken, or no progressive JPEG, may raise.
BROKEN = (ValueError, LookupError, AttributeError, TypeError, ArithmeticError, MemoryError, struct.error)
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
RST = re.compile(rb"\xff[\xd0-\xd7]")


@dataclass
class Scan:
    components: tuple[int, ...]
    first: int
    last: int
    high: int
    low: int
    dc: list[Table]
    ac: Table | None
    restart: int
    segments: list[bytes]


@dataclass
class Image:
    layout: Layout
    quantizers: list[np.ndarray]
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""


@lru_cache(maxsize=64)
def tables_in(body: bytes) -> list[tuple[tuple[int, int], Table]]:
    """Class and number, and table, of each of a segment's Huffman tables."""
    out = []
    while body:
        counts = tuple(body[1:17])
        out.append(((body[0] >> 4, body[0] & 15), Table(counts, tuple(body[17 : 17 + sum(counts)]))))
        body = body[17 + sum(counts) :]
    return out


def parsed(data: bytes) -> Image:
    """Frame and scans of a progressive JPEG (8 bits, Huffman coding)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, restart, comment, image = 2, 0, b"", None
    quant: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], Table] = {}
    ids: list[int] = []
    while at < len(data) - 1:
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        code = data[at + 1]
        if code == 0xD9:
            break
        if code == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xDB:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                quant[n] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif code == 0xC4:
            tables.update(tables_in(body))
        elif code == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif code == 0xFE:
            comment = body
        elif code == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            ids = [body[6 + 3 * i] for i in range(n)]
            image = Image(Layout(width, height, tuple((body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n))), [quant[body[8 + 3 * i]] for i in range(n)])
        elif 0xC0 <= code <= 0xCF and code not in (0xC8, 0xCC):
            raise ValueError("only progressive Huffman frames are read")
        elif code == 0xDA:
            n = body[0]
            a, b, h = body[1 + 2 * n : 4 + 2 * n]
            end = m.start() if (m := MARKER.search(data, at)) else len(data)
            segments = [s.replace(b"\xff\x00", b"\xff") for s in RST.split(data[at:end])]
            dc = [tables.get((0, body[2 + 2 * i] >> 4)) for i in range(n)]
            image.scans.append(Scan(tuple(ids.index(body[1 + 2 * i]) for i in range(n)), a, b, h >> 4, h & 15, dc, tables.get((1, body[2] & 15)), restart, segments))
            at = end
    if image is None or not image.scans:
        raise ValueError("no frame or no scan")
    image.comment = comment
    return image


class Lanes:
    """Bit positions of many segments in one buffer."""

    def __init__(self, segments: list[bytes]) -> None:
        raw = np.frombuffer(b"".join([*segments, bytes(16)]), np.uint8).astype(np.uint64)
        n = len(raw) - 8
        self.words = np.zeros(n, np.uint64)
        for j in range(8):
            self.words |= raw[j : j + n] << np.uint64(56 - 8 * j)
        sizes = np.array([len(s) for s in segments], np.int64)
        self.start = 8 * (np.cumsum(sizes) - sizes)
        self.limit = 8 * (n - 1)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The bits from `at` on, left-aligned in 64 (57 at least are valid)."""
        at = np.minimum(at, self.limit)
        return self.words[at >> 3] << (at & 7).view(np.uint64)


def top(word: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """The first n bits of left-aligned words; n may be 0."""
    return ((word >> np.uint64(1)) >> np.asarray(63 - n, np.int64).view(np.uint64)).view(np.int64)


def extended(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    full = 1 << size
    return np.where(2 * v < full - (size == 0), v - full + 1, v)


class Reader:
    """One scan of many images: lanes with their blocks."""

    def __init__(self, scans: list[tuple[Image, Scan]]) -> None:
        orders, segments, first, count, luts, self.tables, at = [], [], [], [], [], {}, 0
        for image, scan in scans:
            order, comp, unit = image.layout.order(scan.components)
            step = scan.restart * unit or len(order)
            n = min(-(-len(order) // step), len(scan.segments))
            orders.append((order, comp))
            segments += scan.segments[:n]
            first += [at + i * step for i in range(n)]
            count += [min(step, len(order) - i * step) for i in range(n)]
            own = tuple(self.tables.setdefault(t, len(self.tables)) if t else 0 for t in ([scan.ac] if scan.first else [scan.dc[scan.components.index(c)] if c in scan.components else None for c in range(max(scan.components) + 1)]))
            luts += [own] * n
            at += len(order)
        self.order, self.comp = np.concatenate([o for o, _ in orders]), np.concatenate([c for _, c in orders])
        self.lanes, self.first, self.count = Lanes(segments), np.array(first), np.array(count)
        width = max(map(len, luts))
        self.lut_of = np.array([x + (0,) * (width - len(x)) for x in luts])
        self.lut = np.concatenate([t.lookup() for t in self.tables]) if self.tables else np.zeros(1 << 16, np.uint16)
        self.plain = len(self.tables) < 2

    def symbols(self, word: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (word >> np.uint64(48)).view(np.int64)
        got = self.lut[at if self.plain else at + (table << 16)].astype(np.int64)
        return got >> 8, got & 255

    def dc(self, coef: np.ndarray, high: int, low: int) -> None:
        at, pred = self.lanes.start.copy(), np.zeros((len(self.first), int(self.comp.max()) + 1), np.int64)
        for t in range(int(self.count.max())):
            live = np.flatnonzero(self.count > t)
            block, comp = self.order[self.first[live] + t], self.comp[self.first[live] + t]
            word = self.lanes.peek(at[live])
            if high:
                coef[block, 0] |= top(word, 1) << low
                at[live] += 1
                continue
            size, length = self.symbols(word, self.lut_of[live, comp])
            diff = extended(top(word << length.view(np.uint64), size), size)
            pred[live, comp] += diff
            coef[block, 0] = pred[live, comp] << low
            at[live] += length + size

    def ac_first(self, coef: np.ndarray, a: int, b: int, low: int) -> None:
        flat, starts = coef.reshape(-1), self.order * 64
        at, table = self.lanes.start.copy(), self.lut_of[:, 0]
        place, end, k = self.first.copy(), self.first + self.count, np.full(len(self.first), a)
        while True:
            live = place < end
            if not live.all():
                at, table, place, end, k = at[live], table[live], place[live], end[live], k[live]
            if not len(at):
                return
            word = self.lanes.peek(at)
            symbol, length = self.symbols(word, table)
            run, size = symbol >> 4, symbol & 15
            ends = (size == 0) & (run < 15)
            extra = np.where(ends, run, size)
            bits = top(word << length.view(np.uint64), extra)
            at = at + length + extra
            k = k + run
            put = np.flatnonzero(size)
            flat[starts[place[put]] + np.minimum(k[put], 63)] = extended(bits[put], size[put]) << low
            k = k + 1
            # The end of a block, or of a run of blocks.
            over = ends | (k > b)
            place = place + np.where(ends, (1 << run) + bits, over)
            k = np.where(over, a, k)

    def ac_refine(self, coef: np.ndarray, a: int, b: int, low: int) -> None:
        """Each step reads one symbol, or the corrections of one block of a run; the places of all correction bits are gathered and read at last."""
        band = coef[self.order, a : b + 1]
        width = b + 1 - a
        old = band != 0
        zero_at = np.append(np.argsort(old, axis=1, kind="stable"), np.full((len(band), 1), width), axis=1)
        n_zero = width - old.sum(axis=1)
        passed = np.append(0, np.cumsum(old.ravel()))  # corrections before each coefficient, in scan order
        at, table = self.lanes.start.copy(), self.lut_of[:, 0]
        place, end = self.first.copy(), self.first + self.count
        k, zero, run_of = (np.zeros(len(at), np.int64) for _ in range(3))
        new, notes = [], []
        while True:
            live = place < end
            if not live.all():
                at, table, place, end, k, zero, run_of = (x[live] for x in (at, table, place, end, k, zero, run_of))
            if not len(at):
                break
            reads = run_of == 0
            word = self.lanes.peek(at)
            symbol, length = self.symbols(word, table)
            run, size = symbol >> 4, symbol & 15
            ends = reads & (size == 0) & (run < 15)
            extra = np.where(ends, run, size)
            bits = top(word << length.view(np.uint64), extra)
            at = at + np.where(reads, length + extra, 0)
            run_of = np.where(ends, (1 << run) + bits, run_of)
            whole = run_of > 0  # the rest of this block has corrections only
            nth = np.minimum(zero + run, n_zero[place])
            target = np.where(whole, width, zero_at[place, np.where(nth < n_zero[place], nth, width)])
            lo, hi = passed[place * width + k], passed[place * width + target]
            notes.append((lo, hi, at))
            at = at + hi - lo
            put = np.flatnonzero(~whole & (size > 0) & (target < width))
            new.append((place[put] * width + target[put], np.where(bits[put] > 0, 1, -1) << low))
            k, zero = target + 1, zero + run + 1
            over = whole | (k >= width)
            place, run_of = place + over, run_of - whole
            k, zero = np.where(over, 0, k), np.where(over, 0, zero)
        lo, hi, at = (np.concatenate(x) for x in zip(*notes, strict=True))
        flat, n = band.ravel(), hi - lo
        own = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        which, bit = np.repeat(lo, n) + own, top(self.lanes.peek(np.repeat(at, n) + own), 1)
        olds = np.flatnonzero(old.ravel())[which]
        flat[olds] += np.sign(flat[olds]) * (bit << low)
        for where, v in new:
            flat[where] = v
        coef[self.order, a : b + 1] = flat.reshape(band.shape)


def decoded(images: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Frames, and the coefficients of all blocks of all images in zigzag order."""
    out = [parsed(data) for data in images]
    return out, coefficients(out)


def coefficients(out: list[Image]) -> np.ndarray:
    """The coefficients of all blocks of all images in zigzag order; the images' layouts are placed one after another."""
    base = 0
    for image in out:
        image.layout = Layout(image.layout.width, image.layout.height, image.layout.sampling, base)
        base += image.layout.blocks
    coef = np.zeros((base, 64), np.int32)
    # A scan needs the earlier ones of its components only, so scans of different components are read together.
    levels: list[dict[tuple, list]] = []
    for x in out:
        seen = [0] * len(x.layout.sampling)
        for s in x.scans:
            level = max(seen[c] for c in s.components)
            for c in s.components:
                seen[c] = level + 1
            if level == len(levels):
                levels.append({})
            levels[level].setdefault((s.first, s.last, s.high, s.low), []).append((x, s))
    for groups in levels:
        for (a, b, high, low), scans in groups.items():
            reader = Reader(scans)
            if a == 0:
                reader.dc(coef, high, low)
            elif high:
                reader.ac_refine(coef, a, b, low)
            else:
                reader.ac_first(coef, a, b, low)
    return coef


def payload_of(image: Image, coef: np.ndarray) -> bytes:
    """The bytes that stored() put in."""
    n = int(image.comment.partition(b"=")[2])
    return (coef[image.layout.order((0, 1, 2))[0][: n // 64]] + OFFSET).astype(np.uint8).tobytes()


def samples(images: list[Image], coef: np.ndarray) -> np.ndarray:
    """Blocks of 64 samples (0 to 255) by the inverse transform.  The tiny bias keeps halves from depending on the order of sums."""
    q = np.ones((len(coef), 64))
    plain = all((t == 1).all() for x in images for t in x.quantizers)
    if not plain:
        for x in images:
            bounds = [*x.layout.starts, x.layout.base + x.layout.blocks]
            for c, t in enumerate(x.quantizers):
                q[bounds[c] : bounds[c + 1]] = t
    return np.clip(np.rint((coef if plain else coef * q).astype(np.float64) @ inverse_dct() + (128 + 1e-7)), 0, 255).astype(np.uint8)


def rgb(image: Image, blocks: np.ndarray) -> np.ndarray:
    """height x width x 3 bytes: planes put together, chroma repeated to full resolution, and converted."""
    at, planes = image.layout, []
    for c, (h, v) in enumerate(at.sampling):
        across, down = at.across * h, at.down * v
        plane = blocks[at.starts[c] : at.starts[c] + across * down].reshape(down, across, 8, 8).swapaxes(1, 2).reshape(down * 8, across * 8)
        if (h, v) != (at.hmax, at.vmax):
            plane = plane.repeat(at.vmax // v, axis=0).repeat(at.hmax // h, axis=1)
        planes.append(plane[: at.height, : at.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = (p.astype(np.int32) for p in planes[:3])
    cb, cr = cb - 128, cr - 128
    # Fixed-point factors of the usual conversion, in 1/65536.
    full = (y << 16) + 32768
    out = np.empty((*y.shape, 3), np.uint8)
    for i, x in enumerate((full + 91881 * cr, full - 22554 * cb - 46802 * cr, full + 116130 * cb)):
        out[:, :, i] = np.clip(x >> 16, 0, 255)
    return out
