"""Personal data by rules and a semi-Markov conditional random field.

Base spans come from exact rules.  Around digits and at-signs a semi-CRF scores whole candidate segments (length in
tokens at most LONGEST, or a whole address) with features of the span as a whole, and dynamic programming picks boundaries and types
together.  Its segments that meet no base span are added; base spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, map_arrow, sent_by_bytes, text_or_empty

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# ---- base rules ----
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each at-sign, so that long runs of letters cost no more than their length."""
    end = 0
    at = text.find("@")
    while at >= 0:
        if at >= end and (m := DOMAIN.match(text, at + 1)):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                yield start, end
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four groups of digits joined by single dots, from the left; a match with a part over 255 is dropped."""
    run: list[tuple[int, int]] = []
    for m in DIGITS.finditer(text):
        a, b = m.span()
        run = [*run, (a, b)] if run and text[run[-1][1] : a] == "." else [(a, b)]
        if len(run) == 4:
            parts = [text[x:y].lstrip("0") for x, y in run]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                yield run[0][0], b
            run = []


def base_spans(text: str) -> list[Span]:
    """The rules' spans by start, then kind as listed."""
    if not TRIGGER.search(text):
        return []
    out = [(a, b, "email") for a, b in emails(text)]
    out += [(a, b, "ip") for a, b in addresses(text)]
    for m in CHAIN.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- candidate segments and their features ----
LONGEST = 17  # tokens of a segment, enough for 19 digits in groups of two or more; whole addresses may be longer
N_DIGITS = {"ip": (4, 12), "card": (12, 19), "phone": (7, 15)}  # digits of a segment of a kind
AROUND = 24  # characters of context on either side of a run
NUMBERS = re.compile(r"[+(0-9][\x20().0-9/+-]*")
HOST = LOCAL - frozenset("_%+")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.DOTALL)
CLASS = {"email": re.compile(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9.-]+"), "ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}"), "card": re.compile(r"[0-9]+(?:[ .-]{1,2}[0-9]+)*"), "phone": re.compile(r"(?:\+|\(|[0-9])[\x20().0-9/-]*[0-9]")}


def address_run(text: str, at: int) -> tuple[int, int]:
    """The widest segment around an at-sign that can be an address, with a space on either side of the sign or none."""
    a, b = at - (text[at - 1 : at] == " "), at + 1 + (text[at + 1 : at + 2] == " ")
    while a > 0 and text[a - 1] in LOCAL:
        a -= 1
    while b < len(text) and text[b] in HOST:
        b += 1
    return a, b


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Runs of address or number characters with what stands around them; no edge is inside a word."""
    runs = [m.span() for m in NUMBERS.finditer(text) if TRIGGER.search(m.group())]
    at = text.find("@")
    while at >= 0:
        runs.append(address_run(text, at))
        at = text.find("@", at + 1)
    near = merged([(max(0, a - AROUND), min(len(text), b + AROUND)) for a, b in runs])
    whole = []
    for k, (a, b) in enumerate(near):
        least, most = near[k - 1][1] if k else 0, near[k + 1][0] if k + 1 < len(near) else len(text)
        while a > least and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        while b < most and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
        whole.append((a, b))
    yield from merged(whole)


def kind_of(c: str) -> str:
    return "edge" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c if c in "+-.@/:,_=\"'()" else "sign"


def features(kind: str, s: str, before: str, after: str) -> list[str]:
    """Features of a whole segment of a kind: digits, groups, separators, checksums, what stands beside it."""
    digits = "".join(c for c in s if c.isdigit())
    groups = DIGITS.findall(s)
    marks = "".join(sorted({c for c in s if not c.isalnum()}))
    out = ["bias", f"before {kind_of(before)}", f"after {kind_of(after)}", f"marks {marks}"]
    if kind == "email":
        name, _, host = s.partition("@")
        out += [f"dots {min(host.strip().count('.'), 3)}", f"last letters {host[-2:].isalpha()}", f"name {bool(name.strip())}", f"gap {' ' in s}", f"ends {kind_of(s[-1])} {kind_of(s[0])}"]
    elif kind == "ip":
        out += [f"octets {len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)}"]
    elif kind == "card":
        out += [f"n {min(max(len(digits), 12), 20)}", f"luhn {luhn(digits)} {14 <= len(digits) <= 19}", f"even groups {len(set(map(len, groups))) == 1}", f"years {all(len(g) == 4 and g[:2] in ('19', '20') for g in groups)}", f"first {digits[:1]}"]
    else:
        out += [f"n {min(max(len(digits), 6), 16)}", f"plus {s[0] == '+'} {s[0] == '('}", f"shape {'-'.join(str(min(len(g), 5)) for g in groups[:5])}", f"open {s.count('(') == s.count(')')}", f"groups {min(len(groups), 6)}"]
    return [f"{kind}|{x}" for x in out]


def long_addresses(text: str, bounds: list[int]) -> dict[int, list[int]]:
    """First token -> tokens after the last of whole addresses of more than LONGEST tokens, with and without marks at their ends."""
    place, out = {x: k for k, x in enumerate(bounds)}, {}
    at = text.find("@", bounds[0], bounds[-1])
    while at >= 0:
        a, b = address_run(text, at)
        name, host = text[a:at], text[at + 1 : b]
        for x in {a, at - len(name.lstrip("._%+-"))}:
            for y in {b, at + 1 + len(host.rstrip(".-"))}:
                if x in place and y in place and place[y] - place[x] > LONGEST:
                    out.setdefault(place[x], []).append(place[y])
        at = text.find("@", at + 1, bounds[-1])
    return out


def in_a_row(text: str, x: int, y: int) -> bool:
    """Whether a number goes on before or after text[x:y], set off by a mark that also stands inside: as in a table or a chain."""
    left, right = text[x - 1 : x], text[y : y + 1]
    goes_on = x > 1 and left in " .-/" and text[x - 2].isdigit() and left in text[x:y]
    return goes_on or bool(right) and right in " .-/" and text[y + 1 : y + 2].isdigit() and right in text[x:y]


def token_bounds(text: str, a: int, b: int) -> list[int]:
    return [a + m.start() for m in TOKEN.finditer(text[a:b])] + [b]


def segments(text: str, bounds: list[int]) -> Iterator[tuple[int, int, str, list[str]]]:
    """Candidate segments by their first token: (first token, token after the last, kind, features); O is one token.

    Made one by one, so that a window of any length takes no more memory than its tokens.
    """
    n = len(bounds) - 1
    first = [text[x] for x in bounds[:-1]]
    digits = [0, *accumulate(y - x if c.isdigit() else 0 for x, y, c in zip(bounds, bounds[1:], first, strict=False))]
    signs = [0, *accumulate(c == "@" for c in first)]
    long = long_addresses(text, bounds) if signs[n] else {}
    fewest, most = min(d for d, _ in N_DIGITS.values()), max(d for _, d in N_DIGITS.values())
    for i in range(n):
        yield i, i + 1, "O", [f"O|{kind_of(first[i])}"]
        if first[i].isspace():
            continue
        x, number = bounds[i], first[i].isdigit() or first[i] in "+("
        address = signs[n] > signs[i] and first[i] in LOCAL
        for j in range(i + 1, min(i + LONGEST, n) + 1):
            d, at = digits[j] - digits[i], signs[j] - signs[i]
            if first[j - 1] == "\n" or at > 1 or not address and (not number or at or d > most):
                break
            y = bounds[j]
            if at and address:
                if y - x >= 6 and CLASS["email"].fullmatch(text, x, y):
                    yield i, j, "email", features("email", text[x:y], text[x - 1 : x], text[y : y + 1])
            elif number and fewest <= d <= most and first[j - 1].isdigit():
                for kind, (low, high) in N_DIGITS.items():
                    if low <= d <= high and y - x >= 6 and CLASS[kind].fullmatch(text, x, y) and not in_a_row(text, x, y):
                        yield i, j, kind, features(kind, text[x:y], text[x - 1 : x], text[y : y + 1])
        for j in sorted(long.get(i, [])):
            y = bounds[j]
            if CLASS["email"].fullmatch(text, x, y):
                yield i, j, "email", features("email", text[x:y], text[x - 1 : x], text[y : y + 1])


class SemiCRF:
    """Weights of a semi-Markov CRF: the score of a segmentation is the sum over its segments."""

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.weights = weights or {}

    def score(self, names: list[str]) -> float:
        return sum(self.weights.get(x, 0.0) for x in names)

    def best(self, n: int, segments: Iterable) -> list[tuple[int, int, str]]:
        """The highest-scoring segmentation of n tokens, without its O segments."""
        top, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for i, j, kind, names in segments:  # by first token: top[i] is final when i is left
            if (s := top[i] + self.score(names)) > top[j]:
                top[j], back[j] = s, (i, j, kind)
        out, j = [], n
        while j:
            out.append(back[j])
            j = back[j][0]
        return [s for s in reversed(out) if s[2] != "O"]

    def gradient(self, n: int, segments: list, gold: set) -> tuple[dict[str, float], float]:
        """Features of the gold segmentation less their expectation, and the log likelihood."""
        scores = [self.score(s[3]) for s in segments]
        ahead, behind = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for (i, j, _, _), s in zip(segments, scores, strict=True):
            ahead[j].append((i, s))
            behind[i].append((j, s))
        total = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
        alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            alpha[j] = total([alpha[i] + s for i, s in ahead[j]])
        for i in range(n - 1, -1, -1):
            beta[i] = total([beta[j] + s for j, s in behind[i]])
        out, likely = {}, -alpha[n]
        for (i, j, kind, names), s in zip(segments, scores, strict=True):
            is_gold = (i, j, kind) in gold
            likely += s * is_gold
            p = is_gold - math.exp(min(0.0, alpha[i] + s + beta[j] - alpha[n]))
            if abs(p) > 1e-6:
                for x in names:
                    out[x] = out.get(x, 0.0) + p
        return out, likely

    def find(self, text: str) -> list[Span]:
        out = []
        for a, b in windows(text):
            bounds = token_bounds(text, a, b)
            out += [(bounds[i], bounds[j], kind) for i, j, kind in self.best(len(bounds) - 1, segments(text, bounds))]
        return out


# ---- training on made examples; nothing of the corpus is needed ----
def example(rng: random.Random) -> tuple[str, list[Span]]:
    """A line with invented personal data of any written form, other numbers, and its true spans."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abdefghilmnorstuv") for _ in range(rng.randint(2, 8)))
    host = lambda: rng.choice([f"{word()}.{rng.choice(['com', 'org', 'net', 'de'])}", f"{word()}{number(1)}.{word()}.com"])

    def card() -> str:
        body = rng.choice("3456") + number(14)
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", "", " ", "-", "."])
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randint(20, 99)} {a} {b}{c}", f"0{a[:2]} {b} {c}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{number(rng.randint(2, 3))}{rng.choice(' -/')}{number(rng.randint(6, 8))}"])

    made = {
        "email": lambda: rng.choice([f"{word()}.{word()}@{host()}", f"{word()}{number(2)}@{host()}", f"{word()}@{host()}", f"{word()} @ {host()}"]),
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "card": card, "phone": phone,
        "": lambda: rng.choice([f"{rng.randint(10, 28)}{(sep := rng.choice('/.'))}0{rng.randint(1, 9)}{sep}{rng.choice(['19', '20'])}{number(2)}", f"20{number(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{number(2)}:{number(2)}", f"{rng.randint(1, 9)}.{number(1)}.{number(2)}", f"{rng.randint(1, 9)},{number(3)}.{number(2)}", number(rng.randint(1, 6)), number(rng.choice([9, 11, 12, 13, 20, 24])), f"{word()}{number(3)}", f"{number(2)}-{number(2)}", f"@{word()}", f"{number(4)}-{number(4)}", "".join(rng.choice("0123456789abcdef") for _ in range(32)), f"{number(3)} {number(3)} {number(3)} {number(2)} {number(3)} {number(1)}", " ".join(number(rng.randint(1, 5)) for _ in range(rng.randint(3, 9))), ", ".join(f"{number(rng.randint(1, 3))}.{number(rng.randint(1, 6))}" for _ in range(rng.randint(2, 6))), f"97{rng.choice('89')}-{number(1)}-{number(rng.randint(2, 5))}-{number(4)}-{number(1)}", f"{number(4)}-{number(6)}", f"{rng.randint(1, 9)}.{number(3)}.{number(3)},{number(2)}", " ".join(rng.choice(["19", "20"]) + number(2) for _ in range(rng.randint(2, 5)))]),
    }
    text, spans = "", []
    for _ in range(rng.randint(1, 3)):
        text += " ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice([" ", " ", ": ", ", ", ' "', " <"])
        kind = rng.choice([*KINDS, "", "", ""])
        s = made[kind]()
        if kind:
            spans.append((len(text), len(text) + len(s), kind))
        text += s + rng.choice([" ", ". ", ", ", '" ', "### ", "$$$ ", "\n", "!! "])
    return text + word(), spans


@lru_cache(maxsize=4)
def trained(examples: int = 400, rounds: int = 6, seed: int = 11) -> SemiCRF:
    """A semi-CRF fitted by stochastic gradient ascent on `examples` made lines (the bound of the fit)."""
    rng, model, data = random.Random(seed), SemiCRF(), []
    while len(data) < examples:
        text, spans = example(rng)
        for a, b in windows(text):
            bounds = token_bounds(text, a, b)
            own = list(segments(text, bounds))
            inside = {(bounds.index(x), bounds.index(y), k) for x, y, k in spans if x in bounds and y in bounds}
            covered = {t for i, j, _ in inside for t in range(i, j)}
            known = {s[:3] for s in own}
            if inside <= known:
                data.append((len(bounds) - 1, own, inside | {(i, i + 1, "O") for i in range(len(bounds) - 1) if i not in covered}))
    for r in range(rounds):
        rng.shuffle(data)
        rate = 0.3 / (1 + 0.5 * r)
        for n, own, gold in data:
            for x, g in model.gradient(n, own, gold)[0].items():
                model.weights[x] = model.weights.get(x, 0.0) * (1 - 1e-4 * rate) + rate * g
    return model


# ---- operator ----
def all_spans(text: str, model: SemiCRF) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), both by start, then kind."""
    base = base_spans(text)
    if not base and not TRIGGER.search(text):
        return base, base
    added = []
    for a, b, kind in model.find(text):
        if all(b <= x or y <= a for x, y, _ in base):
            added.append((a, b, kind))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if added else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def personal_data(df: DataFrame, text: str = "text", model: SemiCRF | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (all) of each row; offsets in code points, ends exclusive.

    Map-only.  A null text counts as empty and has no spans; rows keep repeats; an empty table gives none; further
    columns are ignored.  Work and memory grow with the length of a text, numeric tables included.  A number that others
    go on beside, set off by a mark that it has inside too, is taken for a part of a row and not added.
    """
    weights = (model or trained()).weights

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        crf, counts, sha, spans = SemiCRF(weights), {k: [] for k in KINDS}, [], []
        for t in batch.column(1).to_pylist():
            base, every = all_spans(t, crf)
            for k in KINDS:
                counts[k].append(sum(s[2] == k for s in base))
            sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
        return pa.record_batch([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return map_arrow(rows, per_batch, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, end = [], 0
    for a, b, kind in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:] if out else text


def redacted(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars", model: SemiCRF | None = None) -> DataFrame:
    """df with personal data in its text replaced by [KIND]; n_chars, where there is one, follows.  Null texts stay null."""
    weights = (model or trained()).weights
    at = df.columns.index(text)
    plain = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in df.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = SemiCRF(weights)
        for batch in by_bytes(batches):
            new = [t and redact(t, all_spans(t, crf)[1]) for t in batch.column(at).to_pylist()]
            columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = sent_by_bytes(df).mapInArrow(run, plain)
    return out.withColumn(n_chars, F.length(text).cast(df.schema[n_chars].dataType)) if n_chars in df.columns else out
