"""Operators on documents against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from flowgrid.llm import bpe, media, ordermin, packing, pii, queries, quality, secrets, simhash, token_counts
from flowgrid.llm.common import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_tokens long, spans string, fp long"
LONG = "word1 Wort2 mot3 café 😀 " * 4000
ODD = [None, "", " ", "a", "A a A a A a", "x" * 5000, LONG, "same text here", "same text here", "<|endoftext|> tail", "é" * 70, " \x85\xa0 z", "0" * 40]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns whose names clash."""
    rows = [(i, t, None, 7, "clash", 1) for i, t in enumerate(ODD)] + [(3, "a", "en", None, None, None), (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


EVERY = {
    "op1": lambda d: ordermin.edited_fingerprints(d), "op2": lambda d: secrets.secret_spans(d), "op3": lambda d: pii.personal_data(d), "op5": lambda d: media.stored_features(d),
    "op7": lambda d: bpe.round_trip_digests(d), "op8": lambda d: token_counts.token_counts(d), "op9": lambda d: packing.pack_texts(d), "op10": lambda d: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", EVERY)
def test_odd_rows_and_empty_table(spark, odd, name):
    got = EVERY[name](odd).collect()
    pieces = sum(1 for r in got if name != "op9" or r.piece == 0)
    assert pieces == odd.count()
    assert EVERY[name](odd.limit(0)).collect() == []
    same = [r for r in got if r.doc_id in (7, 8)]  # equal texts, equal values
    skip = {"doc_id", "edited_sha256", "edited_fingerprint", "near_edited", "near_next", "sequence_id", "offset"}
    assert len({tuple(v for k, v in r.asDict().items() if k not in skip) for r in same}) == 1


def test_order_minhash(documents, texts):
    ids = sorted(texts)
    got = {r.doc_id: r for r in ordermin.edited_fingerprints(documents).collect()}
    assert len(got) == len(ids)
    for i, d in enumerate(ids):
        t, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        q = len(t) // 4
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()
        assert got[d].n_chars == len(t)
    mean = lambda k: sum(r[k] for r in got.values()) / len(got)
    assert mean("near_edited") > 0.25 > mean("near_next")


def test_order_minhash_by_brute_force(spark):
    """Whole fingerprints by plain loops; order matters, repeats are told apart, one k-mer fills one place only."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    number = lambda x, n: (x & ((1 << 8 * n) - 1)).to_bytes(n, "little")

    def chain(values):  # several values are hashed in turn, each result the next one's seed; nulls are passed over
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v, seed) if v is not None else seed
        return signed(seed)

    def slow(text):
        words = re.findall(ordermin.WORD, text)
        seen, kmers = {}, []
        for i in range(max(len(words) - 3, 0) + 1):
            h = signed((chain([w and w.encode() for w in [*words[i : i + 3], None, None, None][:3]]) << ordermin.PLACE) % (1 << 64)) >> ordermin.PLACE
            o = seen[h] = seen.get(h, -1) + 1
            kmers.append(h if o == 0 else chain([number(h, 8), number(o, 4)]))
        out = ""
        for slot in range(ordermin.SLOTS):
            first = sorted((chain([number(h, 8), number(slot, 4)]), i) for i, h in enumerate(kmers))[:2]
            out += f"{chain([number(slot, 4), *[number(k, 8) for k, _ in sorted(first, key=lambda x: x[1])]]) & 0xFFFFFFFF:08x}"
        return out

    a, b = "one two three four five six seven eight nine ten " * 3, "six seven eight nine ten one two three four five " * 3
    rows = [a, b, a, "", "single", "x y z " * 50, "é" * 100, "數據處理系統設計與實現" * 9, "camelCaseRun0123And456More" * 3]
    got = [r.fingerprint for r in ordermin.fingerprints(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [slow(t) for t in rows] and got[0] == got[2] != got[1]


def shared_slots(a, b):
    return sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) / ordermin.SLOTS


def test_order_minhash_likeness(spark):
    """Slots are independent: over many pairs of texts the likeness strays as 32 separate draws do."""
    rng, rows = random.Random(4), []
    for i in range(300):
        words = [f"w{i}x{j}" for j in range(300)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:255], *[f"v{i}x{rng.getrandbits(30)}" for _ in range(45)]]))]
    got = {r.doc_id: r.fingerprint for r in ordermin.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = np.array([shared_slots(got[2 * i], got[2 * i + 1]) for i in range(300)])
    p = near.mean()
    assert 0.45 < p < 0.65 and near.std() < 1.12 * (p * (1 - p) / ordermin.SLOTS) ** 0.5


def test_order_minhash_without_spaces(spark):
    """One character put into a text of a script without spaces changes few words."""
    rng = random.Random(6)
    base = "".join(chr(0x4E00 + rng.randint(0, 5000)) for _ in range(400))
    df = spark.createDataFrame([(0, base), (1, base[:30] + "新" + base[30:])], "doc_id long, text string")
    a, b = (r.fingerprint for r in ordermin.fingerprints(df).orderBy("doc_id").collect())
    assert shared_slots(a, b) > 0.8


def entropy(w):
    return -sum(c / len(w) * math.log2(c / len(w)) for c in (w.count(x) for x in set(w)))


def test_secrets_by_brute_force(spark):
    assign = re.compile(secrets.ASSIGN, re.ASCII)
    rng = random.Random(3)
    parts = ["token", "Secret", "api_key", "apikey", "PASSWORD", " = ", ": ", "=", "'", '"', "AKIA", "ABCDEF0123456789", "é😀", "deadbeef0123", "9f8e7d6c5b4a", "Zx9", "qQ7+/", "\n", " ", "_", "the", "0123456789", "aB3dE5gH7jK9mN1pQ3sT", "QwErTyUiOpAsDfGhJkLz", "plainWordsInCamelCase", "xqzjvkwpbmfygdhtcrnlsueoia"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    got = {r.doc_id: r for r in secrets.secret_spans(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    join = lambda q: ",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in q)
    for i, t in enumerate(rows):
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m.group(2)) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
        base = sorted(base + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24])
        added = []
        for m in re.finditer(secrets.CANDIDATE, t):
            b = m.group()
            if any(x < m.end() and m.start() < y for x, _, y in base) or any(re.search(p, b) for p in secrets.ALLOWED):
                continue
            need = next(bits for _, p, bits in secrets.CLASSES if re.search(p, b))
            if max(entropy(b[k : k + 20]) for k in range(len(b) - 19)) >= need - 1e-9:
                added.append((m.start(), 3, m.end()))
        assert got[i].base_sha256 == hashlib.sha256(join(base).encode()).hexdigest()
        assert got[i].spans == join(sorted(base + added))


def test_secrets_in_long_runs(spark):
    """Long candidates, as in data URIs, take time in proportion to their length; so do many short ones."""
    rng = random.Random(8)
    key = lambda n: "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(n))
    low = "xy" * 5000
    texts = [f"data:{key(10_000)};", f"data:{key(100_000)};", f"{low}{key(20)}{low}", low + low, " ".join(["word", "aB3dE5gH7jK9mN1pQ3sT"] * 20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = [r.spans for r in secrets.secret_spans(df).orderBy("doc_id").collect()]
    assert time.time() - began < 40
    assert got[:4] == ["entropy:5:10005", "entropy:5:100005", "entropy:0:20020", ""]
    assert got[4].split(",") == [f"entropy:{26 * i + 5}:{26 * i + 25}" for i in range(20_000)]
    letters = spark.createDataFrame([(0, "xX qWeRtYuIoPaSdFgHjKlZ"), (1, "internationalizationOfSomeLongIdentifier /usr/local/share/some_long_name-of-a-file")], "doc_id long, text string")
    assert [r.spans for r in secrets.secret_spans(letters).orderBy("doc_id").collect()] == ["entropy:3:23", ""]


def plain_pii(s):
    out = [(x.start(), x.end(), "email") for x in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]
    out += [(x.start(), x.end(), "ip") for x in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if all(int(v) <= 255 for v in x.group().split("."))]
    for x in re.finditer(r"[0-9]([\x20-]?[0-9])+", s):
        d = re.sub("[^0-9]", "", x.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((x.start(), x.end(), "card"))
    out += [(x.start(), x.end(), "phone") for x in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", s) if 10 <= len(re.sub("[^0-9]", "", x.group())) <= 15]
    return sorted(out, key=lambda q: (q[0], pii.KINDS.index(q[2])))


def test_pii_base_by_brute_force():
    rng = random.Random(5)
    for _ in range(8000):
        s = "".join(rng.choice("01259@..  +-()a_Z%é000012") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(s) == plain_pii(s)


def test_pii_held_out_accuracy():
    model, rng, right, wrong, missed = pii.trained(), random.Random(99), 0, 0, 0
    for _ in range(300):
        s, gold = pii.example(rng)
        got, gold = set(model.find(s)), set(gold)
        right, wrong, missed = right + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97
    assert pii.redact("mail a.b@c.de now", pii.all_spans("mail a.b@c.de now", model)[1]) == "mail [EMAIL] now"


def test_semi_crf_is_exact():
    """The dynamic program against all segmentations of a small lattice."""
    model = pii.SemiCRF({"O|digit": 0.4, "O|.": 0.1, "x": 1.1, "y": 0.7})
    segments = [(i, i + 1, "O", ["O|digit" if i % 2 else "O|."]) for i in range(5)] + [(0, 2, "ip", ["y"]), (1, 4, "card", ["x"]), (2, 5, "phone", ["x", "y"])]
    segments.sort(key=lambda s: s[0])

    def walk(i):
        if i == 5:
            return [(0.0, [])]
        return [(model.score(s[3]) + v, ([s[:3]] if s[2] != "O" else []) + rest) for s in segments if s[0] == i for v, rest in walk(s[1])]

    assert model.best(5, segments) == max(walk(0))[1]


def test_quality_keeps_good_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ids = {r.doc_id for r in quality.sampled(docs, labels).collect()}
    rows = labels.collect()
    share = lambda q: sum(r.doc_id in ids for r in rows if r.quality == q) / sum(r.quality == q for r in rows)
    assert share(1) > 0.97 and share(0) < 0.1
    kept = quality.kept(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == ids
    assert quality.sampled(docs.limit(0), labels).collect() == []
    assert quality.sampled(docs, labels.limit(0)).count() == docs.count()  # no labels: all rows stay
    assert quality.sampled(docs, labels, k=100).count() == 100


def test_quality_by_brute_force(spark, documents, texts):
    """Log weights, noise and draw by plain loops; the noise changes the draw where weights are close, as it should."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality >= 1} - {r.doc_id for r in labels.collect() if r.quality < 1}

    def buckets(text):
        one = [zlib.crc32(p.encode()) for w in text.split() for p in regex.findall(r"\w+|[^\w\s]+", w)]
        pair = lambda a, b: ((a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F) & ((1 << 64) - 1)) >> 20
        return [h % quality.BUCKETS for h in [*one, *map(pair, one, one[1:])]]

    raw, target = [1] * quality.BUCKETS, [1] * quality.BUCKETS
    for d, t in texts.items():
        for h in buckets(t):
            raw[h] += 1
            target[h] += d in good
    ratio = [math.log(x * sum(raw) / y / sum(target)) for x, y in zip(target, raw, strict=True)]
    weight = {d: math.fsum(ratio[h] for h in buckets(t)) for d, t in texts.items()}

    def noise(d):
        h = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), xxhash.xxh64_intdigest(d.to_bytes(8, "little"), 42))
        return -math.log(-math.log(((h >> 11) + 0.5) / (1 << 53)))

    every = {r.doc_id: r for r in quality.select(documents, labels, k=100).scores.collect()}
    for d, w in weight.items():
        assert every[d].log_ratio == pytest.approx(w, abs=1e-6) and every[d].key == pytest.approx(w + noise(d), abs=1e-6)
    for k, temperature in ((170, 1.0), (100, 60.0)):
        drawn = {r.doc_id for r in quality.sampled(documents, labels, k=k, temperature=temperature).collect()}
        assert drawn == set(sorted(weight, key=lambda d: -weight[d] / temperature - noise(d))[:k])
    plain = set(sorted(weight, key=lambda d: -weight[d])[:100])
    assert 0 < len(drawn - plain) < 50


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0), (5, None, None), (None, 1, 1), (6, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.kept(odd, labels)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    drawn = [r.doc_id for r in quality.sampled(odd, labels).collect()]
    assert sorted(ids, key=str) == sorted(drawn, key=str) and (7 in ids) == (8 in ids)
    assert all(r.log_ratio == 0 and r.n_grams == 0 for r in quality.select(odd, labels, k=3).scores.where("doc_id in (0, 1, 2)").collect())


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([0.5, rng.random(), rng.gauss(0, 1e6)]) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 1700, 3000, 4999, 5000):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_tokens_as_the_library(spark, documents, texts, odd):
    word, byte = library("word_bpe_49k.json"), library("byte_bpe_50k.json")
    for df in (documents, odd):
        own = {(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want7, want8 = set(), set()
        for d, t in own:
            ids = word.encode(t, add_special_tokens=False).ids
            want7.add((d, len(ids), sha(" ".join(map(str, ids))), sha(word.decode(ids, skip_special_tokens=False))))
            n = len(byte.encode(t, add_special_tokens=False).ids)
            want8.add((d, len(t.encode()), n, n > 1024))
        assert {tuple(r) for r in bpe.round_trip_digests(df).collect()} == want7
        assert {tuple(r) for r in token_counts.token_counts(df).collect()} == want8
    pairs = bpe.encode(documents)
    assert bpe.decode(pairs).count() == len(texts)


def test_packing(spark, documents, texts):
    word = library("word_bpe_49k.json")
    for shard in (packing.SHARD, 40):
        rows = [r.asDict() for r in packing.pack(packing.pieces(documents), shard=shard).collect()]
        by_sequence, by_doc = {}, {}
        for r in rows:
            by_sequence.setdefault(r["sequence_id"], []).append(r)
            by_doc.setdefault(r["doc_id"], []).append(r)
        for own in by_sequence.values():
            at = 0
            for r in sorted(own, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 4096
        for d, t in texts.items():
            ids = np.array([*word.encode(t, add_special_tokens=False).ids, 1], "<u4")
            own = sorted(by_doc[d], key=lambda r: r["piece"])
            assert [r["length"] for r in own] == [min(4096, len(ids) - s) for s in range(0, len(ids), 4096)]
            for r in own:
                assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        total = sum(r["length"] for r in rows)
        assert len(by_sequence) <= total / 4096 * 1.05 + (2 if shard > 40 else 10)


def test_long_words_as_the_library():
    """Runs without a word break, in time about in proportion to their length."""
    rng = random.Random(1)
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [run("abcdefghijklmnopqrstuvwxyz", 60_000), "a" * 5001, "ab" * 3000, "é" * 2000 + "x", "the" * 1000 + "an" * 700, "aaab" * 900, run("etaoin", 3000) + " and short ones", run("數據處理系統", 3000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path, began = public_tokenizers.path(name), time.time()
        counted = token_counts.Counter(path).count(texts)
        ids = [np.frombuffer(x, "<u4").tolist() for x in packing.IdBytes(path).encode(texts)]
        joined = bpe.Encoder(path).encode(texts)
        assert time.time() - began < 20
        want = [library(name).encode(t, add_special_tokens=False).ids for t in texts]
        assert counted == [len(x) for x in want] and ids == want and joined == [(len(x), " ".join(map(str, x))) for x in want]


def packing_counts(n, rng):
    counts = {}
    for _ in range(n):
        k = min(4096, int(rng.lognormvariate(6, 1)) + 1)
        counts[k] = counts.get(k, 0) + 1
    return counts


def test_packing_plan_is_tight():
    counts = packing_counts(40_000, random.Random(2))
    places = packing.plan(counts, 4096)
    assert places.seq.max() + 1 <= 1.01 * sum(k * v for k, v in counts.items()) / 4096 + 1
    assert places.groupby("length").size().to_dict() == counts and not places.duplicated(["length", "rank"]).any()


def test_packing_plan_by_the_rule():
    """Each placement is the one with the smallest sum of squares, counted anew."""
    counts, size = packing_counts(300, random.Random(3)), 4096
    level = {}
    for length, seq, offset in packing.plan(counts, size)[["length", "seq", "offset"]].itertuples(index=False):
        gaps = [size - x for x in level.values() if x < size]
        cost = lambda g: sum(v * v for v in (g.count(x) for x in set(g)))
        ways = {}
        for gap in {x for x in gaps if x >= length}:
            rest = list(gaps)
            rest.remove(gap)
            ways[gap] = cost(rest + [gap - length] * (gap > length))
        ways.setdefault(size, cost(gaps + [size - length] * (length < size)))
        assert level.get(seq, 0) == offset and ways[size - offset] == min(ways.values())
        level[seq] = offset + length


def test_packing_of_equal_rows_and_shards(spark):
    """Many shards waste little, and equal rows keep places of their own."""
    rng = random.Random(4)
    lengths = [k for k, v in packing_counts(30_000, rng).items() for _ in range(v)]
    rows = [(i // 2, 0, 0, n, 1) for i, n in enumerate(lengths)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), shard=4000).toPandas()
    assert len(got) == len(rows) and not got.duplicated(["sequence_id", "offset"]).any()
    assert got.groupby("sequence_id").length.sum().max() <= 4096
    assert got.sequence_id.nunique() <= 1.02 * sum(lengths) / 4096


def brute_classes(prints, names):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    fp = np.array(prints, dtype=np.uint64)
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= 2):
            parent[find(i)] = find(i + 1 + int(j))
    least = {}
    for i, n in enumerate(names):
        least[find(i)] = min(least.get(find(i), n), n)
    return [least[find(i)] for i in range(len(fp))]


def test_simhash_by_brute_force(documents, texts):
    def slow(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        if not words:
            return 0
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = sorted(simhash.near_duplicates(documents).collect())
    prints = [int(r.fingerprint, 16) for r in rows]
    assert prints == [slow(texts[r.doc_id]) for r in rows]
    assert [r.component_id for r in rows] == brute_classes(prints, [r.doc_id for r in rows])
    kept = simhash.representatives(documents)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in rows}) and kept.columns == documents.columns


def test_simhash_links_in_crowded_buckets(spark):
    rng = np.random.default_rng(1)
    base, found = rng.integers(0, 1 << 62, 4, dtype=np.uint64), set()
    for k in range(1200):
        x = int(base[k % 4])
        for _ in range(int(rng.integers(0, 7))):
            x ^= 1 << int(rng.integers(0, 64))
        found.add(simhash.signed(x))
    prints = sorted(found)
    roots = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"))).collect()}
    assert [roots.get(x, x) for x in prints] == brute_classes([x & ((1 << 64) - 1) for x in prints], prints)


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001), (2001, 2002), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {2001: 2000, 2002: 2000}


def test_representatives_of_repeated_rows(spark, odd):
    kept = simhash.representatives(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and ids.count(3) == 1 and 8 not in ids and None in ids


def test_queries_are_registered():
    names = queries.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_secrets_in_runs_of_a_million(spark):
    """Every shape that a class or an allow-list entry takes, very long: no pattern may recurse for each word or character."""
    rng, n = random.Random(9), 1_000_000
    low = "abcdefghijklmnopqrstuvwxyz"
    run = lambda letters: "".join(rng.choices(letters, k=n))
    silent = ["a-" * (n // 2) + "b", "word/" * (n // 5) + "x1", "ab_" * (n // 3) + "9", "-" * n, "/" * n, "=" * n, "+" * n, "AbcDef" * (n // 6), "a/B-" * (n // 4), "ab_" * (n // 3) + "-"]
    found = [run(low + low.upper() + "0123456789+/"), run("0123456789"), run("0123456789abcdef")]
    other = [run(low + low.upper()), run("0123456789ABCDEF-"), run(low), run(low.upper())]  # by chance these hold base spans, allowed words or no window of enough entropy
    df = spark.createDataFrame(list(enumerate(silent + found + other)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.spans for r in secrets.secret_spans(df).collect()}
    assert all(got[i] == "" for i in range(len(silent)))
    assert [got[i + len(silent)] for i in range(len(found))] == [f"entropy:0:{n}", f"hex:0:{n}", f"hex:0:{n}"] and len(got) == len(silent + found + other)


def test_secrets_beside_the_patterns_are_recalled(spark, documents):
    """Keys planted in the given texts, in words that no base pattern knows; the same texts without them get nothing."""
    rng = random.Random(10)
    low = "abcdefghijklmnopqrstuvwxyz"
    kinds = {"base62": low + low.upper() + "0123456789", "base64": low + low.upper() + "0123456789+/", "upper": low.upper() + "0123456789", "hex": "0123456789ABCDEF", "letters": low + low.upper()}
    texts = [r.text or "" for r in documents.orderBy("doc_id").select("text").collect()]
    rows, keys = [], {}
    for i, (text, (kind, letters)) in enumerate(zip(texts, list(kinds.items()) * 40, strict=True)):
        key = "".join(rng.choices(letters, k=rng.choice([32, 40, 64])))
        at = rng.choice([k for k, c in enumerate(text) if c == " "] or [0])
        keys[i] = kind, f"entropy:{at + 5}:{at + 5 + len(key)}"
        rows.append((i, f"{text[:at]} key {key} {text[at:]}"))
    got = {r.doc_id: r.spans.split(",") for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in kinds:
        own = [keys[i][1] in got[i] for i in keys if keys[i][0] == kind]
        assert sum(own) >= 0.95 * len(own), kind
    clean = secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("spans like '%entropy%'")
    assert clean.count() == 0


def test_next_documents_with_hot_ids(spark):
    """Rows without a doc_id, and of one doc_id, are cut into ranges; each still gets the text that follows."""
    rng = random.Random(11)
    rows = [(i, f"{rng.random()} some words {rng.randrange(7)}") for i in [None] * 2500 + [5] * 2500 + list(range(900))] + [(5, "one text")] * 300
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (xxhash.xxh64_intdigest(r[1].encode(), 42) + (1 << 63)) % (1 << 64)))
    want = []
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        q = len(text) // 4
        want.append((doc, hashlib.sha256((text[: len(text) - q] + following[:q]).encode()).hexdigest()))
    got = ordermin.edited_fingerprints(df)
    assert sorted(((r.doc_id, r.edited_sha256) for r in got.select("doc_id", "edited_sha256").collect()), key=str) == sorted(want, key=str)
    docs, firsts = ordermin.in_buckets(df.withColumn("hash", F.xxhash64("text")), "doc_id", "hash")
    sizes = {r.bucket: r["count"] for r in docs.groupBy("bucket").count().collect()}
    assert len(firsts) == len(sizes) >= 14 and max(sizes.values()) <= 1000  # of 6,200 rows
