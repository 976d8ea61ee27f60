"""Conversation repair, centroid clustering and substring dedup against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from flowgrid.llm import clusters, conversations, queries, repeats

SF = "/root/testdata/sf0.001"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def cheapest(rows):
    """rows: (initial, must go, truncated).  Cost, audit and emitted roles, None for a row that is kept, by plain recursion."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @cache
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if inserts < 2:
            for made in "ua":
                if (state, made) in step and (w := best(i, step[state, made], inserts + 1)):
                    ways.append((5 + w[0], "I" + w[1], (("I", made), *w[2])))
        if i < len(rows):
            initial, gone, cut = rows[i]
            if w := best(i + 1, state, 0):
                ways.append((2 + w[0], "D" + w[1], (("D", ""), *w[2])))
            for to in "" if gone else "ua":
                if (state, to) in step and (w := best(i + 1, step[state, to], 0)):
                    ways.append((1 + 5 * cut + w[0], "R" + w[1], (("R", to), *w[2])))
            if not gone and (state, initial) in step and (w := best(i + 1, step[state, initial], 0)):
                ways.append((5 * cut + w[0], "K" + w[1], (("K", initial), *w[2])))
        return min(ways) if ways else None

    return best(0, 0, 0)


def all_edits(rows):
    """The same over every edit there is, held to the grammar as a regular expression."""
    some = ["", "u", "a", "ua", "au"]
    found = []
    for between in itertools.product(some, repeat=len(rows) + 1):
        for edits in itertools.product(*[["D"] if gone else ["D", "K", "Ru", "Ra"] for _, gone, _ in rows]):
            text, audit, cost = between[0], "I" * len(between[0]), 5 * len(between[0])
            for (initial, _, cut), e, then in zip(rows, edits, between[1:], strict=True):
                text += {"D": "", "K": initial}.get(e, e[-1]) + then
                audit += e[0] + "I" * len(then)
                cost += {"D": 2, "K": 0}.get(e, 1) + 5 * (cut and e != "D") + 5 * len(then)
            if re.fullmatch(r"(s?(ua)+)?", text):
                found.append((cost, audit))
    return min(found)


def symbol(row):
    initial, gone, cut = row
    return "x" if gone else initial.upper() if cut else initial


def test_automaton_against_all_edits():
    rng = random.Random(1)
    kinds = [(r, g, c) for r in "suao" for g, c in ((0, 0), (0, 1), (1, 0))]
    automaton = conversations.SuffixAutomaton()
    for _ in range(60):
        rows = [rng.choice(kinds) for _ in range(rng.randrange(4))]
        assert automaton.best("".join(map(symbol, rows))) == all_edits(rows) == cheapest(tuple(rows))[:2]


def test_each_suffix_is_made_once():
    rng = random.Random(2)
    own = sorted({"".join(rng.choices("suaxUA", k=rng.randrange(12))) for _ in range(500)}, key=lambda s: s[::-1])
    automaton = conversations.SuffixAutomaton()
    for s in own:
        automaton.best(s)
    assert automaton.made == len({s[i:] for s in own for i in range(len(s))})


def repaired_by_hand(rows, damage=True):
    """rows: (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 19
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in mine:
            fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role[:1] if role[:1] in ("s", "u", "a") else "o", fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit, edits = cheapest(tuple(judged))
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        result, at, name = [], 0, {"u": "user", "a": "assistant"}
        for edit, to in edits:
            if edit == "I":
                result.append(f"{name[to]}:")
                continue
            if edit != "D":
                result.append(f"{mine[at][1] if edit == 'K' else name[to]}:{mine[at][2]}")
            at += 1
        digest = hashlib.sha256("\n".join(result).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest), result
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
CONVERSATION = "conv_id long, turn long, role string, text string, pos string, copy int, signature string"


def test_repair_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = repaired_by_hand(rows)
    got = queries.op11_conversation_repair(spark, SF).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == {c: x for c, (x, _) in expected.items()} and len(got) == len(expected)


def test_repair_of_odd_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " \t", "Yes.", "Yes. ", "no", "a! b", "Yes.", "é?", "x" * 300_000 + ".", "." * 5 + " \x85"]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), rng.choice([None, *range(6)]), rng.choice([None, "", "user", "user", "assistant", "assistant", "system", "tool", "User", "ü"]), rng.choice(texts)) for _ in range(120)]
    rows += [(100 + i, 0, "user", "Gone?") for i in range(60)] + [(8, 1, "user", "Same.")] * 4 + [(9, -5, "system", "Hi."), (9, 10**12, "user", "Far.")]
    df = spark.createDataFrame([(*r, "clash", 1, None) for r in rows], CONVERSATION)
    expected = repaired_by_hand(rows)
    got = conversations.repaired_after_damage(df).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == {c: x for c, (x, _) in expected.items()} and len(got) == len(expected)
    assert any(x[0][6] == "" for x in expected.values())  # conversations that the damage takes whole
    plain = repaired_by_hand(rows, damage=False)
    turns = {}
    for r in conversations.repaired_turns(df).orderBy("turn").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert turns == {c: x for c, (_, x) in plain.items() if x}
    for f in (conversations.repaired_after_damage, conversations.repaired_turns):
        assert f(df.limit(0)).collect() == []


def test_repair_of_a_long_conversation(spark):
    n = 30_000
    df = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('Turn ', id, '.') as text")
    (row,) = conversations.repaired(df).collect()
    assert (row.cost, row.audit) == (0, "K" * n)
    assert row.repaired_sha256 == hashlib.sha256("\n".join(f"{'assistant' if i % 2 else 'user'}:Turn {i}." for i in range(n)).encode()).hexdigest()


def plain_rounds(ids, vectors, k=8, rounds=10, seed=3):
    """The same by plain rounds over all vectors."""
    key = lambda i: (hashlib.sha256(f"{seed}:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), vectors[i])
    centroids = [vectors[i] for i in sorted(range(len(ids)), key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for v in vectors]
        for c in range(len(centroids)):
            if mine := [v for v, o in zip(vectors, own, strict=True) if o == c]:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = [nearest(v) for v in vectors]
    apart = [far(v, centroids[o]) for v, o in zip(vectors, own, strict=True)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, o, d, sum(x for x, p in zip(apart, own, strict=True) if p == o), sum(apart), digest[o]) for i, o, d in zip(ids, own, apart, strict=True)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in clusters.with_digests(df).collect()), key=str)


def test_clusters_of_the_given_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = [[int(np.floor(1024 * float(x))) for x in r.embedding] for r in rows]
    assert sorted(map(tuple, queries.op12_centroids(spark, SF).collect()), key=str) == plain_rounds([r.vec_id for r in rows], vectors)


def test_clusters_of_odd_vectors(spark):
    rng = random.Random(4)
    good = [[float(rng.randrange(3)) for _ in range(4)] for _ in range(60)] + [[0.0] * 4] * 20 + [[1e5, -1e5, 3.7, -0.0001]] * 3
    bad = [None, [], [1.0] * 3, [1.0] * 5, [1.0, None, 1.0, 1.0], [1.0, float("nan"), 1.0, 1.0], [1.0, float("inf"), 1.0, 1.0], [1.0, 1e30, 1.0, 1.0]]
    rows = [(rng.choice([None, i, 7]), v, None, "x") for i, v in enumerate(good)] + [(1000 + i, v, 1, "x") for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, v string").repartition(3)
    expected = plain_rounds([r[0] for r in rows[: len(good)]], [[int(np.floor(1024 * x)) for x in v] for v in good])
    assert rows_of(clusters.clustered(df, dim=4)) == expected
    few = spark.createDataFrame(rows[:3], df.schema)
    assert rows_of(clusters.clustered(few, dim=4)) == plain_rounds([r[0] for r in rows[:3]], [[int(1024 * x) for x in v] for v in good[:3]])
    one = spark.createDataFrame(rows[:1] * 5, df.schema)
    assert [r.distance for r in clusters.clustered(one, dim=4).collect()] == [0] * 5
    assert clusters.clustered(df.where("vec_id >= 1000"), dim=4).collect() == [] == clusters.clustered(df.limit(0), dim=4).collect()


def test_rounds_scan_only_vectors_whose_gap_expired():
    rng = np.random.default_rng(5)
    centres = rng.integers(-1000, 1000, (6, 16))
    vectors = (centres[rng.integers(0, 6, 900)] + rng.integers(-60, 60, (900, 16))).astype(np.int16)
    centroids = (centres + rng.integers(-30, 30, centres.shape)).astype(np.int64)
    block, drift = clusters.Block(vectors, 6), np.zeros(6)
    block.assign(np.arange(900), None, centroids, drift)
    totals, scanned = block.moved.copy(), []
    for _ in range(5):
        new = totals[:, 1:] // totals[:, :1]
        step = np.sqrt(((new - centroids) ** 2).sum(axis=1))
        drift = drift + step + np.array([np.delete(step, c).max() for c in range(6)])
        centroids = new
        block.round(centroids, drift)
        totals += block.moved
        scanned.append(block.scanned)
        own = np.empty(900, int)
        for c, (keys, places) in enumerate(block.heaps):
            own[places] = c
            at = np.arange(1, len(keys))
            assert (keys[(at - 1) // 2] <= keys[at]).all()  # heap order
        assert (own == clusters.squared(vectors, centroids).argmin(axis=1)).all()
        assert (totals[:, 0] == np.bincount(own, minlength=6)).all()
    assert sum(scanned) < 900


def without_repeats_by_hand(rows, width=13):
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    first = {}
    for (doc, _), own in zip(rows, words, strict=True):
        for i in range(len(own) - width + 1):
            if doc is not None:
                w = tuple(own[i : i + width])
                first[w] = min(first.get(w, doc), doc)
    out = []
    for (doc, _), own in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(own) - width + 1) if doc is not None and first[tuple(own[i : i + width])] < doc for k in range(width)}
        out.append((doc, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk_bytes", "bucket_bytes"), [(1 << 22, 1 << 24), (300, 40), (2000, 1000)])
def test_repeats_against_all_windows(spark, chunk_bytes, bucket_bytes):
    rng = random.Random(chunk_bytes)
    passages = [[rng.choice("abcdef") * rng.randrange(1, 3) for _ in range(rng.randrange(5, 40))] for _ in range(12)]
    rows = []
    for i in range(150):
        own = [w for _ in range(rng.randrange(6)) for w in (*rng.choice(passages)[rng.randrange(4) :], *(str(rng.randrange(9)) for _ in range(rng.randrange(3))))]
        rows.append((rng.choice([i, i, i, rng.randrange(20), None]), rng.choice([" ", "\n", " \t "]).join(own)))
    rows += [(900, None), (901, ""), (902, " \x0b "), (903, rows[5][1]), (903, rows[5][1]), (-4, rows[9][1]), (905, "é " * 30), (906, "é\x85é " * 40), (907, "w" * 100_000)]
    rows += [(910, " ".join(map(str, range(20_000)))), (911, " ".join(map(str, range(100, 19_000))))]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, chunk string, docs int").repartition(3)
    got = repeats.without_repeats(df, chunk_bytes=chunk_bytes, bucket_bytes=bucket_bytes).collect()
    expected = without_repeats_by_hand(rows)
    assert sorted(map(tuple, got), key=str) == expected
    digests = repeats.without_repeats(df, digest=True, chunk_bytes=chunk_bytes).collect()
    assert sorted((*r[:3], r.kept) for r in digests if r.doc_id) == sorted((*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in expected if r[0])
    assert repeats.without_repeats(df.limit(0)).collect() == []


def test_pieces_and_windows():
    raw = b"ab  cd\te\x0bfgh ijklmnop \n"
    for size in range(1, 30):
        assert [w for p in repeats.pieces(raw, size) for w in p.split()] == raw.split()
    assert repeats.any_ahead(np.array([0, 0, 0, 1, 0], bool), 3).tolist() == [False, True, True, True, False]
    assert repeats.inside(np.array([2, 0, 3]), 2).tolist() == [True, False, True, True]


def test_what_moves_comes_back():
    rng = np.random.default_rng(6)
    for ids in ([], [5], [-(1 << 62), 1 << 62], list(range(100, 90, -1)), [7, 7 + (1 << 32)]):
        own = np.array(ids, np.int64)
        base, raw = repeats.offsets(own)
        assert repeats.from_offsets(base, raw, len(own)).tolist() == ids
    for top in (50, 1 << 20, 1 << 32):
        own = np.unique(rng.integers(0, top, 40)).astype(np.uint32)
        assert repeats.from_steps(repeats.steps(own), len(own)).tolist() == own.tolist()
    for top in (1000, 1 << 61):
        w = np.empty(50, repeats.WINDOW)
        w["a"], w["b"], w["first"], w["asks"] = (rng.integers(0, n, 50) for n in (1 << 62, 1 << 31, top, 1))
        w["first"][:10], w["asks"][:30] = repeats.NEVER, True
        assert repeats.unpacked(*repeats.packed(w), 30).tolist() == w.tolist()
        assert (repeats.unpacked(*repeats.packed(w[:10]), 10)["first"] == repeats.NEVER).all()
    texts = [b"", b"a b", b"\xc3\xa9"]
    assert repeats.unfolded(*repeats.folded(texts).values()) == texts
