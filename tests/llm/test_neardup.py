"""Near-duplicates by shingle similarity against all pairs."""

import random

import pytest

import corpus_pipeline
from flowgrid.llm import neardup

SF = "/root/testdata/sf0.001"


def kept_by_all_pairs(texts, t=0.8):
    sets = {}
    for d, text in texts.items():
        w = text.encode().lower().split()
        sets[d] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids, root = sorted(texts), {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= t * (len(sets[a]) + len(sets[b]) - both) > 0:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [d for d in ids if find(d) == d]


def edited(words, n, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.random()}"
    return out


@pytest.fixture(scope="module")
def made():
    """One crowd of near copies, unlike texts that share a long line, pairs on both sides of the limit, very short texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 3000)}"
    line, base = [word() for _ in range(30)], [word() for _ in range(200)]
    texts = [edited(base, rng.randint(0, 6), rng) for _ in range(90)]
    texts += [line + [word() for _ in range(60)] for _ in range(60)]
    for n in range(1, 12):
        own = [word() for _ in range(150)]
        texts += [own, edited(own, n, rng)]
    texts += [["a"], ["A"], ["a", "b"], [], [" "]]
    rng.shuffle(texts)
    return {i: " ".join(x) for i, x in enumerate(texts)}


def test_stage_links_what_all_pairs_link(spark, made, monkeypatch):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in made.items()], "doc_id long, text string, lang string, source string, n_chars long")
    for pairs, sample in ((4, 20_000), (2, 0)):
        monkeypatch.setattr(neardup, "PAIRS", pairs)
        monkeypatch.setattr(neardup, "SAMPLE", sample)
        got = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect())
        assert got == kept_by_all_pairs(made)


def test_odd_rows(spark):
    """Null and repeated doc_ids, null, empty and one-word texts, repeated rows, columns whose names clash."""
    rows = [(1, "a b c d e f g", 1), (1, "a b c d e f g", 1), (2, "A B c d e f g", 2), (None, "a b c d e f g", 3), (3, None, 4), (4, "", 5), (5, "x", None), (5, "y", None), (6, "y", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted({(r.doc_id or 0, r.component_id) for r in neardup.near_duplicates(df).collect()})
    assert got == [(0, None), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)] and neardup.near_duplicates(df).count() == len(rows)
    kept = neardup.representatives(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == [(0, "a b c d e f g"), (1, "a b c d e f g"), (5, "x"), (5, "y")]
    assert neardup.near_duplicates(df.limit(0)).collect() == []


def test_stage_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect())
    want = kept_by_all_pairs({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    assert got == want and 177 not in got and 145 not in got


def test_simhash_blocks_link_near_copies(spark):
    """Pairs within 2 bits meet on the SimHash blocks, and are linked without any shingle bucket."""
    rng = random.Random(3)
    texts, n = {}, 0
    for _ in range(40):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(400)]
        for own in (base, edited(base, 1, rng), edited(base, 40, rng)):
            texts[n], n = " ".join(own), n + 1
    own = {d: neardup.shingles(t) for d, t in texts.items()}
    bits = {d: neardup.bits_of(x) for d, x in own.items()}
    near = {(a, b) for a in own for b in own if a < b and ((bits[a] ^ bits[b]) % (1 << 64)).bit_count() <= neardup.BITS}
    near = {(min(a for a, y in near if y == b), b) for _, b in near}
    alike = {p for p in near if len(set(own[p[0]]) & set(own[p[1]])) >= 0.8 * len(set(own[p[0]]) | set(own[p[1]]))}
    sets = spark.createDataFrame([(d, len(own[d]), bits[d]) for d in own], "id long, n int, bits long")
    assert len(alike) > 10 and {(r.a, r.b) for r in neardup.near_pairs(sets, 0.5).collect()} == near
    keys = spark.createDataFrame([], "id long, n int, bits long, i int, key long")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "xxhash64(text) AS hash")
    assert {(r.root, r.node) for r in neardup.links(sets, keys, docs, 0.8, 5, 42).collect()} == alike
