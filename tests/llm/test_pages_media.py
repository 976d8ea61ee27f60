"""Web pages, JPEG and the pipeline."""

import hashlib
import html
import re
import time
import zlib

import numpy as np
import pytest

import corpus_pipeline
from flowgrid.llm import htmltext, jpeg, media, packing, pii, quality
from test_neardup import kept_by_all_pairs

SF = "/root/testdata/sf0.01"


def test_articles_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in htmltext.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.DOTALL).group(1)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", inner)]
        assert got[r.page_id].text == "\n\n".join(w for w in want if w)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_template_is_removed_and_copies_stay(spark):
    """A block that stands on all pages of a host goes; copies of one article, with all their paragraphs, stay."""
    page = lambda body: f"<html><body><div><p>{body}</p><p>Second of {body}</p><div><p>Call us on weekdays</p></div></div></body></html>"
    rows = [(i, "http://a.example/x", page(f"Article number {i} with its own long first paragraph {i * 7}")) for i in range(12)] + [(100 + i, "http://b.example/x", page("One article that was copied many times over, word by word")) for i in range(12)]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("weekdays" not in got[i] and "Second of Article" in got[i] for i in range(12))
    assert all("Second of One article" in got[100 + i] and "weekdays" in got[100 + i] for i in range(12))


def test_templates_of_given_pages(spark):
    """Counts by host agree with plain loops over the pages; on most hosts there are templates, and deleting them changes pages."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = pages.collect()
    site = lambda url: re.match(r"[a-z]+://([^/?#:]*)", url or "").group(1).lower()
    on, zone, mains = {}, {}, {}
    for r in rows:
        main, trees = htmltext.subtrees(r.html)
        mains.setdefault(site(r.url), set()).add(main)
        for h, z in trees:
            on.setdefault((site(r.url), h), set()).add(main)
            zone[site(r.url), h] = max(z, zone.get((site(r.url), h), 0))
    want = {(a, h): len(m) for (a, h), m in on.items()} | {(a, None): len(m) for a, m in mains.items()}
    assert {(r.host, r.hash): r.n for r in htmltext.counts(pages).collect()} == want
    rule = (htmltext.OUTSIDE, htmltext.UNMARKED, htmltext.INSIDE)
    often = {}
    for (a, h), m in on.items():
        least, share = rule[zone[a, h]]
        if len(m) >= least and len(m) >= share * len(mains[a]):
            often.setdefault(a, set()).add(h)
    assert {r.host: set(r.template) for r in htmltext.templates(pages).collect()} == often
    assert len(often) > 0.5 * len(mains)
    deleted = [htmltext.extracted(r.html, frozenset(often.get(site(r.url), ())))[1] for r in rows]
    assert sum(n > 0 for n in deleted) > 0.4 * len(rows)
    assert sorted((r.page_id, r.n_templates) for r in htmltext.main_text(pages).collect()) == sorted((r.page_id, n) for r, n in zip(rows, deleted, strict=True))


def test_templates_go_where_no_name_helps(spark):
    """The given pages with all element and class names taken away: what recurs on a host goes by its hash alone, articles stay."""
    bare = lambda s: re.sub(r"<(/?)(nav|footer|article|ul|li)\b[^>]*>", r"<\1div>", re.sub(r' class="[^"]*"', "", s))
    menu, foot = "<nav><ul><li><a href='/a'>Home page</a></li><li>About us</li></ul></nav>", '<div class="ad">Buy this now</div><footer>All rights kept</footer>'
    rows = []
    for r in spark.read.parquet(f"{SF}/pages.parquet").limit(60).collect():
        article = re.search(r"<article>.*</article>", r.html, re.DOTALL).group(0)
        rows.append((r.page_id, "http://one.example/x", bare(f"<body>{menu}{article}{foot}</body>")))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in htmltext.main_text(df).collect():
        page = rows[[x[0] for x in rows].index(r.page_id)][2]
        whole = htmltext.extracted(page, frozenset())[0]
        assert r.n_templates >= 2 and "Home page" in whole and "rights" in whole
        assert whole == f"Home page\n\nAbout us\n\n{r.text}\n\nBuy this now\n\nAll rights kept"


@pytest.mark.parametrize("part,n", [("<div>a", 60_000), ("<p><b>", 60_000), ("<a ", 200_000), ("</div>", 100_000), ("<ul><li>a", 40_000), ("<table><tr><td>", 30_000), ("<!-- ", 100_000)])
def test_deep_and_open_pages_take_linear_time(part, n):
    began = time.time()
    htmltext.subtrees(part * n)
    htmltext.extracted(part * n, frozenset([1]))
    assert time.time() - began < 15


CASES = {
    "<p>a&amp;b&nbsp;&#233; <b>c</b><br>d<p>e": "a&b é c d\n\ne",
    "<nav>menu</nav><article><header><h1>T</h1><p>by x</p></header><p>text</p><footer>f</footer></article><footer>g</footer>": "T\n\ntext",
    '<div class="cookie-notice">ok?</div><div id="main"><p>text</p><form>q</form><div class="comments"><p>hi</p></div></div>': "text",
    "<script>var a='<p>no</p>'</script><style>p{}</style><p>yes<!-- no --></p><noscript>n</noscript>": "yes",
    "<ul><li>x<li>y</ul><table><tr><td>1<td>2</table>": "x\n\ny\n\n1\n\n2",
    '<div class="layout has-sidebar"><article><div class="post-header"><h1>T</h1><span>by x</span></div><p>t</p></article></div>': "T\n\nt",
    '<div id="menu-page"><p>a page whose wrapper has a bad name</p><div class="menu">m</div></div>': "a page whose wrapper has a bad name",
    '<div class="sidebar"><article class="post"><p>only article</p></article></div><p>x</p>': "only article",
    '<article><p>one</p></article><section class="comments"><article><p>reply</p></article></section>': "one",
    '<article><h2 id="social-impact">S</h2><section id="related-work"><p>r</p></section><div id="search-methods">m</div><p class="share-buttons">x</p></article>': "S\n\nr\n\nm",
    '<div class="site-footer">f</div><div class="footer">g</div><p>text</p><div class="widget ad-slot-1">a</div>': "text", "a <!-- never ended": "a", "<p>a</p> 1 < 2 <b": "a\n\n1 < 2 <b",
    "": "", "<": "<", "no tags at all": "no tags at all", "<p>open <i>never closed": "open never closed", "</p></div>": "",
}


@pytest.mark.parametrize("page", CASES)
def test_page_cases(page):
    assert htmltext.extracted(page, frozenset()) == (CASES[page], 0)


def test_odd_pages(spark):
    rows = [(1, None, None, 1), (None, "x", "<p>a", None), (2, "http://h/", "<p>" * 3000 + "deep", None), (2, "http://h/", "<div>" * 3000 + "deep", None), (3, "http://h/", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = htmltext.main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars", "n_templates"]
    assert sorted((r.page_id or 0, r.text) for r in got.collect()) == [(0, "a"), (1, ""), (2, "deep"), (2, "deep"), (3, "")]
    assert htmltext.main_text(df.limit(0)).collect() == []


PAYLOADS = [bytes(64), b"hello world hij " * 40, bytes([104]) * 448, (bytes([104]) * 63 + b"\x00") * 20, np.random.default_rng(0).integers(0, 256, 6400, dtype=np.uint8).tobytes(), np.random.default_rng(1).integers(102, 108, 3200, dtype=np.uint8).tobytes()]


def test_jpeg_round_trip():
    files = jpeg.stored(PAYLOADS)
    images, coef = jpeg.decoded(files)
    assert [jpeg.payload_of(i, coef) for i in images] == PAYLOADS
    assert [jpeg.stored([p])[0] for p in PAYLOADS] == files  # a batch changes nothing
    blocks = jpeg.samples(images, coef)
    alone = [jpeg.rgb(x[0], jpeg.samples(x, c)) for x, c in (jpeg.decoded([f]) for f in files)]
    for image, one in zip(images, alone, strict=True):
        full = jpeg.rgb(image, blocks)
        assert full.shape == (image.layout.height, image.layout.width, 3) and (full == one).all()


def test_jpeg_inverse_transform_by_the_formula():
    coef = np.random.default_rng(2).integers(-60, 60, 64)
    order, c = jpeg.zigzag(), lambda k: np.sqrt(0.5) if k == 0 else 1.0
    grid = np.zeros(64)
    grid[order] = coef
    want = [[0.25 * sum(c(u) * c(v) * grid[v * 8 + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    assert np.allclose((coef.astype(float) @ jpeg.inverse_dct()).reshape(8, 8), want)


def test_media_columns(spark):
    df = spark.createDataFrame([(1, "a" * 100), (2, None), (3, "a" * 100), (4, "é" * 3000)], "doc_id long, text string")
    files = media.to_media(df)
    tensors = {r.doc_id: r for r in media.rgb_tensors(files).collect()}
    assert all(len(r.rgb) == r.width * r.height * 3 for r in tensors.values()) and tensors[1].rgb == tensors[3].rgb
    got = {r.doc_id: r for r in media.stored_features(df).collect()}
    for r in df.collect():
        p = media.payload(r.text or "")
        assert (got[r.doc_id].payload_bytes, got[r.doc_id].payload_sha256, got[r.doc_id].tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    bad = spark.createDataFrame([(1, None), (2, bytearray(b""))], "doc_id long, media binary")
    assert [r.rgb for r in media.rgb_tensors(bad).collect()] == [None, None]


def test_broken_files_give_nulls_and_cost_no_other(spark):
    good = jpeg.stored(PAYLOADS)
    rng = np.random.default_rng(3)
    files = [*good, b"no jpeg", b"\xff\xd8", b"\xff\xd8\xff\xd9", good[1][:200], good[1][:40], good[1].replace(b"\xff\xc2", b"\xff\xc0", 1)]
    for _ in range(60):
        x = bytearray(good[int(rng.integers(len(good)))])
        for at in rng.integers(2, len(x), 5):
            x[int(at)] = int(rng.integers(256))
        files.append(bytes(x))
    rows = [(i, bytearray(x)) for i, x in enumerate(files)]
    got = {r.doc_id: r for r in media.rgb_tensors(spark.createDataFrame(rows, "doc_id long, media binary").coalesce(1)).collect()}
    assert len(got) == len(files)
    for i, x in enumerate(good):
        images, coef = jpeg.decoded([x])
        assert got[i].rgb == jpeg.rgb(images[0], jpeg.samples(images, coef)).tobytes()
    assert all(got[len(good) + k].rgb is None for k in (0, 1, 2, 5))
    assert media.rgb_tensors(spark.createDataFrame(rows, "doc_id long, media binary").limit(0)).collect() == []


def test_pipeline_against_its_parts(spark):
    """The rows that run() packs are those that the stages' rules leave, by plain loops over the collected documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    good = {r.doc_id for r in quality.sampled(docs, labels).select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    kept = kept_by_all_pairs(texts)
    assert {r.doc_id for r in rows} == set(kept)
    model, enc = pii.trained(), packing.id_bytes(packing.resolved("word_bpe_49k.json"))
    for r in rows:
        whole = enc.encode([pii.redact(texts[r.doc_id], pii.all_spans(texts[r.doc_id], model)[1])])[0] + (1).to_bytes(4, "little")
        assert zlib.crc32(whole[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    assert len(corpus_pipeline.STAGES) == 4


def test_pipeline_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "mail a@b.cd", None, None, 11), (3, "mail a@b.cd", None, None, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            out.collect()
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_formulas_inside_an_article_stay(spark):
    page = "<html><body><nav>Menu</nav><article><p>Mass is <math><mi>m</mi><mo>=</mo><mi>E</mi></math> here.</p></article></body></html>"
    (row,) = htmltext.main_text(spark.createDataFrame([(1, "http://a.example/", page)], "page_id long, url string, html string")).collect()
    assert row.text == "Mass is m=E here."


def test_jpeg_tables_stay_small():
    """Lookups stay in cache, equal table segments are parsed once, and files hold what they did."""
    dc, ac = jpeg.own_tables()
    assert dc.lookup().nbytes == ac.lookup().nbytes == 2 << 16
    payloads = [bytes(range(256)) * k + bytes(64) for k in (1, 7, 40)]
    files = jpeg.stored(payloads)
    images, coef = jpeg.decoded(files)
    assert [jpeg.payload_of(x, coef) for x in images] == payloads and len({id(x.scans[0].dc[0]) for x in images}) == 1
    v, size = np.array([0, 0, 1, 0, 3, 4, 5]), np.array([0, 1, 1, 3, 3, 3, 11])
    assert jpeg.extended(v, size).tolist() == [0, -1, 1, -7, -4, 4, -2042]
