"""Main text of web pages by site template removal.

Each page is parsed to a tree of elements.  All its subtrees with text are hashed, and Spark counts on how many pages of a
host, with different main blocks, each hash occurs; subtrees that recur across many pages of their host are deleted, before
anything else is decided.  Of what is left, elements that say what they are (nav, footer, form, class="ad" ...) go as well,
as they may stand on few pages only.  What remains of the article is joined by blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, removed, sent_by_bytes, text_or_empty, written

#: (pages, share of the host's pages) on which a subtree must stand to be template: beside an article; on a page that
#: marks no article; inside an article, where passages and copies recur by themselves.  The shares bound a host's templates.
OUTSIDE, UNMARKED, INSIDE = (3, 0.005), (5, 0.3), (10, 0.6)

#: Hosts whose templates a task keeps at hand; it only saves work.
HOSTS = 256

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>|<[A-Za-z][^>]*>""", re.DOTALL)
NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
LAYOUT = re.compile(r"\b(?:has|no|with|without|show|hide|is)[-_]+[a-z]+")  # says something of the layout, not of the element
# Element names by what they do in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup html body".split())
DROPPED = frozenset("head script style title noscript template iframe object embed svg canvas audio video nav footer aside form button select option textarea input label dialog menu search noembed noframes xmp".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar note".split())
DROPPED_NAMES = frozenset(
    "nav navbar navigation menu topbar footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond"
    " discussion disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager widget skip toolbar search copyright".split()
)
#: Words that may stand beside one of these in the name of a boilerplate element, as in "site-footer" or "share-buttons"; a name
#: with any other word, such as "related-work", speaks of content.
PLACE_NAMES = frozenset(
    "site page main global primary secondary top bottom left right post entry article blog user mobile desktop sticky fixed inline side bar box block wrap wrapper container inner outer content section area region panel"
    " row col column group unit slot space list item items link links icon icons button buttons btn bar form field input text title heading header head body info module media posts articles stories news reading message toggle close".split()
)
HEADER_NAMES = frozenset("header masthead".split())
DROPPED_ARTICLES = frozenset("comment comments reply ad advert related promo sponsored".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody",), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "thead": ("table",), "option": ("select",), "p": ("td", "th", "table", "button", "object")}


#: Value of Node.dropped for a deleted template; 1 and 2 are for what says by a name, or by its element, that it is boilerplate.
TEMPLATE = 3


class Node:
    __slots__ = ("children", "dropped", "hash", "parent", "size", "tag")

    def __init__(self, tag: str, dropped: int, parent: Node | None = None) -> None:
        self.tag, self.dropped, self.parent, self.children, self.hash, self.size = tag, dropped, parent, [], 0, 0


def says_boilerplate(tag: str, attributes: str) -> tuple[int, bool]:
    """(2: dropped by element name or role, 1: by a class or id, 0: kept; whether it is a header by a class or id)."""
    if tag in DROPPED:
        return 2, False
    if "=" not in attributes or tag in ("html", "body", "main"):
        return 0, False
    header = False
    bad = DROPPED_ARTICLES if tag == "article" else DROPPED_NAMES
    for name, a, b, c in NAMED.findall(attributes):
        value = (a or b or c).lower()
        if name.lower() == "role":
            if set(value.split()) & DROPPED_ROLES:
                return 2, False
            continue
        for one in LAYOUT.sub(" ", value).split():
            words = set(WORDS.findall(one))
            if words & bad and words <= DROPPED_NAMES | PLACE_NAMES:
                return 1, False
            if words & HEADER_NAMES and words <= HEADER_NAMES | PLACE_NAMES and tag not in ("article", "h1", "h2", "h3", "h4", "h5", "h6"):
                header = True
    return 0, header


def parsed(html: str) -> Node:
    """The element tree; children are nodes and texts.  Open paragraphs, list items and cells end where HTML lets them.

    Open elements are found by name in lists of their places, so that deep nesting costs no more than its length.
    """
    root = Node("html", 0)
    stack, open_at, at, n, last = [root], {}, 0, len(html), html.rfind(">")

    def push(node: Node) -> None:
        open_at.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def end_from(i: int) -> None:
        for node in stack[i:]:
            open_at[node.tag].pop()
        del stack[i:]

    def innermost(names: tuple[str, ...]) -> int:
        return max([open_at[t][-1] for t in names if open_at.get(t)], default=0)

    def close(names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        if (i := innermost(names)) > innermost(scope):
            end_from(i)

    while at < n:
        m = MARKUP.search(html, at) if at <= last else None
        stop = m.start() if m else html.find("<!--", at) if "<!--" in html[at:] else n  # no tag ends after the last >
        if text := html[at:stop]:
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if open_at.get(tag):
                end_from(open_at[tag][-1])
            continue
        if tag == "html" or tag == "body" and open_at.get("body"):
            continue
        if tag in CLOSES_P:
            close(("p",), SCOPE["p"])
        if tag in SAME:
            close(SAME[tag], SCOPE[tag])
        dropped, header = says_boilerplate(tag, m[3])
        node = Node(tag, dropped, stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            push(node)
            if header:  # an element within a block of its own, so that the element's end tag still fits
                inner = Node("header", 0, node)
                node.children.append(inner)
                push(inner)
    return root


def hashed(root: Node) -> None:
    """Sets hash and size (characters of text) of a tree's elements, from names, texts (white space apart) and children, without recursion."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.children if isinstance(c, Node)]
    for x in reversed(order):
        parts = [x.tag]
        for c in x.children:
            if isinstance(c, Node):
                parts.append(f"<{c.hash}>")
                x.size += c.size
            elif t := " ".join(c.split()):
                parts.append(t)
                x.size += len(t)
        x.hash = xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def delete_templates(root: Node, template: frozenset[int]) -> int:
    """Marks the subtrees whose hash is a template as deleted; how many of them are not inside another."""
    n, todo = 0, [root]
    while todo:
        x = todo.pop()
        if x.size and x.hash in template:
            x.dropped, n = TEMPLATE, n + 1
        else:
            todo += [c for c in x.children if isinstance(c, Node)]
    return n


def text_of(node: Node) -> str:
    got, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            got.append(x)
        else:
            todo += reversed(x.children)
    return " ".join("".join(got).split())


def main_roots(root: Node) -> tuple[list[Node], bool]:
    """The article elements (or main) that are not inside anything dropped, else inside nothing dropped by its element name.

    Without any, the whole page: there an element dropped by class or id that holds most of the text is taken for layout.
    """
    for wanted, most in (("article", 0), ("main", 0), ("article", 1), ("main", 1)):
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if x.dropped > most or x.tag == wanted and x.dropped:
                continue
            if x.tag == wanted:
                found.append(x)
                continue
            todo += [c for c in reversed(x.children) if isinstance(c, Node)]
        if found:
            return found, True
    suspects, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.dropped == 1:
            suspects.append(x)
        elif not x.dropped:
            todo += [c for c in x.children if isinstance(c, Node)]
    if suspects:
        whole = len(text_of(root))
        for x in suspects:
            if len(text_of(x)) > whole / 2:
                x.dropped = 0
    return [root], False


def blocks(roots: list[Node], inside: bool) -> list[tuple[str, Node]]:
    """Texts of the blocks in page order, with the elements that hold their first words.  A header inside an article gives its headings only."""
    out: list[tuple[str, Node]] = []
    parts: list[str] = []
    first: list[Node] = []

    def end() -> None:
        if text := " ".join("".join(parts).split()):
            out.append((text, first[0]))
        parts.clear()
        first.clear()

    # Entries: (node or text or None for the end of a block, whether it is in a header, the element around it)
    todo: list[tuple[Node | str | None, bool, Node]] = [(r, False, r) for r in reversed(roots)]
    while todo:
        x, header, around = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            if not header:
                parts.append(x)
                if not first and not x.isspace():
                    first.append(around)
        elif x.tag in ("br", "wbr"):
            parts.append(" " if x.tag == "br" else "")
        elif not x.dropped:
            if x.tag == "header":
                if not inside:
                    continue
                header = True
            elif header and x.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"):
                header = False
            block = x.tag in BLOCK
            if block:
                end()
                todo.append((None, header, x))
            todo += [(c, header, x) for c in reversed(x.children)]
    end()
    return out


def subtrees(html: str) -> tuple[int, list[tuple[int, int]]]:
    """(hash of the main block, the longest one; hashes of the page's subtrees with text that do not hold it, with their zones).

    Zones: 0 beside an article, 1 on a page that marks no article, 2 inside an article.
    """
    root = parsed(html)
    hashed(root)
    roots, inside = main_roots(root)
    main, x = max(blocks(roots, inside), key=lambda b: len(b[0]), default=("", None))
    holders = set()
    while x is not None:
        holders.add(id(x))
        x = x.parent
    articles = {id(r) for r in roots}
    out: dict[int, int] = {}
    todo = [(root, 0 if inside else 1)]
    while todo:
        x, zone = todo.pop()
        if not x.size:
            continue
        if inside and id(x) in articles:
            zone = 2
        if id(x) not in holders:
            out[x.hash] = max(zone, out.get(x.hash, 0))
        todo += [(c, zone) for c in x.children if isinstance(c, Node) and c.tag in BLOCK]
    return xxhash.xxh64_intdigest(main.encode("utf-8", "surrogatepass")) - (1 << 63), list(out.items())


def host(url: str) -> Column:
    """Lower-case host of a URL column; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def counts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, hash, n (pages of the host with different main blocks on which the subtree stands), zone (see subtrees).

    hash is null for the count of all pages.  Pages with the same main block, such as copies of one article, count once,
    so that what recurs only with it is not taken for template.  Pages without a host belong to no site and are not
    counted.  Counting is by (host, hash) with partial aggregation; a large host is many keys.
    """
    rows = pages.select(host(url).alias("host"), text_or_empty(html).alias("html")).where("host <> ''")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            out = []
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                main, trees = subtrees(page)
                out.append((name, main, None, None))
                out += [(name, main, h, zone) for h, zone in trees]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["host", "main", "hash", "zone"])

    seen = sent_by_bytes(rows).mapInArrow(found, "host string, main long, hash long, zone int").groupBy("host", "hash", "main").agg(F.max("zone").alias("zone"))
    return seen.groupBy("host", "hash").agg(F.count("*").alias("n"), F.max("zone").alias("zone"))


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, template: the hashes of subtrees that recur across many pages of the host.

    As each template stands on a share of the pages, a host has a bounded multiple of the subtrees of a page.  Written to
    the shared folder, so that Spark knows its size.
    """
    found, path = written(counts(pages, url, html), "counts")
    per_host = found.where("hash is null").select("host", F.col("n").alias("pages"))
    needed = lambda k: F.when(F.col("zone") == 0, OUTSIDE[k]).when(F.col("zone") == 1, UNMARKED[k]).otherwise(INSIDE[k])
    often = found.where("hash is not null").where(F.col("n") >= needed(0)).join(per_host, "host").where(F.col("n") >= F.col("pages") * needed(1))
    out, _ = written(often.groupBy("host").agg(F.collect_set("hash").alias("template")), "templates")
    removed(pages.sparkSession, path)
    return out


def extracted(html: str, template: frozenset[int]) -> tuple[str, int]:
    """Main text of a page, and the number of template subtrees deleted from it."""
    root, n = parsed(html), 0
    if template:
        hashed(root)
        n = delete_templates(root, template)
    return "\n\n".join(t for t, _ in blocks(*main_roots(root))), n


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_templates (subtrees deleted as template) of each page; a null or empty page has the empty text.

    Repeated rows stay, an empty table gives none, further columns are ignored.  A page without article, main or template
    is kept whole, less what says by its name that it is boilerplate.  Time grows with the length of a page, also where
    elements are nested deeply or tags never end.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text_or_empty(html).alias("html"), host(url).alias("host"))
    # Of known size, so Spark broadcasts it where it is small, and else splits the pages of a large host.
    joined = rows.join(templates(pages, url, html), "host", "left").select("page_id", "url", "html", "host", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, frozenset[int]] = {}
        for batch in by_bytes(batches):
            out = []
            for page, name, own in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                if (name := name.as_py()) not in sets:
                    if len(sets) >= HOSTS:
                        sets.clear()
                    sets[name] = frozenset(own.as_py() or ())
                out.append(extracted(page.as_py(), sets[name]))
            text = [t for t, _ in out]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array([n for _, n in out], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_templates"])

    return sent_by_bytes(joined).mapInArrow(run, "page_id long, url string, text string, n_chars long, n_templates long")
