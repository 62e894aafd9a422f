"""Main text of web pages through site style trees.

A page is parsed once into blocks of text, each with the elements around it. The
pages of a host are merged: an element is known by its path of tags, classes and
ids. Its presentation importance is the entropy of its sequences of children
over the pages that have it; its content importance is one less the mean entropy
of its texts over those pages, so what every page repeats weighs nothing. A
branch low in both is removed from each page, beside those whose tag, class or
role says that they are no article.

Scale: pages are parsed where they are read. What is shuffled are hashes of
texts and elements with counts, added up map-side, so a host with a third of all
pages is no group in one task. Low branches go back to pages through a join.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_checkpoint, table

#: A branch is removed if both importances are below this, on enough pages.
LOW = 0.2
MIN_PAGES = 8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search"
    " section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a start tag closes, and those at which the search for them ends.
P_SCOPE = frozenset("html table td th caption button object template".split())
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split()) | P_SCOPE),
    "dd": (frozenset("dd dt".split()), frozenset(["dl"]) | P_SCOPE),
    "dt": (frozenset("dd dt".split()), frozenset(["dl"]) | P_SCOPE),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "tbody": (frozenset("tbody thead tfoot".split()), frozenset(["table"])),
}
CLOSES |= {t: CLOSES["tbody"] for t in ("thead", "tfoot")}
P = frozenset(["p"])
KEEPS_P = frozenset("option optgroup tr td th tbody thead tfoot caption html head body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p pre blockquote ul ol li dl dt dd table tbody thead tr td th figure figcaption".split())

#: Elements that hold no article text, wherever they are.
NOISE_TAGS = frozenset(
    "head nav footer aside button select option optgroup datalist label input fieldset legend dialog menu search"
    " template svg canvas object audio video map".split()
)
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split()
)
#: Words of classes and ids that mark menus, notices, adverts, comments and the like.
HEADER_WORDS = frozenset("header masthead".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies"
    " consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login share sharing"
    " social sidebar widget widgets related recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation"
    " footer skip comment comments disqus respond reply replies pagination pager toolbar copyright hidden".split()
)

ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+)*+)>"""
)
MARKS = re.compile("class|id|role|hidden|style", re.I)
SHORT_COMMENT = re.compile(r"<!---?>")
WORDS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|$)", re.I) for t in RAW}

STATS = "host string, digest long, blocks array<struct<path:string,text:long,c:long>>, nodes array<struct<path:string,shape:long>>"
#: Low branches of all hosts that a broadcast may hold; more are joined by page.
BROADCAST_PATHS = 50_000

def signed(h: int) -> int:
    return h - (h >> 63 << 64)


class Node:
    """An element: its tag and path, whether it is noise by itself or may be, and
    the tags of its children without repeats in a row."""

    __slots__ = ("tag", "path", "noise", "soft", "holds_main", "inside", "shape", "inline")

    def __init__(self, tag: str, path: str, inside: str | None, inline: bool = False):
        self.tag, self.path, self.inside, self.inline = tag, path, inside, inline
        self.noise = self.soft = self.holds_main = False
        self.shape: list[str] = []


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


@lru_cache(4096)
def described(name: str, raw: str) -> tuple[str, bool, bool, bool, bool]:
    """An element by its tag and attributes: (label, noise by tag or because it is
    not shown, noise by a class, id or role, a header, the main part)."""
    attrs = attributes(raw) if MARKS.search(raw) else {}
    hard = name in NOISE_TAGS or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
    hard |= "display:none" in attrs.get("style", "").replace(" ", "").lower()
    role = attrs.get("role", "").lower()
    words = {w.lower() for w in WORDS.findall(attrs.get("class", "") + " " + attrs.get("id", ""))}
    soft = name == "form" or role in NOISE_ROLES or not NOISE_WORDS.isdisjoint(words)
    header = name == "header" or not HEADER_WORDS.isdisjoint(words)
    label = name + "".join("." + c for c in sorted(attrs.get("class", "").split()))
    label += "#" + attrs["id"].strip() if attrs.get("id") else ""
    return label.replace(">", "_"), hard, soft, header, name == "main" or role == "main"


def parse(page: str) -> tuple[list[tuple[list[Node], str]], list[Node]]:
    """The blocks of a page, each as (elements around it, text), and all elements.

    Tags that are left open, crossed or cut off at the end are taken as browsers
    take them; comments, declarations and raw elements hold no text.
    """
    root = Node("", "", None)
    stack, nodes, blocks, parts = [root], [root], [], []

    def end_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                depth = len(stack)
                while stack[depth - 1].inline:
                    depth -= 1
                blocks.append((stack[:depth], text))
            parts.clear()

    def close(tags, scope) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                if not stack[k].inline:
                    end_block()
                del stack[k:]
                return
            if stack[k].tag in scope:
                return

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt != at and not stack[-1].inline:
            text = page[at : lt if lt >= 0 else size]
            parts.append(html.unescape(text) if "&" in text else text)
        if lt < 0:
            break
        tag = TAG.match(page, lt)
        if tag is None:
            after = page[lt + 1 : lt + 2]
            if after.isalpha() and after.isascii() or (after == "/" and page[lt + 2 : lt + 3].isalpha()):
                break  # a tag without an end
            if page.startswith("<!--", lt):
                short = SHORT_COMMENT.match(page, lt)
                end = page.find("-->", lt + 4)
                at = short.end() if short else end + 3 if end >= 0 else size
            elif after in ("!", "?", "/"):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
            else:
                if not stack[-1].inline:
                    parts.append("<")
                at = lt + 1
            continue
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            if name == "br":
                parts.append(" ")
            scope = () if name in BLOCK else BLOCK
            if name in HEADINGS:
                close(HEADINGS, ())
            else:
                close((name,), scope)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW:
            end = RAW_END[name].search(page, at)
            after = page.find(">", end.end()) if end else -1
            at = after + 1 if after >= 0 else size
            continue
        block = name in BLOCK
        raw = tag[3]
        if not block and name not in NOISE_TAGS and not (raw and MARKS.search(raw)):
            continue  # plain inline elements change nothing
        if block:
            end_block()
            if name not in KEEPS_P:
                close(P, P_SCOPE)
            if name in CLOSES:
                close(*CLOSES[name])
            if name in HEADINGS and stack[-1].tag in HEADINGS:
                del stack[-1]
        if name in ("html", "body") and any(n.tag == name for n in stack):
            continue
        if name == "body":
            close(("head",), ())
        label, hard, soft, header, main = described(name, raw)
        up = stack[-1]
        soft = (soft or (header and up.inside is None)) and name not in ("html", "body")
        if not block and not hard and not soft:
            continue
        inside = "article" if name == "article" else "main" if main and up.inside is None else up.inside
        if name in VOID:
            continue
        node = Node(name, f"{up.path}>{label}", inside, not block)
        node.noise, node.soft = hard, soft
        if inside in ("article", "main") and up.inside != inside:
            node.soft = node.soft and name == "article"  # an article may be a comment
            if not node.soft:
                for n in stack:
                    n.holds_main = True
                node.holds_main = True
        if not up.shape or up.shape[-1] != name:
            up.shape.append(name)
        stack.append(node)
        nodes.append(node)
    end_block()
    return blocks, nodes


def candidates(blocks: list[tuple[list[Node], str]]) -> list[bool]:
    """Which blocks are article text by their elements alone: in an article, or in
    the main part of a page without, or anywhere on a page without either, and
    with no noise around them. A class that would leave no article is not taken
    for noise where it holds the article, such as one of the whole page."""
    where = [around[-1].inside for around, _ in blocks]
    strict = [not any(n.noise or n.soft for n in around) for around, _ in blocks]
    loose = [not any(n.noise or (n.soft and not n.holds_main) for n in around) for around, _ in blocks]
    for clear in (strict, loose):
        for part in ("article", "main"):
            found = [c and w == part for c, w in zip(clear, where)]
            if any(found):
                return found
    return strict


def removable(node: Node) -> bool:
    """Whether importance may remove the branch: not what holds the article, nor
    plain prose elements inside it."""
    plain = node.tag in PROSE and node.path.endswith(">" + node.tag)
    return not (node.holds_main or node.tag in ("", "html", "body") or (node.inside and plain))


def page_stats(page: str) -> tuple[list[dict], list[dict]]:
    """A page for the tree of its host: (path, hash and count of each text), and
    each path with its children, those of repeated paths in page order."""
    blocks, nodes = parse(page)
    texts: dict[tuple, int] = {}
    for around, text in blocks:
        key = around[-1].path, signed(xxhash.xxh64_intdigest(text))
        texts[key] = texts.get(key, 0) + 1
    shapes: dict[str, list] = {}
    for n in nodes:
        if not n.inline:
            shapes.setdefault(n.path, []).append(" ".join(n.shape))
    return (
        [{"path": p, "text": t, "c": c} for (p, t), c in texts.items()],
        [{"path": p, "shape": signed(xxhash.xxh64_intdigest("|".join(x)))} for p, x in shapes.items()],
    )


def page_text(page: str, low: set[str]) -> str:
    """The article of a page without the branches whose paths are ``low``; if that
    would be nothing, with them."""
    blocks, _ = parse(page)
    kept = [b for b, own in zip(blocks, candidates(blocks)) if own]
    left = [b for b in kept if not any(n.path in low and removable(n) for n in b[0])] if low else kept
    return "\n\n".join(text for _, text in left or kept)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def keyed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``(page_id, url, host, digest, html)``; null pages are empty."""
    url, page = F.col(url_col), F.coalesce(html_col, F.lit(""))
    return pages.select(
        F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), F.xxhash64(page).alias("digest"), page.alias("html")
    )


def style_tree(keyed: DataFrame) -> DataFrame:
    """``(host, path, pages, presentation, content, importance)`` for every element
    of the merged pages of each host, all three from 0 to 1; ``importance`` is the
    greatest of both in the branch. Copies of a page count once; an element on a
    single page is important; ``content`` is null without text of its own."""
    fields = [[("path", pa.string()), ("text", pa.int64()), ("c", pa.int64())], [("path", pa.string()), ("shape", pa.int64())]]
    kinds = [pa.list_(pa.struct(f)) for f in fields]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [page_stats(t.as_py()) for t in part.column(2)]
                lists = [pa.array([f[k] for f in found], kinds[k]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["host", "digest", "blocks", "nodes"])

    merged = keyed.select("host", "digest", "html").mapInArrow(run, STATS).dropDuplicates(["host", "digest"])
    merged = shared_checkpoint(merged)
    shapes = merged.select("host", F.inline("nodes")).groupBy("host", "path", "shape").agg(F.count(F.lit(1)).alias("k"))
    shapes = shapes.groupBy("host", "path").agg(F.sum("k").alias("pages"), F.sum(F.col("k") * F.log("k")).alias("s"))
    texts = merged.select("host", F.inline("blocks")).groupBy("host", "path", "text")
    texts = texts.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    texts = texts.groupBy("host", "path").agg(F.avg(F.log("n") - F.col("s") / F.col("n")).alias("entropy"))

    several = F.col("pages") > 1
    shape_entropy = F.log("pages") - F.col("s") / F.col("pages")
    tree = shapes.join(texts, ["host", "path"], "left").select(
        "host", "path", "pages",
        F.round(F.when(several, shape_entropy / F.log("pages")).otherwise(1.0), 9).alias("presentation"),
        F.round(F.when(several, 1 - F.col("entropy") / F.log("pages")), 9).alias("content"),
    )
    tree = shared_checkpoint(tree)
    parts = F.split("path", ">")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws(">", F.slice(parts, 1, k)))
    branch = tree.select("host", F.explode(above).alias("path"), F.greatest("presentation", "content").alias("x"))
    branch = branch.groupBy("host", "path").agg(F.max("x").alias("importance"))
    return tree.join(branch, ["host", "path"])


def main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    low: float = LOW,
    min_pages: int = MIN_PAGES,
    broadcast_paths: int = BROADCAST_PATHS,
) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the article of every row of ``pages``.

    Character references are decoded, white space in a block is one space, blocks
    are joined by two line ends. If importance would leave nothing of a page, it
    removes nothing there. Null and empty pages have empty texts; pages without a
    host in their url are those of one host; repeated rows are kept; other columns
    are not looked at; an empty table gives an empty result.
    """
    keyed = keyed_pages(pages, id_col, url_col, html_col)
    weak = style_tree(keyed).where((F.col("pages") >= min_pages) & (F.col("importance") < low))
    weak = shared_checkpoint(weak.select("host", "path"))
    if weak.count() <= broadcast_paths:
        lists = weak.groupBy("host").agg(F.collect_list("path").alias("low"))
        rows = keyed.join(F.broadcast(lists), "host", "left")
    else:
        own = merged_paths(keyed).join(weak, ["host", "path"])
        rows = keyed.join(own.groupBy("host", "digest").agg(F.collect_list("path").alias("low")), ["host", "digest"], "left")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [page_text(t.as_py(), set(x.as_py() or ())) for t, x in zip(part.column(2), part.column(3))]
                columns = [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    rows = rows.select("page_id", "url", "html", "low")
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def merged_paths(keyed: DataFrame) -> DataFrame:
    """``(host, digest, path)``: the paths of every distinct page."""

    def run(batches):
        for b in batches:
            for host, digest, page in zip(*b.columns):
                paths = [r["path"] for r in page_stats(page.as_py())[1]]
                n = len(paths)
                columns = [pa.array([host.as_py()] * n), pa.array([digest.as_py()] * n), pa.array(paths, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["host", "digest", "path"])

    return keyed.select("host", "digest", "html").mapInArrow(run, "host string, digest long, path string").distinct()


def op13_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op13_site_style_tree": op13_site_style_tree}
ORACLES: dict[str, str] = {}
