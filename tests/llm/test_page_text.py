"""Page text against hand pages, a plain style tree, and the test pages' own layout."""

import html
import math
import re
from collections import Counter, defaultdict

import pytest

from edulens.llm import page_text

PAGES = "page_id long, url string, html string"
SF = "/root/testdata/sf0.001"
CASES = [
    (None, ""),
    ("", ""),
    ("just text & more", "just text & more"),
    ("<p>a<p>b<br>c</p>d", "a\n\nb c\n\nd"),
    ("<nav><p>menu</p></nav><article><h1> T </h1><p>x&amp;y &lt;z&#233;&hellip;&am</p></article><footer>f</footer>", "T\n\nx&y <zé…&am"),
    ("<article><p>one<div class='ad-box'>buy</div><aside>also</aside><p>two <span class=share>share</span>end</article>", "one\n\ntwo end"),
    ("<article>a</article><section id=comments><article class=comment>c</article></section>", "a"),
    ("<body class='has-sidebar'><div class='page with-sidebar'><article>in</article><div class=sidebar>out</div></div>", "in"),
    ("<body class='cookie-page'><div>text</div><div class=cookieNotice>ok?</div></body>", "text"),
    ("<main><p>m</p><form><p>mail</p><input></form></main><p>out</p>", "m"),
    ("<form action=x><article><p>wrapped</p></article></form>", "wrapped"),
    ("<div class=related><article>teaser</article></div><main><p>real</p></main>", "real"),
    ("<header><h1>site</h1></header><article><header><h1>title</h1></header><p>p</p></article>", "title\n\np"),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\n\nb\n\n1\n\n2\n\n3"),
    ("<p>x<script>var a='</p>';</script>y<style>p{}</style>z<!-- c --><!-->w<!doctype html></p>", "xyzw"),
    ("<p>1 < 2 and 3 > 2 <3</p><p>cut <a href='x", "1 < 2 and 3 > 2 <3\n\ncut"),
    ("<p title='a>b' data-x=\"c\"\">in</p><p hidden>no</p><p style='display: none'>no</p><div role=navigation>no</div>", "in"),
    ("<p><b>bold<p>next</b> tail</p>", "bold\n\nnext tail"),
    ("<P CLASS=x>A\u00a0 b\t\nc</P><DIV>d", "A b c\n\nd"),
    ("<p>a</p><noscript><p>js</p></noscript><template><p>t</p></template><textarea>q</textarea>", "a"),
    ("<article><ul><li>item</li></ul><pre> a\n  b </pre><figure><img src=x><figcaption>cap</figcaption></figure></article>", "item\n\na b\n\ncap"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_hand_pages(page, want):
    assert page_text.page_text(page or "", set()) == want


def site(host, n, first=0):
    """Pages without article elements, with branches of no telling name that repeat."""
    for i in range(first, first + n):
        body = f"<div class=x1><p>Welcome to the site</p><p>Call us</p></div><div class=body><h1>Title {i}</h1>"
        body += "".join(f"<p>Paragraph {i} {k}</p>" for k in range(i % 4 + 1)) + "<p>The shared closing passage.</p></div>"
        body += "<article-footer></article-footer><div class=x2>All rights reserved</div>"
        yield i, f"https://user@{host.upper() if i % 2 else host}:80/p/{i}?q=1", f"<html><body>{body}"


def plain(rows, low=page_text.LOW, min_pages=page_text.MIN_PAGES):
    """The style tree of each host with dictionaries."""
    pages = defaultdict(dict)
    host = lambda u: (m := re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", (u or "").lower())) and m[1] or ""
    for _, url, page in rows:
        pages[host(url)][page or ""] = page_text.page_stats(page or "")
    weak = defaultdict(set)
    for h, found in pages.items():
        shapes, texts = defaultdict(Counter), defaultdict(lambda: defaultdict(list))
        for blocks, nodes in found.values():
            for n in nodes:
                shapes[n["path"]][n["shape"]] += 1
            for b in blocks:
                texts[b["path"]][b["text"]].append(b["c"])
        value = {}
        for p, c in shapes.items():
            m = sum(c.values())
            value[p] = max(
                -sum(k / m * math.log(k / m, m) for k in c.values()) if m > 1 else 1,
                0 if m == 1 or not texts[p] else
                1 - sum(-sum(x / sum(cs) * math.log(x / sum(cs), m) for x in cs) for cs in texts[p].values()) / len(texts[p]),
            )
        for p, c in shapes.items():
            branch = max(v for q, v in value.items() if q == p or q.startswith(p + ">"))
            if sum(c.values()) >= min_pages and branch < low:
                weak[h].add(p)
    out = [(i, u, page_text.page_text(t or "", weak[host(u)])) for i, u, t in rows]
    return sorted(((i, u, t, len(t)) for i, u, t in out), key=str)


def ask(spark, rows, **kw):
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    return sorted(map(tuple, page_text.main_text(df, **kw).collect()), key=str)


@pytest.mark.parametrize("broadcast_paths", [page_text.BROADCAST_PATHS, 0])
def test_repeated_branches_go(spark, broadcast_paths):
    rows = [*site("a.example.org", 30), *site("b.example.org", 3, 100), (200, None, "<p>no host"), (201, "ftp:x", None)]
    rows += rows[:3] + [(300 + k, rows[5][1], rows[5][2]) for k in range(40)]  # many copies of one page
    got = ask(spark, rows, broadcast_paths=broadcast_paths)
    assert got == plain(rows)
    text = {r[0]: r[2] for r in got}
    assert text[6] == "Title 6\n\nParagraph 6 0\n\nParagraph 6 1\n\nParagraph 6 2\n\nThe shared closing passage."
    assert "Welcome" in text[100]  # three pages say too little


def test_article_text_stays_whatever_repeats(spark):
    rows = [(i, "http://c.example.org/", f"<nav>n {i}</nav><article><p>same passage</p><div class=box>same box</div><p>own {i}</p></article>") for i in range(20)]
    assert {r[2] for r in ask(spark, rows)} == {f"same passage\n\nown {i}" for i in range(20)}
    same = [(i, "http://d.example.org/", f"<div>{'x' * i}</div>") for i in range(1, 3)]
    copies = [(i, "http://e.example.org/", f"<!-- {i} --><div>one text</div>") for i in range(20)]
    assert {r[2] for r in ask(spark, same + copies)} == {"x", "xx", "one text"}


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame(list(site("a.example.org", 10)), PAGES).selectExpr("*", "1 AS host", "2 AS digest", "'z' AS path", "'q' AS text", "3 AS n_chars")
    got = page_text.main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(list(site("a.example.org", 10)))
    assert page_text.main_text(df.limit(0)).count() == 0


def test_very_long_page(spark):
    rows = [(1, "http://a/", "<div>" * 3000 + "<p>deep" + "<p>word &amp; word" * 100_000), (2, "http://a/", '<a title="' * 20_000), (3, "http://a/", "<" * 100_000)]
    got = {r[0]: r[2] for r in ask(spark, rows)}
    assert got[1] == "deep" + "\n\nword & word" * 100_000 and got[2] == "" and got[3] == "<" * 100_000


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted(map(tuple, page_text.op13_site_style_tree(spark, SF).collect()), key=str)
    assert got == plain(rows)
    for (_, _, text, _), page in zip(got, [r[2] for r in sorted(rows, key=lambda r: str((r[0], r[1])))]):
        body = re.split(r"</article>|<footer>", page.split("<article>", 1)[1])[0]
        body = re.sub(r"<[^>]*$", "", body)
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert text == "\n\n".join(p for p in parts if p)
