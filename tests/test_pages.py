"""Pages as nodes and as Markdown, against trees that are walked."""

from __future__ import annotations

import html as entities
import random
import re

import pytest
from pyspark.sql import functions as F

from ragloom.functions import html
from ragloom.operators import page_markdown, page_tree

TEXTS = ["plain", "a.b 1.5 end.", "x_y*z [k](v) #1 + 2-3!", "R&D <tag> \"q\"", "  two  blanks ", "0", "line\nbreak |", "\\ `tick` {b}", "èàü 😀."]
INLINE = ["a", "b", "em", "span", "code", "br", "i", "strong", "u"]
BLOCK = ["p", "div", "h1", "h3", "ul", "ol", "blockquote", "pre", "table", "section", "main"]
CLASSES = ["", "", "", "hidden-xs", "visible-xs", "col visible-xs hidden-xs", "nav-bar", "content", "main-content", "card"]


def element(rnd, tag, depth):
    """(tag, attributes, children): a tree as a page could hold it."""
    attrs = {"class": c} if (c := rnd.choice(CLASSES)) else {}
    if tag == "a":
        attrs |= {"href": rnd.choice(["/x", "y/z", "https://h.example/p", "http://site.example/q", "javascript:go()", "", "mailto:a@b.example", "//c.example/d"])} | ({"title": "a [t]"} if rnd.random() < 0.3 else {})
    if tag == "br":
        return tag, {}, []
    kids: list = []
    for _ in range(rnd.randrange(0, 4)):
        if tag in ("ul", "ol"):
            kids.append(element(rnd, "li", depth + 1))
        elif tag == "table":
            kids.append(element(rnd, rnd.choice(["tbody", "tr"]) if not kids else kids[-1][0], depth + 1))
        elif tag == "tbody":
            kids.append(element(rnd, "tr", depth + 1))
        elif tag == "tr":
            kids.append(element(rnd, rnd.choice(["td", "th"]), depth + 1))
        elif (not kids or not isinstance(kids[-1], str)) and rnd.random() < 0.5:
            kids.append(rnd.choice(TEXTS))
        elif tag in ("div", "section", "main", "li", "td", "th", "blockquote", "body") and depth < 6:
            kids.append(element(rnd, rnd.choice(BLOCK + INLINE), depth + 1))
        elif depth < 8 and tag != "pre":
            kids.append(element(rnd, rnd.choice([t for t in INLINE if t != "a" or tag != "a"]), depth + 1))
    return tag, attrs, kids


def written(rnd, node, following=None, last=True):
    """A tree as HTML, without end tags that may be left out, with some comments and capitals."""
    if isinstance(node, str):
        return entities.escape(node, quote=False)
    tag, attrs, kids = node
    name = tag.upper() if rnd.random() < 0.2 else tag
    quote = rnd.choice("\"'")
    out = f"<{name}" + "".join(f" {k}={quote}{entities.escape(v)}{quote}" for k, v in attrs.items()) + ">"
    if tag == "br":
        return out
    for i, k in enumerate(kids):
        out += written(rnd, k, kids[i + 1] if i + 1 < len(kids) else None, i + 1 == len(kids))
    after = following[0] if isinstance(following, tuple) else None
    free = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "tbody": {"tbody"}, "p": {*BLOCK} - {"main", "section"}}.get(tag, set())
    ends = rnd.random() < 0.5 and (after in free if following is not None else last and tag in free)
    return out + ("" if ends else f"</{name}>")


def plain(node):
    return node if isinstance(node, str) else "".join(map(plain, node[2]))


def esc(text):
    for c in "\\`*_{}[]()#+-!|":
        text = text.replace(c, "\\" + c)
    return re.sub(r"\.(?!\d)", r"\\.", text)


def esc_link(text):
    for c in "\\[]":
        text = text.replace(c, "\\" + c)
    return text


def seen_from(href, base):
    if href.startswith("http://site.example"):
        return href.replace("http:", "https:")
    if href.startswith(("http", "mailto")):
        return href
    if href.startswith("//"):
        return "https:" + href
    return "https://site.example" + (href if href.startswith("/") else "/folder/" + href)


def rows_below(node):
    return [x for k in node[2] if not isinstance(k, str) and k[0] != "table" for x in ([k] if k[0] == "tr" else []) + rows_below(k)]


def cells_of(row, base):
    kids = [k for k in row[2] if k[0] in ("td", "th")]
    css = lambda k: k[1].get("class", "")
    if any("hidden-xs" in css(k) or "visible-xs" in css(k) for k in kids):
        kids = [k for k in kids if "hidden-xs" in css(k)] or [k for k in kids if "visible-xs" not in css(k)]
    texts = [re.sub(r"\s+", " ", walked(k, base).strip(" \t\n\r\0\x0b"), flags=re.A) for k in kids]
    return ["-" if t in ("", "0") else t for t in texts]


def walked(node, base):
    """The Markdown of a node's children, by recursion."""
    out = ""
    for kid in node[2]:
        if isinstance(kid, str):
            out += esc(kid)
            continue
        tag, attrs, _ = kid
        inner = walked(kid, base)
        if tag == "a":
            text, href, title = plain(kid).strip(" \t\n\r\0\x0b"), attrs["href"], attrs.get("title")
            if not href:
                out += esc_link(text)
            elif href.startswith("javascript:"):
                out += "" if text in ("", "0") else f"**{text}**" if text.isdigit() else esc_link(text)
            else:
                to = seen_from(href, base)
                out += f"[{to if text in ('', '0') else esc_link(text)}]({to}" + (f' "{esc_link(title)}")' if title else ")")
        elif tag in ("b", "strong"):
            out += f"**{inner}**"
        elif tag in ("em", "i"):
            out += f"*{inner}*"
        elif tag in ("h1", "h3"):
            out += f"\n\n{'#' * int(tag[1])} {inner}\n\n"
        elif tag == "p":
            out += f"\n\n{inner}\n\n"
        elif tag == "br":
            out += "  \n"
        elif tag == "li":
            out += "\n- " + inner
        elif tag in ("ul", "ol"):
            out += f"\n{inner}\n"
        elif tag == "blockquote":
            out += "\n\n" + "\n".join("> " + x for x in inner.strip(" \t\n\r\0\x0b").split("\n")) + "\n\n"
        elif tag == "code":
            out += f"`{plain(kid)}`"
        elif tag == "pre":
            out += f"\n\n```\n{plain(kid)}\n```\n\n"
        elif tag == "table":
            lines = []
            for row in rows_below(kid):
                if cells := cells_of(row, base):
                    lines.append("| " + " | ".join(cells) + " |")
                    if len(lines) == 1:
                        lines.append("| " + "--- | " * (len(cells) - 1) + "--- |")
            out += "\n\n" + "\n".join(lines) + "\n\n" if lines else ""
        else:
            others = [k for k in node[2] if not isinstance(k, str) and k is not kid and "hidden-xs" in k[1].get("class", "")]
            if not ("visible-xs" in attrs.get("class", "") and others):
                out += inner
    return out


BASE = "https://site.example/folder/page.html?q=1"


def trees(n, seed=0):
    rnd = random.Random(seed)
    for _ in range(n):
        tree = element(rnd, "body", 0)
        yield tree, "<!doctype html><html><head><title>A <b> title</title><script>if (a < b) '<p>'</script></head>" + written(rnd, tree) + rnd.choice(["", "</html>", "<!-- open"])


def test_markdown_as_by_recursion():
    for tree, page in trees(1500):
        assert html.to_markdown(page, BASE) == walked(tree, BASE), page


def test_markdown_of_broken_pages(spark):
    cases = {
        "<p>one<p>two": "\n\none\n\n\n\ntwo\n\n",
        "<b>x<br>y": "**x  \ny**",
        "a < b </p></div> c": "a < b  c",
        "<tr><td>Nome</td><td>Tel</td></tr><tr><td>Ada<td>0</tr>": "\n| Nome | Tel |\n| --- | --- |\n| Ada | - |",
        "<ul><li>a<ul><li>b</ul><li>c</ul>": "\n\n- a\n\n- b\n\n- c\n",
        "&lt;b&gt; &amp; &eacute;": "<b> & é",
        "<style>p{}</style>x<script>var t='</p>';</script>y": "xy",
        "<p><b>t<br><p>u": "\n\n**t  \n**\n\n\n\nu\n\n",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "html string")
    got = {r.html: r.m for r in df.select("html", page_markdown.to_markdown(F.col("html"), F.lit(None).cast("string")).alias("m")).collect()}
    assert got[None] is None and all(got[k] == v for k, v in cases.items() if v is not None)


def test_deep_and_long_pages_are_linear():
    import time

    began = time.time()
    for page in ("<div>" * 50_000 + "x", "<p>" * 50_000, "<" * 200_000, '<a "' * 50_000, "<b>" * 20_000 + "</i>" * 20_000, "<table><tr><td>" * 3_000):
        assert html.to_markdown(page) is not None and html.nodes(page) is not None
    assert time.time() - began < 60
    assert len(html.to_markdown("<table><tr><td>x" * 40)) < 20_000


# --- node tables ---


class Tree:
    """Nodes of one page as objects, for walks."""

    def __init__(self, page):
        self.rows = html.nodes(page)
        self.kids: dict = {}
        for r in self.rows:
            self.kids.setdefault(r[2], []).append(r)

    def below(self, row):
        return [x for k in self.kids.get(row[0], []) for x in [k, *self.below(k)]]


def is_bad(r):
    return r[4] in page_tree.REMOVED_TAGS or any(c in r[5] for c in page_tree.REMOVED_CLASSES)


def left(tree, rows):
    """The rows without removed elements and what they hold."""
    return [x for r in rows if not is_bad(r) for x in [r, *left(tree, tree.kids.get(r[0], []))]]


def selected(tree):
    alive = left(tree, tree.kids.get(0, []))
    for i, (kind, value) in enumerate(page_tree.SELECTORS):
        for r in alive:
            if r[4] != "#text" and (value in r[5] if kind == "class" else {"tag": r[4], "ident": r[6], "role": r[7]}[kind] == value):
                return i, r
    return None, None


def serialised(tree, page, row):
    """The element's HTML without removed elements, piece by piece."""
    start, stop = (row[10], row[11]) if row else (0, len(page))
    out, at = "", start
    for x in tree.below(row) if row else [y for r in tree.kids.get(0, []) for y in [r, *tree.below(r)]]:
        if is_bad(x) and x[10] >= at:
            out, at = out + page[at : x[10]], x[11]
    return out + page[at:stop]


PAGES = [
    "<html><body><header>h</header><main id=m><p>text<nav>n</nav> more</main></body></html>",
    "<div class='wrapper'><div class='ads'><main>hidden</main></div><p>seen</p></div>",
    "<p>no element of the list</p>", "just text", "<nav>only</nav>", "<body><div role=main>r<aside>x<p>y</aside>z</div><article>late</article>",
    "<body><div class='content header'>gone</div><div id='content'>by id</div>",
]


@pytest.fixture(scope="module")
def pages(spark):
    texts = PAGES + [p for _, p in trees(60, seed=5)]
    rows = [(i, p, BASE, "x", 1) for i, p in enumerate(texts)] + [(900, None, BASE, "x", 1), (901, "", None, "x", 1)]
    return spark.createDataFrame(rows, "page_id long, html string, url string, tag string, pre int").drop("tag", "pre"), dict(enumerate(texts))


def test_main_content_as_by_a_walk(pages):
    df, texts = pages
    got = {r.page_id: r for r in page_tree.cleaned(df).collect()}
    assert len(got) == len(texts) + 2 and got[900].content is None and got[901].content == ""
    for i, page in texts.items():
        tree = Tree(page)
        rank, row = selected(tree)
        assert (got[i].selector, got[i].pre) == (rank, row and row[0]), page
        assert got[i].content == serialised(tree, page, row), page


def test_scripted_pages_keep_card_headers(spark):
    page = "<body><div class='container'><header class='card-header'>stays</header><header>goes</header><div class='header'>stays too</div></div></body>"
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert "goes" not in (got := page_tree.cleaned(df, scripted=True).first().content) and got.count("stays") == 2


def test_density_as_by_a_walk(spark):
    rnd = random.Random(8)
    words = lambda n: ", ".join("word" * rnd.randrange(1, 9) for _ in range(n))
    texts = []
    for _ in range(40):
        block = lambda: f"<div>{''.join(f'<p>{words(rnd.randrange(1, 12))}<a href=x>{words(rnd.randrange(0, 3))}</a></p>' for _ in range(rnd.randrange(0, 4)))}</div>"
        texts.append(f"<body>{block()}<section>{block()}{block()}</section><nav>{block()}</nav><table><tr><td>{words(9)}<td>b</table></body>")
    texts += ["<p>short</p>", "text only, without any element but long enough"]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    got = {r.id: r for r in page_tree.densest(page_tree.node_table(df)).collect()}
    for i, page in enumerate(texts):
        tree, points = Tree(page), {}
        alive = left(tree, tree.kids.get(0, []))
        by = {r[0]: r for r in tree.rows}
        of = lambda r: [x for x in left(tree, tree.kids.get(r[0], [])) if x[4] == "#text"]
        size = lambda xs: sum(len(x[8].strip(" ")) for x in xs)
        for r in alive:
            if r[4] in ("p", "td", "pre") and size(of(r)) >= 25:
                p = 1 + sum(x[8].count(",") for x in of(r)) + min(size(of(r)) // 100, 3)
                for k, share in ((r[2], 1), (by[r[2]][2] if r[2] else 0, 0.5)):
                    if k:
                        points[k] = points.get(k, 0) + p * share
        total = {k: p * (1 - size([x for x in of(by[k]) if x[9]]) / max(1, size(of(by[k])))) for k, p in points.items()}
        if not total:
            assert i not in got
            continue
        best = min(total, key=lambda k: (-round(total[k], 9), k))
        assert got[i].pre == best and got[i].points == pytest.approx(total[best])


def test_whole_extraction(spark):
    page = f"<body><nav>menu words</nav><main><h1>Title</h1><p>{'A sentence with words. ' * 5}</p><p>short</p><p>Tel: 051 123456</p></main></body>"
    df = spark.createDataFrame([(1, page, BASE), (2, "<body>tiny</body>", BASE), (3, None, None)], "page_id long, html string, url string")
    got = {r.page_id: r.markdown for r in page_markdown.extracted(df).collect()}
    assert got[1].startswith("# Title") and "short" not in got[1] and "menu" not in got[1] and "051" in got[1] and got[2] is None and got[3] is None
    dense = {r.page_id: r for r in page_markdown.by_density(df).collect()}
    assert dense[1].passed and not dense[2].passed and not dense[3].passed and dense[3].markdown is None


def test_component_tags_are_hoisted(spark):
    page = '<app-switcher><div class="testolungo x">Body</div></app-switcher>'
    df = spark.createDataFrame([(page,), ("<p>0</p>",)], "html string")
    got = [r[0] for r in df.select(page_tree.hoisted(F.col("html"))).collect()]
    assert got == ['<div class="main-content">Body</div><div class="app-switcher"><div class="testolungo x">Body</div></div>', "<p>0</p>"]
