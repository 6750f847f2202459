"""Pages as node tables: pruning, main content, density extraction.

A page becomes rows, one for each element and text, numbered in order of their
start (``pre``), with the number of the last node inside (``end``). So an
ancestor is an interval, a running maximum tells what stands inside a removed
element, and a prefix sum what a subtree holds. All windows run by page. Whole
tables of pages skip the node table for the densest element: it is found page by page.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html, markup
from ..session import slices

# They must equal those of existing deployments.
REMOVED_TAGS = ("script", "style", "nav", "footer", "header", "aside")
REMOVED_CLASSES = ("nav", "navbar", "menu", "footer", "header", "ads", "advertisement", "cookie", "privacy")
SCRIPTED_TAGS = ("script", "style", "nav", "footer", "aside")
SCRIPTED_CLASSES = ("nav", "navbar", "menu", "footer", "ads", "advertisement", "cookie", "privacy")
#: (attribute, value): a class contains it, a role, id or tag equals it; the first with a match wins.
SELECTORS = (
    ("class", "testolungo"), ("class", "articolo-dettaglio-testo"), ("class", "article-container"), ("role", "main"), ("class", "main-content"), ("class", "container-fluid"),
    ("class", "page-content"), ("class", "site-content"), ("tag", "main"), ("tag", "article"), ("ident", "main"), ("ident", "content"), ("ident", "page-content"),
    ("class", "content"), ("class", "main"), ("class", "wrapper"), ("tag", "body"),
)
SCRIPTED_SELECTORS = (("role", "main"), ("class", "main-content"), ("class", "page-content"), ("class", "container"), ("tag", "main"), ("tag", "article"), ("tag", "body"))
COMPONENTS = ("switcher", "md-procedimento", "md-files", "converter-file", "md-contacts")
#: Least Markdown and least quality of an extraction.
LEAST_BYTES, LEAST_QUALITY = 50, 0.1
#: What counts as running text: elements, their least characters, and its marks.
PARAGRAPHS, LEAST_PARAGRAPH, COMMAS = ("p", "td", "pre"), 25, ",،、，"

NODES = f"id long, {html.NODE}"


def node_table(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pre, end, parent, depth, tag, class, ident, role, text, linked, start, stop) of every page.

    ``parent`` is 0 for nodes without one. Null and empty pages have no nodes;
    ids must tell pages apart. Places count characters from 0.
    """
    names = [x.split()[0] for x in NODES.split(", ")]
    kinds = [pa.int64(), *[pa.int32()] * 4, *[pa.string()] * 5, pa.bool_(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                page = batch.column(1)[at].as_py()
                rows = html.nodes(page) if page else []
                if rows:
                    ids = pa.array([batch.column(0)[at].as_py()] * len(rows), pa.int64())
                    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([ids, *cols], names=names)

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).filter("id is not null").mapInArrow(run, NODES)


def _inside(c: Column) -> Column:
    """Whether a node stands in (or is) an element for which ``c`` holds: intervals nest, so the furthest end so far tells."""
    upto = Window.partitionBy("id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.max(F.when(c, F.col("end"))).over(upto) >= F.col("pre"), F.lit(False))


def unwanted(scripted: bool = False) -> Column:
    """Elements that are removed with all they hold; in scripted pages headers of cards and classes with "header" stay."""
    tags, classes = (SCRIPTED_TAGS, SCRIPTED_CLASSES) if scripted else (REMOVED_TAGS, REMOVED_CLASSES)
    out = F.col("tag").isin(*tags) | reduce(lambda a, b: a | b, (F.contains("class", F.lit(c)) for c in classes))
    return out | ((F.col("tag") == "header") & ~F.contains("class", F.lit("card"))) if scripted else out


def main_content(nodes: DataFrame, scripted: bool = False) -> DataFrame:
    """(id, selector, pre, end, tag, start, stop, cuts) of every page: the element that the first selector with a match finds first.

    Removed elements are gone before selectors look. ``cuts`` are the outermost
    removed elements inside it, in order, as places in the page. Without any
    match the whole page is chosen (selector, pre and tag null).
    """
    flagged = nodes.withColumn("bad", unwanted(scripted)).withColumn("gone", _inside(F.col("bad")))
    selectors = SCRIPTED_SELECTORS if scripted else SELECTORS
    match = lambda kind, value: F.contains("class", F.lit(value)) if kind == "class" else F.col(kind) == value
    rank = F.coalesce(*(F.when(match(*s), F.lit(i)) for i, s in enumerate(selectors)))
    # outermost: no removed element reaches it from before
    before = F.max(F.when(F.col("bad"), F.col("end"))).over(Window.partitionBy("id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1))
    outer = F.col("bad") & ~F.coalesce(before >= F.col("pre"), F.lit(False))
    flagged = flagged.select("id", "pre", "end", "tag", "start", "stop", F.when(~F.col("gone") & (F.col("tag") != "#text"), rank).alias("rank"), outer.alias("outer"))
    best = F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "pre", "end", "tag", "start", "stop")))
    cuts = F.array_sort(F.collect_list(F.when(F.col("outer"), F.struct("start", "stop"))))
    out = flagged.groupBy("id").agg(best.alias("m"), cuts.alias("cuts"))
    inside = F.when(F.col("m").isNull(), F.col("cuts")).otherwise(F.filter("cuts", lambda c: (c["start"] >= F.col("m.start")) & (c["stop"] <= F.col("m.stop"))))
    return out.select("id", F.col("m.rank").alias("selector"), "m.pre", "m.end", "m.tag", "m.start", "m.stop", inside.alias("cuts"))


def without(page: Column, start: Column, stop: Column, cuts: Column) -> Column:
    """The page from ``start`` to ``stop`` (all of it, if null) without the pieces in ``cuts``."""
    first, last = F.coalesce(start, F.lit(0)), F.coalesce(stop, F.length(page))
    froms = F.concat(F.array(first), F.transform(cuts, lambda c: c["stop"]))
    upto = F.concat(F.transform(cuts, lambda c: c["start"]), F.array(last))
    return F.array_join(F.zip_with(froms, upto, lambda a, b: F.substr(page, a + 1, F.greatest(b - a, F.lit(0)))), "")


def cleaned(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", scripted: bool = False) -> DataFrame:
    """Every page with ``selector``, ``tag``, ``pre`` and its ``content``: the HTML of its main element without what is removed.

    Pages without nodes (null or empty) have null content and an empty one.
    """
    found = main_content(node_table(pages, id_col, html_col), scripted)
    joined = pages.join(found.withColumnRenamed("id", "_page"), pages[id_col] == F.col("_page"), "left")
    content = F.when(F.col("_page").isNull(), F.col(html_col)).otherwise(without(F.col(html_col), F.col("start"), F.col("stop"), F.col("cuts")))
    return joined.select(*(pages[c] for c in pages.columns), "selector", "tag", "pre", content.alias("content"))


def hoisted(page: Column) -> Column:
    """Component tags as plain divisions; the text of the first division of the prioritised class comes first of all."""
    found = F.regexp_extract(page, r'(?s)<div class="testolungo[^"]*"[^>]*>(.*?)</div>', 1)
    out = page
    for name in COMPONENTS:
        css = "app-switcher" if name == "switcher" else name
        out = F.replace(F.replace(out, F.lit(f"<app-{name}>"), F.lit(f'<div class="{css}">')), F.lit(f"</app-{name}>"), F.lit("</div>"))
    return F.when((found != "") & (found != "0"), F.concat(F.lit('<div class="main-content">'), found, F.lit("</div>"), out)).otherwise(out)


def densest(nodes: DataFrame) -> DataFrame:
    """(id, pre, tag, start, stop, points, link_share) of the element of every page that holds most running text.

    Paragraphs (p, td, pre) of 25 characters or more give a point, one for each
    comma and one for each hundred characters up to three, to their parent and
    half to its parent; the share of text in links is taken off. Removed
    elements take no part; of equal ones the first wins; pages without such a
    paragraph have no row.
    """
    whole = Window.partitionBy("id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    length = lambda c: F.sum(F.when(c, F.length(F.trim("text"))).otherwise(0)).over(whole)
    kept = nodes.withColumn("gone", _inside(unwanted()))
    is_text = (F.col("tag") == "#text") & ~F.col("gone")
    kept = kept.withColumns({"sum_text": length(is_text), "sum_link": length(is_text & F.col("linked")), "sum_commas": F.sum(F.when(is_text, F.regexp_count("text", F.lit(f"[{COMMAS}]"))).otherwise(0)).over(whole)})
    ends = kept.select("id", F.col("pre").alias("end"), F.col("sum_text").alias("to_text"), F.col("sum_link").alias("to_link"), F.col("sum_commas").alias("to_commas"))
    elements = kept.filter("tag <> '#text' and not gone").join(ends, ["id", "end"]).select(
        "id", "pre", "parent", "tag", "start", "stop", (F.col("to_text") - F.col("sum_text")).alias("size"), (F.col("to_link") - F.col("sum_link")).alias("in_links"), (F.col("to_commas") - F.col("sum_commas")).alias("commas")
    )
    paragraphs = elements.filter(F.col("tag").isin(*PARAGRAPHS) & (F.col("size") >= LEAST_PARAGRAPH))
    paragraphs = paragraphs.select("id", "parent", (F.lit(1) + F.col("commas") + F.least(F.floor(F.col("size") / 100), F.lit(3))).alias("points"))
    above = elements.select("id", F.col("pre").alias("parent"), F.col("parent").alias("grand"))
    given = paragraphs.join(above, ["id", "parent"]).select("id", F.explode(F.array(F.struct(F.col("parent").alias("pre"), (F.col("points") * 2).alias("p")), F.struct(F.col("grand").alias("pre"), F.col("points").alias("p")))).alias("x"))
    sums = given.select("id", "x.pre", "x.p").groupBy("id", "pre").agg(F.sum("p").alias("halves"))
    share = F.when(F.col("size") > 0, F.col("in_links") / F.col("size")).otherwise(0.0)
    scored = sums.join(elements, ["id", "pre"]).select("id", "pre", "tag", "start", "stop", (F.col("halves") / 2 * (1 - share)).alias("points"), share.alias("link_share"))
    best = scored.groupBy("id").agg(F.max(F.struct("points", (-F.col("pre")).alias("first"), "tag", "start", "stop", "link_share")).alias("m"))
    return best.select("id", (-F.col("m.first")).alias("pre"), "m.tag", "m.start", "m.stop", "m.points", "m.link_share")


def _densest(page: str | None) -> dict | None:
    """What ``densest`` finds in one page, by one walk over its nodes and prefix sums of its text."""
    rows = html.nodes(page) if page else []
    size, linked, commas = ([0] * (len(rows) + 1) for _ in range(3))
    gone, alive = 0, []  # the last node inside what is removed
    for pre, end, _, _, tag, css, _, _, text, in_link, *_ in rows:
        if pre > gone and (tag in REMOVED_TAGS or any(c in css for c in REMOVED_CLASSES)):
            gone = end
        said = tag == "#text" and pre > gone
        n = len(text.strip(" ")) if said else 0
        size[pre] = size[pre - 1] + n
        linked[pre] = linked[pre - 1] + (n if in_link else 0)
        commas[pre] = commas[pre - 1] + (sum(map(text.count, COMMAS)) if said else 0)
        if tag in PARAGRAPHS and pre > gone:
            alive.append(pre)
    halves: Counter = Counter()
    for pre in alive:
        end, parent = rows[pre - 1][1:3]
        if parent and (n := size[end] - size[pre]) >= LEAST_PARAGRAPH:
            points = 1 + commas[end] - commas[pre] + min(n // 100, 3)
            halves[parent] += 2 * points
            halves[rows[parent - 1][2]] += points
    best = None
    for pre, n in halves.items():
        if pre:
            end = rows[pre - 1][1]
            share = (linked[end] - linked[pre]) / (size[end] - size[pre])
            best = max(best or (-1.0, 0, 0.0), (n / 2 * (1 - share), -pre, share))
    if best is None:
        return None
    row = rows[-best[1] - 1]
    return {"pre": row[0], "tag": row[4], "start": row[-2], "stop": row[-1], "points": best[0], "link_share": best[2]}


_FIELDS = (("pre", T.IntegerType()), ("tag", T.StringType()), ("start", T.IntegerType()), ("stop", T.IntegerType()), ("points", T.DoubleType()), ("link_share", T.DoubleType()))
_DENSEST = pa.struct([("pre", pa.int32()), ("tag", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("points", pa.float64()), ("link_share", pa.float64())])


@F.arrow_udf(T.StructType([T.StructField(*f) for f in _FIELDS]))
def _densest_elements(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in slices(pa.RecordBatch.from_arrays([c], ["page"]) for c in columns):
        yield pa.array([_densest(x) for x in batch.column(0).to_pylist()], _DENSEST)


def densest_element(page: Column) -> Column:
    """(pre, tag, start, stop, points, link_share) of each page's densest element, as ``densest`` tells it from a node table; null without one.

    A page is read once where it is, so nothing is shuffled.
    """
    return _densest_elements(page)


def passes(markdown: Column, page: Column) -> Column:
    """Whether an extraction is long enough and holds enough of its page."""
    return F.coalesce((F.octet_length(markdown) >= LEAST_BYTES) & (markup.extraction_quality(markdown, page) >= LEAST_QUALITY), F.lit(False))
