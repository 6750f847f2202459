"""Pages as Markdown: conversion, and extraction by main content or by density."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html, markup
from ..session import dealt, slices
from . import page_tree


@F.arrow_udf(T.StringType())
def _converted(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for batch in slices(pa.RecordBatch.from_arrays(list(c), ["page", "base"]) for c in columns):
        yield pa.array([html.to_markdown(p, b) for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.string())


def to_markdown(page: Column, base: Column) -> Column:
    """A page's body as Markdown, its links seen from the address ``base`` (null or empty: as they are); null stays null.

    Headings, paragraphs, lists, quotes, code, emphasis, links and pipe tables;
    marks in text are escaped; scripts and styles are left out; versions for
    small screens are skipped beside one for large screens; empty cells are a
    dash. A table inside a cell stands in that cell; its rows are not told again
    as rows of the outer table (nested tables would double with every level).
    """
    return _converted(page, F.coalesce(base, F.lit("")))


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", scripted: bool = False) -> DataFrame:
    """Each page's main content as Markdown with its lines filtered; null where less than 50 bytes are left.

    Component tags are rewritten first; ``selector`` says what was chosen.
    """
    whole = pages.withColumn("_whole", page_tree.hoisted(F.col(html_col)))
    found = page_tree.cleaned(whole.select(id_col, url_col, "_whole"), id_col, "_whole", scripted)
    text = markup.filtered_lines(to_markdown(F.col("content"), F.col(url_col)))
    found = found.select(id_col, "selector", "tag", text.alias("markdown"))
    return found.withColumn("markdown", F.when(F.octet_length("markdown") >= page_tree.LEAST_BYTES, F.col("markdown")))


def by_density(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Each page's densest element as Markdown, with its points, link share and whether it passes the gate.

    Pages without a paragraph of running text have nulls and don't pass.
    """
    found = dealt(pages.select(id_col, F.col(url_col).alias("_url"), F.col(html_col).alias("_html")), id_col)
    found = found.withColumn("_at", page_tree.densest_element(F.col("_html")))
    piece = F.substr("_html", F.col("_at.start") + 1, F.col("_at.stop") - F.col("_at.start"))
    text = markup.filtered_lines(to_markdown(piece, F.col("_url")))
    out = found.select(id_col, "_at.pre", "_at.tag", "_at.points", "_at.link_share", "_html", text.alias("markdown"))
    return out.withColumn("passed", page_tree.passes(F.col("markdown"), F.col("_html"))).drop("_html")
