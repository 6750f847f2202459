"""Encodings: bytes of given texts read wrongly, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encodings
from .registry import add


def _repaired(docs: DataFrame) -> DataFrame:
    """Every text, read wrongly in four ways, comes back."""
    text = F.col("text")
    ways = {
        "as windows-1252": encodings.misread(text),
        "as iso-8859-1": encodings.misread(text, as_1252=False),
        "twice": encodings.misread(encodings.misread(text)),
        "both": encodings.misread(encodings.misread(text, as_1252=False)),
    }
    each = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(w).alias("way"), c.alias("bad")) for w, c in ways.items()))).alias("x"))
    return each.select("doc_id", "x.way", F.md5(encodings.repaired(F.col("x.bad"))).alias("digest"))


add("X24_repaired", "documents", _repaired, """SELECT doc_id, way, md5(text) AS digest FROM documents, (VALUES ('as windows-1252'), ('as iso-8859-1'), ('twice'), ('both')) w(way)""")


def _fetched(pages: DataFrame) -> DataFrame:
    """Pages as bytes: in UTF-8 with a header, without any, and in windows-1252 (where it has all characters) declared as ISO-8859-1."""
    html = F.col("html")
    latin = F.encode(F.translate(html, encodings._HIGH, encodings._CONTROL), "ISO-8859-1")
    fits = ~F.translate(html, encodings._HIGH, encodings._CONTROL).rlike(r"[^\x00-\xFF]")
    rows = pages.select("page_id", F.explode(F.array(
        F.struct(F.encode(html, "UTF-8").alias("content"), F.lit("text/html; charset=UTF-8").alias("kind")),
        F.struct(F.encode(html, "UTF-8").alias("content"), F.lit(None).cast("string").alias("kind")),
        F.struct(F.when(fits, latin).alias("content"), F.lit('text/html; charset="ISO-8859-1"').alias("kind")),
    )).alias("x"))
    rows = rows.filter("x.content is not null")
    return rows.select("page_id", "x.kind", F.md5(encodings.fetched_text(F.col("x.content"), F.col("x.kind"))).alias("digest"))


_ASCII = "html"
for _a, _b in encodings.QUOTES.items():
    _ASCII = f"""replace({_ASCII}, '{_a}', '{_b.replace("'", "''")}')"""
_WIDE = "".join(c for c in encodings._HIGH if ord(c) > 0xFF)
add("X25_fetched", "pages", _fetched, f"""SELECT page_id, kind, md5({_ASCII}) AS digest FROM pages, (VALUES ('text/html; charset=UTF-8'), (NULL), ('text/html; charset="ISO-8859-1"')) k(kind)
WHERE kind IS DISTINCT FROM 'text/html; charset="ISO-8859-1"' OR NOT regexp_matches(html, '[^\\x00-\\xFF{_WIDE}]')""")

_MENDED = "text"
for _a, _b in encodings.CONFUSED.items():
    _MENDED = f"replace({_MENDED}, '{_a}', '{_b}')"
add("X23_unconfused", "documents", lambda d: d.select("doc_id", F.md5(encodings.unconfused(F.col("text"))).alias("digest")), f"SELECT doc_id, md5({_MENDED}) AS digest FROM documents")
