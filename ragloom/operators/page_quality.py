"""Quality of pages: metrics of text and markup, page types, categories, scores and priorities."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# They must equal those of existing deployments.
ENTITIES = (
    r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b",
    r"\b\d{1,2}:\d{2}\b",
    r"\b(?:\+39\s?)?(?:\d{2,4}[\s\-]?){2,4}\d{2,4}\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    r"(?i)\b(?:via|piazza|corso|viale|strada)\s+[^,\n]{5,50}",
    r"(?i)\b\d+(?:[.,]\d{2})?\s?(?:€|euro|eur)\b",
    r"\b\d+(?:[.,]\d+)?%\b",
    r"(?i)\bhttps?://[^\s<]+",
)
STRUCTURED = (r"\b(?:\d{2,4}[\s\-]?){2,4}\d{2,4}\b", r"(?i)\b(?:via|piazza|corso|viale)\s+[^,\n]{5,50}", r"\b\d{1,2}:\d{2}\s*[-–]\s*\d{1,2}:\d{2}\b")
CATEGORIES = {
    "contact_info": (1.0, ("contatti?", "telefono", "email", "indirizzo", "sede")),
    "hours_services": (0.9, ("orari?", "apertura", "servizi", "uffici")),
    "news_events": (0.7, ("news", "notizie", "eventi", "comunicati")),
    "procedures_docs": (0.8, ("procedur", "modulistic", "document", "normativ")),
    "product_catalog": (0.7, ("prodott", "catalogo", "servizi", "offert")),
}
BUSINESS = (("contatti?", "telefono", "email", "sede"), ("servizi", "prodott", "offert", "prezz"), ("procedur", "modulistic", "richiesta", "domand"), ("orari", "apertura", "chiusura"))
WEIGHTS = {"text_ratio": 0.2, "density": 0.25, "richness": 0.2, "language_quality": 0.15, "relevance": 0.2}
BLANKS = r" \t\n\f\r"
WORDS = r"[A-Za-z'][A-Za-z'-]*"


def _ascii(pattern: str) -> str:
    """``pattern`` with boundaries and blanks of ASCII only, as RE2 has them; of other letters only the long s folds to one that is in use."""
    pattern = re.sub(r"(?<!\\)\[([^\]]*)\]", lambda m: "[" + m[1].replace(r"\s", BLANKS) + "]", pattern)
    pattern = pattern.replace(r"\s", f"[{BLANKS}]").replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")
    if pattern.startswith("(?i)"):
        pattern = re.sub(r"(?<![\\\[^])s", "[s\u017f]", pattern)
    return pattern


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero by the product in binary, as SQL does (``round`` goes by decimals); for values from 0 on."""
    y = x * float(10**digits)
    return (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)) / float(10**digits)


def _lower(text: Column) -> Column:
    """Lower case, each character by itself: the dotted capital I is one letter."""
    return F.lower(F.translate(text, "\u0130", "i"))


def _count(html: Column, *tags: str) -> Column:
    """How often any of the tags begins."""
    return reduce(lambda a, b: a + b, (F.regexp_count(html, F.lit(t)) for t in tags))


def _ratio(text: Column, drop: str) -> Column:
    """Bytes that stay without ``drop``, over all bytes."""
    n = F.octet_length(text)
    return F.when(n > 0, F.octet_length(F.regexp_replace(text, F.lit(drop), F.lit(""))) / n).otherwise(0.0)


def metrics(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with the metrics, predicates, type, category, quality and priority of each page.

    The text is what stays without tags; a tag ends at the first ``>``. Sizes
    are in bytes, words are runs of ASCII letters. A null page counts as empty.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.withColumn("_text", F.regexp_replace(html, "<[^>]*>", ""))
    text, low = F.col("_text"), F.col("_low")
    # each of these is worked out once, however often it is named
    rows = rows.withColumns({"_low": _lower(text), "_letters": F.regexp_replace("_text", "[^a-zA-Z]+", "")})
    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORDS), F.lit(0))).withColumn("_n", F.size("_words")).withColumn("_size", F.octet_length("_text"))
    sentences = F.size(F.split(text, r"[.!?]+", -1))
    letters, marks = F.col("_letters"), F.col("_marks")
    upper = F.when(F.length(letters) > 0, F.length(F.regexp_replace(letters, "[^A-Z]+", "")) / F.length(letters)).otherwise(0.0)
    lower = F.when(F.length(letters) > 0, F.length(F.regexp_replace(letters, "[^a-z]+", "")) / F.length(letters)).otherwise(0.0)
    rows, odd = rows.withColumn("_marks", _ratio(text, "[^.!?,:;]+")), _ratio(text, _ascii(r"[a-zA-Z0-9\s.!?,:;]+"))
    language = F.lit(0.5) - F.when((upper > 0.8) | (lower > 0.9), 0.3).otherwise(0.0) + F.when((marks > 0.02) & (marks < 0.15), 0.2).otherwise(0.0) - F.when(odd > 0.1, 0.2).otherwise(0.0)
    kinds = reduce(lambda a, b: a + b, (F.least(F.regexp_count(text, F.lit(_ascii(p))) * 0.1, F.lit(0.3)) for p in ENTITIES))
    relevance = reduce(lambda a, b: a + b, (F.when(low.rlike("|".join(p)), 0.25).otherwise(0.0) for p in BUSINESS))
    structured = reduce(lambda a, b: a + b, (html.rlike(_ascii(p)).cast("int") for p in STRUCTURED)) >= 2
    rows = rows.withColumns({
        "text_ratio": F.when(F.octet_length(html) > 0, F.octet_length(F.regexp_replace(text, r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+\z", "")) / F.octet_length(html)).otherwise(0.0),
        "density": F.when(F.col("_n") == 0, 0.0).otherwise(rounded(F.least(F.lit(1.0), F.size(F.array_distinct("_words")) / F.col("_n") * 2 + F.least(F.col("_n") / sentences / 20, F.lit(0.5))), 3)),
        "richness": F.least(F.lit(1.0), kinds),
        "language_quality": F.when(F.col("_n") < 10, 0.1).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), language))),
        "relevance": F.least(F.lit(1.0), relevance),
        "structured": structured,
        "complex_tables": (_count(html, "<table") > 0) & ((_count(html, "<td", "<th") > 15) | (_count(html, "hidden-xs", "visible-xs") > 5)),
        "has_forms": _count(html, "<form") > 0,
        "has_navigation": _lower(html).rlike("<nav|menu|breadcrumb|sidebar"),
        "has_media": _count(html, "<img", "<video", "<audio") > 2,
    })
    kind = (
        F.when((_count(html, "<img", "<video", "<iframe") > 5) & (F.col("_size") < 500), "media_rich")
        .when(F.col("complex_tables"), "data_table")
        .when((_count(html, "<form") > 0) & (_count(html, "<input", "<select", "<textarea") > 3), "interactive_form")
        .when((_count(html, "<a ") > 20) & (F.col("_size") < 1000), "navigation_directory")
        .when((F.col("_size") > 500) & (_count(html, "<p") > 3), "article_content")
        .when(F.col("structured"), "structured_info")
        .otherwise("generic_page")
    )
    # the category with the largest sum of weights, the first of equals
    sums = {f"_{c}": reduce(lambda a, b: a + b, (low.rlike(p).cast("int") for p in patterns)) * w for c, (w, patterns) in CATEGORIES.items()}
    rows = rows.withColumns(sums).withColumn("_best", F.greatest(*sums))
    category = F.lit("general")
    for c in reversed(CATEGORIES):
        category = F.when((F.col(f"_{c}") == F.col("_best")) & (F.col(f"_{c}") > 0), F.lit(c)).otherwise(category)
    rows = rows.withColumns({"page_type": kind, "category": category})
    whole = reduce(lambda a, b: a + b, (F.col(k) * w for k, w in WEIGHTS.items())) + F.when(F.col("structured") & (F.col("relevance") > 0.5), 0.1).otherwise(0.0)
    whole = whole * F.when(F.col("page_type") == "navigation_directory", 0.7).otherwise(1.0)
    rows = rows.withColumn("quality", rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), whole)), 3))
    priority = F.when((F.col("quality") >= 0.7) | (F.col("relevance") > 0.7), "high").when(F.col("quality") < 0.3, "low").otherwise("normal")
    return rows.withColumn("priority", priority).drop("_text", "_low", "_letters", "_words", "_n", "_size", "_marks", "_best", *sums)
