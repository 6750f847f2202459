"""Citations as one context: duplicates gone, tables first and told twice, cut to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking
from .chunking import is_table_line
from .text import dedup_key, has_table

# They must equal those of existing deployments.
TABLE_MARK = "**Table (alta priorità)**\n\n"
FLAT_MARK = "\n\nTabella (testo lineare di supporto):\n"
FIELDS = {"phone": "Telefono", "email": "Email", "address": "Indirizzo", "schedule": "Orario"}
SOURCE = "Fonte"


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))


def flat_table(text: Column) -> Column:
    """The rows of a text's pipe lines as ``header: value; …`` by the first of them, a line each; empty cells and rules left out."""
    rows = F.transform(F.filter(F.split(text, "\n"), lambda x: is_table_line(x) & ~x.rlike(r"^[\s|:-]+$")), lambda x: _cells(x))

    def lines(all_rows: Column) -> Column:
        pair = lambda h, v: F.when(F.length(v) > 0, F.concat_ws(": ", h, v))
        each = F.transform(F.slice(all_rows, 2, F.greatest(F.lit(1), F.size(all_rows))), lambda r: F.array_join(F.array_compact(F.zip_with(all_rows[0], r, pair)), "; "))
        return F.array_join(F.filter(each, lambda x: x != ""), "\n")

    return F.get(F.transform(F.array(rows), lambda r: F.when(F.size(r) > 1, lines(r)).otherwise("")), 0)


def table_snippet(text: Column) -> Column:
    """A table with a mark before it and its flat copy below; empty for an empty text.

    If other text comes first, a blank line stands above every row, as existing
    deployments have it.
    """
    plain = F.regexp_replace(text, r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+\z", "")
    shown = F.when(plain.startswith("|"), plain).otherwise(F.regexp_replace(plain, r"(\S)\n(\|)", "$1\n\n$2"))
    flat = flat_table(shown)
    whole = F.concat(F.lit(TABLE_MARK), shown, F.when((flat != "") & (flat != shown), F.concat(F.lit(FLAT_MARK), flat)).otherwise(""))
    return F.when(plain == "", "").otherwise(whole)


def part(citation_text: Column, title: Column) -> Column:
    """One citation as it stands in a context: title, text (tables as snippets), its fields, its source. Reads phone, email, address, schedule and url."""
    text = F.coalesce(citation_text, F.lit(""))
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    extra = F.concat(*(F.when(there(c), F.concat(F.lit(f"\n{label}: "), F.col(c))).otherwise("") for c, label in FIELDS.items()))
    source = F.when(there("url"), F.concat(F.lit(f"\n\n[{SOURCE}]("), F.col("url"), F.lit(")"))).otherwise("")
    shown = F.when(has_table(text), table_snippet(text)).otherwise(text)
    head = F.concat(F.lit("["), title, F.lit("]"))
    return F.when(shown != "", F.concat(head, F.lit("\n"), shown, extra, source)).when(extra != "", F.concat(head, extra, source)).otherwise("")


def build(citations: DataFrame, by: str, order: list[str], budget: int) -> DataFrame:
    """(by, parts, context): the citations of each group in one text, up to the first that would exceed the budget of characters.

    ``citations``: title, text, url, phone, email, address, schedule. Of equal
    texts with one address (whatever the case) the first stays; tables come
    before other texts, each in their order; null titles read "Unknown".
    Citations without text and fields are left out.
    """
    keyed = citations.withColumn("_key", dedup_key(F.col("text"), F.col("url")))
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(by, "_key").orderBy(*order))).filter("_n = 1")
    rows = first.select(by, *(c for c in order if c != by), (~has_table(F.coalesce("text", F.lit("")))).alias("_plain"), part(F.col("text"), F.coalesce("title", F.lit("Unknown"))).alias("_part"))
    return ranking.pack(rows, by, "_part", ["_plain", *order], budget)
