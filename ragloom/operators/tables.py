"""Pipe tables and directories in texts, and chunks of them: expressions on arrays of lines, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunking

#: Rows from which a table is cut into rows, the fewest entries of a directory, and so many that its text needs no other chunks.
LARGE_TABLE = 10
LEAST_ENTRIES = 2
ENOUGH_ENTRIES = 5
PHONE = r"(?:(?:\+?39\s?)?)?(?:\d[\d.\-\s]{5,}\d)"
SEPARATOR_ROW = r"^\|?\s*:?-+.*\|.*-+.*\s*\|?\s*$"


def _strip(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\n\r\x00\x0b"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: what a lambda function names is worked out anew for every item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _part(lines: Column, start: Column, n: Column) -> Column:
    """``n`` lines from position ``start`` (from 0) on."""
    return F.array_join(F.slice(lines, start + 1, F.greatest(n, F.lit(0))), "\n")


def find_tables(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table, start_line, rows, cols, content, context_before, context_after) of every pipe table.

    Two lines or more in a row with two pipes or more are a table; its context
    are up to two lines on either side. Null texts have none.
    """
    held = rows.select(key, _lines(F.col(text)).alias("lines")).withColumn("is_row", F.transform("lines", chunking.is_table_line)).filter(F.array_contains("is_row", True))
    n = F.size("lines")
    every = F.sequence(F.lit(0), n - 1)
    row = lambda i: F.coalesce(F.get("is_row", i), F.lit(False))
    starts = F.filter(every, lambda i: row(i) & ~row(i - 1))
    ends = F.filter(every, lambda i: row(i) & ~row(i + 1))
    spans = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("s"), b.alias("e"))), lambda x: x["e"] > x["s"])
    found = held.withColumn("n", n).select(key, "lines", "n", F.posexplode(spans).alias("table", "at")).select(key, "lines", "n", "table", "at.s", "at.e")
    lines = F.col("lines")
    return found.select(
        key,
        "table",
        F.col("s").alias("start_line"),
        (F.col("e") - F.col("s") + 1).alias("rows"),
        (F.length(F.get(lines, F.col("s"))) - F.length(F.replace(F.get(lines, F.col("s")), F.lit("|"), F.lit(""))) - 1).alias("cols"),
        _part(lines, F.col("s"), F.col("e") - F.col("s") + 1).alias("content"),
        _strip(_part(lines, F.greatest(F.col("s") - 2, F.lit(0)), F.least(F.col("s"), F.lit(2)))).alias("context_before"),
        _strip(_part(lines, F.col("e") + 1, F.least(F.col("n") - F.col("e") - 1, F.lit(2)))).alias("context_after"),
    )


def _cells(line: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(line, r"^[| ]+|[| ]+$", ""), r"\|", -1), _strip), lambda x: x != "")


def row_chunks(content: Column) -> Column:
    """``header: value`` lines for each row below the separator of a table; none without a separator. Empty cells don't count."""
    lines = F.filter(F.transform(F.split(content, "\n", -1), _strip), lambda x: x != "")
    cut = F.array_position(F.transform(lines, lambda x, i: (i > 0) & x.rlike(SEPARATOR_ROW)), True)
    head = _cells(F.get(lines, F.lit(0)))
    below = F.when(cut > 0, F.slice(lines, cut.cast("int") + 1, F.size(lines))).otherwise(F.slice(lines, 1, 0))
    pairs = F.transform(F.filter(below, lambda x: F.contains(x, F.lit("|"))), lambda x: F.filter(F.zip_with(head, _cells(x), lambda h, v: F.concat(h, F.lit(": "), v)), lambda p: p.isNotNull()))
    return F.transform(F.filter(pairs, lambda p: F.size(p) > 0), lambda p: F.array_join(p, "\n"))


def chunk_tables(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table, part, kind, content): small tables whole with their context, large ones row by row after what stands before."""
    found = find_tables(rows, key, text).withColumn("parts", row_chunks(F.col("content")))
    by_row = (F.col("rows") >= LARGE_TABLE) & (F.size("parts") > 0)
    whole = _strip(F.concat_ws("\n\n", "context_before", _strip(F.col("content")), "context_after"))
    before = F.when(F.col("context_before") != "", F.concat("context_before", F.lit("\n\n"))).otherwise("")
    texts = F.when(by_row, F.transform("parts", lambda p: _strip(F.concat(before, p)))).otherwise(F.array(whole))
    kind = F.when(by_row, "table_row").otherwise("table")
    return found.select(key, "table", kind.alias("kind"), F.posexplode(texts).alias("part", "content"))


def directory_entries(text: Column) -> Column:
    """Distinct entries of a directory, as (name, phones, address, content); none if fewer than two.

    A line with a phone is an entry: the name is the nearest of the two lines
    above without a phone, the address the next line if it has none.
    """
    lines = F.filter(F.transform(_lines(text), _strip), lambda x: x != "")
    marked = F.transform(lines, lambda x: F.struct(x.alias("t"), x.rlike(PHONE).alias("phone")))

    def entries(held: Column) -> Column:
        def parts(i: Column) -> Column:
            plain = lambda k: F.when(~F.get(held, i + k)["phone"], F.get(held, i + k)["t"])
            phones = F.array_join(F.transform(F.regexp_extract_all(F.get(held, i)["t"], F.lit(PHONE), F.lit(0)), lambda m: F.trim(m)), " / ")
            return F.struct(F.coalesce(plain(-1), plain(-2), F.lit("")).alias("name"), phones.alias("phones"), F.coalesce(plain(1), F.lit("")).alias("address"))

        def entry(e: Column) -> Column:
            named = lambda label, c: F.when(e[c] != "", F.concat(F.lit(label), e[c]))
            return F.struct(e["name"], e["phones"], e["address"], F.concat_ws("\n", named("Nome: ", "name"), named("Telefono: ", "phones"), named("Indirizzo: ", "address")).alias("content"))

        some = F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: F.get(held, i)["phone"])
        found = F.array_distinct(F.filter(F.transform(F.transform(some, parts), entry), lambda e: F.length(e["content"]) >= 15))
        return _let(found, lambda x: F.when((F.size(held) >= 3) & (F.size(x) >= LEAST_ENTRIES), x).otherwise(F.slice(x, 1, 0)))

    return _let(marked, entries)


def without_boilerplate(text: Column) -> Column:
    """Without the lines that a scraper adds: a heading that is a host name, the address, the date; no runs of blank lines."""
    for line in (r"(?m)^#\s+[a-z0-9\-.]+\s*$", r"(?m)^\*\*URL:\*\*.*$", r"(?m)^\*\*Scraped on:\*\*.*$"):
        text = F.regexp_replace(text, F.lit(line), F.lit(""))
    return _strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def chunk_by_source(docs: DataFrame, key: str, text: str, scraped: Column, size: int, overlap: int) -> DataFrame:
    """(key, kind, part, content): scraped texts in paragraphs alone; uploaded ones as tables, directory entries and paragraphs.

    Paragraphs of an uploaded text are left out where its directory has entries enough.
    """
    web = chunking.chunks(docs.filter(scraped).select(key, without_boilerplate(F.col(text)).alias(text)), text, size, overlap)
    uploads = docs.filter(~F.coalesce(scraped, F.lit(False))).select(key, text)
    tables = chunk_tables(uploads, key, text).select(key, "kind", (F.col("table") * 100_000 + F.col("part")).alias("part"), "content")
    rest = uploads.select(key, chunking.without_tables(F.col(text)).alias(text)).withColumn("entries", directory_entries(F.col(text)))
    listed = rest.select(key, F.posexplode("entries.content").alias("part", "content"))
    plain = chunking.chunks(rest.filter(F.size("entries") < ENOUGH_ENTRIES).select(key, text), text, size, overlap)
    numbered = lambda df, kind: df.select(key, F.lit(kind).alias("kind"), F.col(df.columns[1]).alias("part"), "content")
    return numbered(web, "standard").unionByName(tables).unionByName(numbered(listed, "directory_entry")).unionByName(numbered(plain, "standard"))
