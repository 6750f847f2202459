"""Paragraph and sentence chunking: one text a row in, its chunks out.

Packing depends on all that went before in the same text, so it runs as a
small Arrow-batched function; texts never meet, so nothing is shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import slices

#: Sentences end at these marks before a blank or the end; longer chunks than this factor are cut hard.
SENTENCE = re.compile(r"(?<=[.!?])\s+")
HARD_FACTOR = 1.5


def tail(text: str, most: int) -> str:
    """At most ``most`` last characters, from the first blank in them on if there is one after their first character."""
    text = text.strip()
    if len(text) <= most:
        return text
    end = text[-most:] if most else ""
    _, blank, rest = end.partition(" ")
    return rest if blank and not end.startswith(" ") else end


def windows(text: str, size: int, overlap: int) -> list[str]:
    return [text[at : at + size] for at in range(0, max(1, len(text) - overlap), size - overlap)]


def _pack(parts: list[str], joint: str, size: int, overlap: int, again: str):
    """Greedy packing; a full chunk is yielded and its tail begins the next one, after ``again``."""
    held = ""
    for part in parts:
        if held and len(held) + len(joint) + len(part) > size:
            yield held.strip()
            held = tail(held, overlap)
            held = f"{held}{again}{part}" if held or again != joint else part
        else:
            held = f"{held}{joint}{part}" if held else part
    if held.strip():
        yield held.strip()


def by_sentences(text: str, size: int, overlap: int) -> list[str]:
    """Whole sentences packed to ``size``; a text whose chunks still are far too long is cut into windows."""
    found = list(_pack([x.strip() for x in SENTENCE.split(text) if x.strip()], " ", size, overlap, " "))
    if not found or max(map(len, found)) > size * HARD_FACTOR:
        return windows(text, size, overlap)
    return found


def by_paragraphs(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs packed to ``size``; what is too long is packed by sentences, the last of which goes on."""
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    done: list[str] = []
    held = ""
    for part in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        if held and len(held) + 2 + len(part) > size:
            done.append(held.strip())
            held = tail(held, overlap)
        held = f"{held}\n\n{part}" if held else part
        if len(held) > size:
            *full, held = by_sentences(held, size, overlap)
            done += full
    return done + [held.strip()] if held.strip() else done


STRATEGIES = {"standard": by_paragraphs, "sentence": by_sentences, "hard": windows}


def chunks(rows: DataFrame, text: str, size: int, overlap: int, strategy: str = "standard") -> DataFrame:
    """The rows' other columns with chunk_index and content; an unknown strategy is ``standard``, empty and null texts have none.

    Few texts at a time become Python strings, and their chunks go on at once.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")
    cut = STRATEGIES.get(strategy, by_paragraphs)
    others = [c for c in rows.columns if c != text]
    names = [*others, "chunk_index", "content"]

    def run(batches):
        for batch in slices(batches):
            found = [cut(x, size, overlap) if x and x.strip() else [] for x in batch.column(len(others)).to_pylist()]
            of = pa.array([i for i, each in enumerate(found) for _ in each], pa.int32())
            index = pa.array([k for each in found for k in range(len(each))], pa.int32())
            content = pa.array([x for each in found for x in each], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(of) for i in range(len(others))), index, content], names=names)

    schema = T.StructType([*(rows.schema[c] for c in others), T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType())])
    return rows.select(*others, text).mapInArrow(run, schema)


def is_table_line(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2


def without_tables(text: Column) -> Column:
    """The lines that are neither rows of a table nor blank."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~is_table_line(x) & (F.length(F.trim(x)) > 0)), "\n")


def table_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table, line, content): the rows of every pipe table, numbered from 1; separators left out.

    Lines in a row with two pipes at least are one table, if there are two.
    """
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("at", "content")).filter(is_table_line(F.col("content")))
    w = Window.partitionBy(key).orderBy("at")
    lines = lines.withColumn("_run", F.col("at") - F.row_number().over(w))
    one = Window.partitionBy(key, "_run")
    lines = lines.withColumn("_n", F.count("*").over(one)).filter("_n > 1").filter(~F.col("content").rlike(r"^[\s|:-]+$"))
    return lines.select(key, F.dense_rank().over(Window.partitionBy(key).orderBy("_run")).alias("table"), F.row_number().over(one.orderBy("at")).alias("line"), F.trim("content").alias("content"))


def flat_tables(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table, line, flat): each data row as ``header: value; …``, by its table's first row."""
    cells = lambda c: F.transform(F.split(F.regexp_replace(c, r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    found = table_lines(rows, key, text)
    heads = found.filter("line = 1").select(key, "table", cells(F.col("content")).alias("head"))
    pairs = F.zip_with("head", "row", lambda h, v: F.when(F.length(v) > 0, F.concat_ws(": ", h, v)))
    data = found.filter("line > 1").withColumn("row", cells(F.col("content"))).join(heads, [key, "table"])
    return data.select(key, "table", "line", F.array_join(pairs, "; ").alias("flat"))
