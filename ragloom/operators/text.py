"""Text clean-up, chunking and text measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise(text: Column) -> Column:
    """Line ends as one kind, runs of blanks as one, at most one empty line between paragraphs."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, "[ \\t]+", " "), "\n{3,}", "\n\n")


def hard_chunks(rows: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """Fixed windows that overlap: chunk_index and content of every chunk; none for empty texts."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")
    step = size - overlap
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - overlap) / step).cast("int") - 1)))
    out = rows.select("*", F.explode(starts).alias("chunk_index"))
    return out.withColumn("content", F.substring(F.col(text), F.col("chunk_index") * step + 1, F.lit(size)))


def chunk_size(n: Column, largest: int = 2_200) -> Column:
    """The chunk size that suits a text of n characters."""
    return F.when(n < 1_000, n).when(n <= 20_000, F.lit(largest)).otherwise(F.lit(3_000))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-cased text."""
    low = F.lower(text)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - 2))
    return F.array_distinct(F.transform(at, lambda i: F.substring(low, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def terms(text: Column, most: int | None = 60) -> Column:
    """Lower-cased words of two characters at least, distinct, in order; the first ``most``, or all."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")
    found = F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))
    return found if most is None else F.slice(found, 1, most)


def snippet(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def has_table(text: Column) -> Column:
    """Two lines at least with two pipes at least."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)) >= 2


def digests(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("content_hash", F.sha2(text, 256)).withColumn("dedup_key", F.sha1(F.lower(F.trim(text)))).withColumn("cache_key", F.substring(F.sha2(text, 256), 1, 16))


def holds_required(text: Column, terms_: list[str], generic: tuple[str, ...] = ()) -> Column:
    """Whether a text holds one of the terms of three characters or more that aren't generic; without any terms all do, with generic ones only none does. Null texts count as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    wanted = [t.strip().lower() for t in terms_]
    found = [F.contains(low, F.lit(t)) for t in wanted if len(t) >= 3 and t not in generic]
    return F.lit(not wanted) if not found else F.greatest(*found, F.lit(False))


def dedup_key(text: Column, url: Column) -> Column:
    """SHA-1 of the lower-cased text and address, so that a text on two pages has two keys."""
    both = F.concat(F.coalesce(text, F.lit("")), F.lit("|"), F.coalesce(url, F.lit("")))
    return F.sha1(F.lower(F.trim(both)).cast("binary"))
