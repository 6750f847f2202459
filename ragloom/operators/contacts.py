"""Contacts near a name, contact types of answers, and the words that sharpen a query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, scalars
from . import text as texts

# They must equal those of existing deployments.
_GAP = r"[\s.\-]*"
PHONES = (rf"(?<!\d)(?:\+39{_GAP})?0\d{{1,3}}{_GAP}\d{{6,8}}(?!\d)", rf"(?<!\d)(?:\+39{_GAP})?3\d{{2}}{_GAP}\d{{3}}{_GAP}\d{{3,4}}(?!\d)", rf"(?<!\d)(?:800|199|892|899|163|166){_GAP}\d{{3,6}}(?!\d)", r"(?<!\d)(?:112|113|115|117|118|1515|1530|1533|114)(?!\d)")
MAILS = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
REACH, EXCERPT = 500, 220
LABELS = {"phone": "📞 **Telefono:**", "email": "📧 **Email:**", "address": "📍 **Indirizzo:**", "schedule": "🕒 **Orari:**", "sources": "🔗 **Maggiori informazioni:**"}
SHARPER = (
    ("orario|orari|quando|apertura|chiusura", "orario di apertura servizio ufficio"),
    ("telefono|numero|contatto|chiamare", "numero di telefono contatto ufficio"),
    ("email|mail|posta|scrivere", "indirizzo email posta elettronica"),
    ("indirizzo|dove|ubicazione|sede", "indirizzo sede ufficio dove si trova"),
)
#: Phrases that don't help to choose a base, in the order in which they go.
VAGUE = ("cos'è|cosa è|che cos'è|che cosa è", "dimmi|spiegami|parlami", "come|quando|dove|perché|perchè", "vorrei sapere|mi puoi dire|puoi dirmi", "iniziativa|progetto|programma", "che|che cosa|quale")


def _name_position(low: Column, name: str) -> Column:
    """Where the name stands (from 0), else the middle of the first two of its words that both stand; null otherwise."""
    at = lambda w: F.instr(low, w) - 1
    parts = name.split()
    out = F.lit(None).cast("int")
    for i in reversed(range(len(parts))):
        for second in reversed(parts[i + 1 :]):
            a, b = at(parts[i]), at(second)
            out = F.when((a >= 0) & (b >= 0), F.floor((a + b) / 2).cast("int")).otherwise(out)
    return F.when(at(name) >= 0, at(name)).otherwise(out)


def near_name(chunks: DataFrame, keys: list[str], text: str, name: str, kind: str, limit: int | None = 10) -> DataFrame:
    """(keys, value, score, excerpt) of the best (null limit: all) phones or mails in chunks that hold words of a name.

    The score is the trigram similarity of chunk and name, and up to 1 for
    nearness within REACH characters. A phone needs all the name's words or
    similarity above 0.2, a mail a word of three letters at least.
    """
    name = name.strip().lower()
    words = name.split()
    rows = chunks.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_low", F.lower("_t"))
    similar = texts.trigram_similarity(F.col("_low"), F.lit(name))
    holds = [F.contains("_low", F.lit(w)) for w in words]
    if kind == "email":
        long = [h for h, w in zip(holds, words, strict=True) if len(w) >= 3]
        ok = reduce(lambda a, b: a | b, long, F.lit(False))
        found = F.regexp_extract_all("_t", F.lit(MAILS), F.lit(0))
    else:
        ok = reduce(lambda a, b: a & b, holds, F.lit(True)) | (similar > 0.2)
        found = F.array_distinct(F.concat(*(F.regexp_extract_all("_t", F.lit(p), F.lit(0)) for p in PHONES)))
    rows = rows.filter(ok).select(*keys, "_t", similar.alias("_sim"), _name_position(F.col("_low"), name).alias("_at"), F.explode(found).alias("_raw"))
    rows = rows.withColumn("_pos", F.instr("_t", F.col("_raw")) - 1)
    value = F.col("_raw")
    if kind != "email":
        value = F.regexp_replace("_raw", r"[\s.\-()]", "")
        around = F.substr(F.col("_t"), F.greatest(F.lit(1), F.col("_pos") - 49), F.lit(200))
        rows = rows.filter(~F.coalesce(markup.unlikely_phone(F.col("_raw"), around), F.lit(False)))
    distance = F.when(F.col("_at").isNotNull() & (F.col("_pos") >= 0), F.abs(F.col("_pos") - F.col("_at"))).otherwise(9999)
    score = F.col("_sim") + F.greatest(F.lit(0.0), 1 - F.least(distance, F.lit(REACH)) / float(REACH))
    scored = rows.select(*keys, value.alias("value"), score.alias("score"), scalars.excerpt(F.col("_t"), F.greatest(F.col("_pos"), F.lit(0)), EXCERPT).alias("excerpt"))
    return scored if limit is None else scored.orderBy(F.desc("score"), *keys, "value").limit(limit)


def answer_types(answer: Column) -> Column:
    """Which contacts an answer shows, by their labels."""
    shown = F.array(*(F.when(F.contains(answer, F.lit(label)), F.lit(kind)) for kind, label in LABELS.items()))
    return F.filter(shown, lambda x: x.isNotNull())


def sharpened(query: Column) -> Column:
    """The query with the words of each intent that it shows."""
    return F.concat_ws(" ", F.trim(query), *(F.when(query.rlike(rf"(?iU)\b(?:{words})\b"), F.lit(more)) for words, more in SHARPER))


def without_vague(query: Column) -> Column:
    """Without phrases that say nothing about a base, quotes and marks; the query itself if fewer than three characters are left."""
    out = query
    for words in VAGUE:
        out = F.regexp_replace(out, rf"(?iU)\b(?:{words})\b", " ")
    out = F.regexp_replace(F.regexp_replace(out, "[\"'`]", ""), "[?.!;,:]", " ")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when(F.length(out) < 3, query).otherwise(out)


def refreshed(rows: DataFrame, fetched: DataFrame, key: str, order: str) -> DataFrame:
    """Versions after a crawl: a known key gets the next number and the new content, others begin at 1; unfetched rows stay.

    ``rows``: key, version, content; ``fetched``: key, content and ``order``, of which the last counts.
    """
    last = fetched.groupBy(key).agg(F.max_by("content", order).alias("_new"))
    both = rows.join(last, key, "full")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("content"))
    return both.select(key, F.when(F.col("version").isNull(), 1).when(changed, F.col("version") + 1).otherwise(F.col("version")).alias("version"), F.coalesce("_new", "content").alias("content"))


def history(rows: DataFrame, key: str, order: str, n: int = 5) -> DataFrame:
    """The last ``n`` rows of every key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
