"""From ranked hits to what is shown: neighbours, candidate texts, embedding scores, base selection, complete retrieval, trigrams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from .retrieval import dot, norm

# They must equal those of existing deployments.
STOP_WORDS = ("il", "la", "di", "del", "della", "e", "un", "una", "per", "con", "da", "in", "su", "a", "al", "alla")
WEIGHTY = ("orario", "telefono", "email", "indirizzo", "ufficio", "servizio", "polizia", "vigili", "comune", "municipio")


def with_neighbours(chunks: DataFrame, doc: str, index: str, text: str, radius: int, *, own: int | None = None, other: int | None = None) -> DataFrame:
    """``chunks`` with ``context``: the text, and below it those of chunks up to ``radius`` away, in order.

    ``own`` and ``other`` cut either to so many characters. A document's chunks
    meet in one window of a bounded range; empty neighbours are left out.
    """
    cut = lambda c, n: c if n is None else F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)
    around = Window.partitionBy(doc).orderBy(index).rangeBetween(-radius, radius)
    near = F.collect_list(F.struct(F.col(index).alias("i"), cut(F.coalesce(F.col(text), F.lit("")), other).alias("t"))).over(around)
    rows = chunks.withColumn("_near", F.sort_array(near))
    parts = F.transform(F.filter("_near", lambda x: (x["i"] != F.col(index)) & (x["t"] != "")), lambda x: x["t"])
    return rows.withColumn("context", F.array_join(F.concat(F.array(cut(F.coalesce(F.col(text), F.lit("")), own)), parts), "\n")).drop("_near")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _words(text: Column) -> Column:
    """Lower-cased words of three characters or more that are no stop words."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))


def keywords(text: Column) -> Column:
    """Distinct words of three characters or more that are no stop words, with their weights: occurrences times 1, 1.3 if long, 0.5 more if weighty."""
    weight = lambda w: F.lit(1.0) + F.when(F.length(w) >= 6, 0.3).otherwise(0.0) + F.when(w.isin(*WEIGHTY), 0.5).otherwise(0.0)
    return _let(_words(text), lambda words: F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("word"), (F.size(F.filter(words, lambda x: x == w)) * weight(w)).alias("weight"))))


def coverage(query: Column, text: Column) -> Column:
    """Share of the query's keyword weight that stands in the text, 0.7 of a weight for a similar word; one half without keywords."""

    def share(asked: Column, there: Column) -> Column:
        part = lambda k: F.when(F.array_contains(there, k["word"]), k["weight"]).when(F.exists(there, lambda t: scalars.similar_words(k["word"], t)), k["weight"] * 0.7).otherwise(0.0)
        total = F.aggregate(asked, F.lit(0.0), lambda s, k: s + k["weight"])
        return F.when(F.size(asked) == 0, 0.5).otherwise(F.aggregate(asked, F.lit(0.0), lambda s, k: s + part(k)) / total)

    both = F.struct(keywords(query).alias("asked"), F.array_distinct(_words(text)).alias("there"))
    return _let(both, lambda x: share(x["asked"], x["there"]))


def length_factor(text: Column) -> Column:
    """Best from 100 to 500 characters."""
    n = F.length(text)
    return F.when(n < 50, 0.7).when(n < 100, 0.9).when(n == 100, 0.9).when(n <= 500, 1.0).when(n <= 800, 0.95).otherwise(0.8)


def embedding_score(query: str, text: str, q: str, v: str, score: str) -> Column:
    """0.8 of (0.7 cosine, 0.2 coverage, 0.1 length) and 0.2 of the score so far; without a vector 0 takes the place of the first part."""
    new = dot(q, v) / (norm(q) * norm(v)) * 0.7 + coverage(F.col(query), F.col(text)) * 0.2 + length_factor(F.col(text)) * 0.1
    return F.when(F.coalesce(F.size(v), F.lit(0)) > 0, new).otherwise(0.0) * 0.8 + F.coalesce(score, F.lit(0.0)) * 0.2


#: A scorer takes candidates with query, text, q, v and score, and gives the same rows with their new score.
Scorer = Callable[[DataFrame], DataFrame]


def by_embedding(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("score", embedding_score("query", "text", "q", "v", "score"))


def by_judgement(answer: str) -> Scorer:
    """By a model's answer in a column: its first whole number, up to 100, as a share; 50 where it has none."""
    return lambda candidates: candidates.withColumn("score", F.get(scalars.scores(F.coalesce(answer, F.lit("")), 1), 0) / 100)


def rerank_with(driver: str, candidates: DataFrame, scorers: dict[str, Scorer], top: int) -> DataFrame:
    """The ``top`` candidates of each query by the named scorer; an unknown name leaves scores as they are."""
    scored = scorers.get(driver, lambda c: c)(candidates)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def best_base(hits: DataFrame, base: str, boost: Column, queries: DataFrame, default: str) -> DataFrame:
    """(query_id, base, score): the base with the largest sum of boosted scores, ties by name; ``default`` for a query without hits."""
    sums = hits.groupBy("query_id", base).agg(F.sum(F.col("score") * boost).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), base)
    best = sums.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("query_id", F.col(base).alias("base"), "score")
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("base", F.lit(default)).alias("base"), F.coalesce("score", F.lit(0.0)).alias("score"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Common trigrams over all; 0 without any."""
    x, y = trigrams(a), trigrams(b)
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, F.size(F.array_intersect(x, y)) / every).otherwise(0.0)
