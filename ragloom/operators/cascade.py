"""Answers in stages: each stage is asked only what the ones before it left without an answer."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoints
from . import answers, retrieval
from .text import terms

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def cascade(queries: DataFrame, stages: Sequence[Stage], key: str = "query_id") -> DataFrame:
    """The rows of the first stage that answers each query, with ``stage`` (its name) and ``stage_no`` (from 1).

    A stage gets the rows of ``queries`` that are still open and returns rows
    with ``key``; all stages return the same columns. Results are checkpointed,
    so the next stage's plan reads them and not what made them; open queries are
    kept by an anti join. Queries that no stage answers have no rows; stages
    after the last open query don't run.
    """
    ensure_checkpoints(queries.sparkSession)
    open_, found = queries, []
    for number, (name, answer) in enumerate(stages, 1):
        got = answer(open_).withColumns({"stage": F.lit(name), "stage_no": F.lit(number)}).checkpoint()
        found.append(got)
        if number == len(stages):
            break
        open_ = open_.join(got.select(key).distinct(), key, "left_anti").checkpoint()
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def holding_all(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): the ``k`` best documents that hold all terms of a query, by the terms' occurrences.

    Up to retrieval.BROADCAST_TERMS terms of queries go to the documents; more meet them by a join.
    """
    asked = queries.select("query_id", F.size(terms(F.col("text"), None)).alias("m"), F.explode(terms(F.col("text"), None)).alias("term"))
    if asked.limit(retrieval.BROADCAST_TERMS + 1).count() <= retrieval.BROADCAST_TERMS:
        whole = retrieval.held_top_k(asked, docs, k)
    else:
        hits = retrieval.postings(docs, "doc_id", "text", asked).join(asked, "term")
        whole = hits.groupBy("query_id", "doc_id", "m").agg(F.count("*").alias("held"), F.sum("n").alias("score")).filter("held = m")
    ranked = retrieval.top_k(whole, "query_id", k, F.desc("score"), F.col("doc_id"))
    return ranked.select("query_id", "doc_id", F.col("score").cast("double").alias("score"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, least: float) -> DataFrame:
    """(query_id, doc_id, score): the ``k`` documents whose vectors are nearest, from a cosine of ``least`` on; queries without a vector have none."""
    got = retrieval.vector_top_k(queries.filter("q is not null").select("query_id", "q"), vectors, k)
    return got.filter(F.col("score") >= least).select("query_id", F.col("id").alias("doc_id"), "score")


def any_words(queries: DataFrame, docs: DataFrame, k: int, least: float) -> DataFrame:
    """(query_id, doc_id, score): lexical top-k, from a rank of ``least`` on."""
    got = retrieval.lexical_top_k(queries.select("query_id", "text"), docs, k)
    return got.filter(F.col("score") >= least).select("query_id", "doc_id", "score")


def by_patterns(queries: DataFrame, docs: DataFrame, patterns: Sequence[str], k: int = 10, score: float = 0.8) -> DataFrame:
    """(query_id, doc_id, score): the ``k`` documents that hold the earliest of the patterns (lower case), newest first; the same for every query."""
    low = F.lower("text")
    order = F.coalesce(*(F.when(F.contains(low, F.lit(p)), F.lit(i)) for i, p in enumerate(patterns)))
    best = docs.select("doc_id", order.alias("place")).filter("place is not null").orderBy("place", F.desc("doc_id")).limit(k)
    return queries.select("query_id").join(F.broadcast(best.select("doc_id")), how="cross").withColumn("score", F.lit(score))  # at most k rows


def execute_intent(queries: DataFrame, docs: DataFrame, vectors: DataFrame, *, k: int = 5, least_cosine: float = 0.0, least_rank: float = 0.0, patterns: Sequence[str] = ()) -> DataFrame:
    """(query_id, doc_id, score, stage, stage_no): the specific search, else the semantic one, else any words, else what patterns find in the table.

    ``queries``: query_id, text, q (a vector or null); ``docs``: doc_id, text;
    ``vectors``: id (a document's), v.
    """
    known = docs.select("doc_id", "text")
    stages: list[Stage] = [
        ("specific", lambda left: holding_all(left, known, k)),
        ("semantic", lambda left: nearest(left, vectors, k, least_cosine)),
        ("text", lambda left: any_words(left, known, k, least_rank)),
        ("database", lambda left: by_patterns(left, known, patterns)),
    ]
    return cascade(queries, stages if patterns else stages[:-1])


def entity_name(query: Column, intent: str, removals: Sequence[str] = answers.REMOVALS) -> Column:
    """The name that a query is about: lower-cased, without marks, phrases (longest first) and the words of its intent, in single spaces; empty if nothing is left."""
    phrases = dict.fromkeys((*sorted(removals, key=lambda p: -len(p)), *answers.NAMED_BY.get(intent, ())))
    out = F.regexp_replace(F.lower(F.trim(query)), "[?.!,:;\\-\"'`“”’]", " ")
    words = "|".join("\\Q" + p + "\\E" for p in phrases)
    out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])", " ") if phrases else out
    return F.trim(F.regexp_replace(out, r"\s+", " "))
