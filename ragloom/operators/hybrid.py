"""Hybrid retrieval: lexical and vector lists fused, limited to a base, boosted, cut, with a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import answers, retrieval


def hybrid(queries: DataFrame, docs: DataFrame, vectors: DataFrame, *, k: int = 10, top: int = 5, boosts: answers.Boosts = answers.Boosts(), within: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank, confidence) of the best documents of every query.

    ``queries``: query_id, text, q; ``docs``: doc_id, title, text, source;
    ``vectors``: id (a document's), v. Both lists have ``k`` hits, fused by
    reciprocal ranks; hits without a document, or outside ``within``, go. The
    confidence is ten times the sum of the query's three best scores, 1 at most.
    """
    words = retrieval.lexical_top_k(queries.select("query_id", "text"), docs.select("doc_id", "text"), k).select("query_id", "doc_id", "rank")
    near = retrieval.vector_top_k(queries.filter("q is not null").select("query_id", "q"), vectors, k).select("query_id", F.col("id").alias("doc_id"), "rank")
    fused = retrieval.fuse(words.unionByName(near))
    known = docs if within is None else docs.filter(within)
    hits = fused.join(known.select("doc_id", "title", "source"), "doc_id").join(queries.select("query_id", F.col("text").alias("asked")), "query_id")
    hits = hits.withColumn("score", F.round(answers.boosted(F.col("score"), F.coalesce("source", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("asked", F.lit("")), boosts), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    sure = F.sum(F.when(F.col("rank") <= 3, F.col("score"))).over(Window.partitionBy("query_id"))
    return best.select("query_id", "doc_id", "score", "rank", F.round(F.least(F.lit(1.0), 10 * sure), 6).alias("confidence"))
