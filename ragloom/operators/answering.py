"""From questions to cited context: lists, fusion, boosts, reranking, diversity, neighbours, gating."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoints
from . import answers, assembly, ranking, retrieval

#: Documents hold fewer chunks than this: a chunk's key is document times it plus index.
CHUNKS = 100_000


@dataclass(frozen=True)
class Plan:
    """How many go from step to step, and when an answer gives way.

    ``k``: hits of each list; ``reranked``: hits that are scored again by
    ``driver``; ``shown``: citations after diversity (of the weight
    ``relevance``); ``radius``: neighbours of a citation; ``own``, ``other``:
    characters of a candidate and of its neighbours when it is scored.
    """

    k: int = 30
    reranked: int = 20
    shown: int = 5
    relevance: float = 0.3
    radius: int = 1
    own: int = 300
    other: int = 200
    driver: str = "embedding"
    boosts: answers.Boosts = field(default_factory=answers.Boosts)
    least_citations: int = 1
    least_confidence: float = 0.05
    force: bool = True


def candidates(queries: DataFrame, chunks: DataFrame, docs: DataFrame, plan: Plan, within: Column | None) -> tuple[DataFrame, DataFrame]:
    """Fused and boosted hits (query_id, id, doc_id, chunk_index, score, rank), and (query_id, confidence) of what was fused."""
    keyed = chunks.withColumn("id", F.col("doc_id") * CHUNKS + F.col("chunk_index"))
    words = retrieval.lexical_top_k(queries.select("query_id", "text"), keyed.select(F.col("id").alias("doc_id"), "text"), plan.k).select("query_id", "doc_id", "rank")
    near = retrieval.vector_top_k(queries.filter("q is not null").select("query_id", "q"), keyed.filter("v is not null").select("id", "v"), plan.k)
    fused = retrieval.fuse(words.unionByName(near.select("query_id", F.col("id").alias("doc_id"), "rank"))).select("query_id", F.col("doc_id").alias("id"), "score")
    known = docs if within is None else docs.filter(within)
    hits = fused.withColumn("doc_id", F.floor(F.col("id") / CHUNKS).cast("long")).join(known.select("doc_id", "title", "source"), "doc_id").join(queries.select("query_id", F.col("text").alias("asked")), "query_id")
    boosted = answers.boosted(F.col("score"), F.coalesce("source", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("asked", F.lit("")), plan.boosts)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    hits = hits.withColumn("score", F.round(boosted, 9)).withColumn("rank", F.row_number().over(order))
    sure = hits.filter("rank <= 3").groupBy("query_id").agg(F.round(F.least(F.lit(1.0), 10 * F.sum("score")), 6).alias("confidence"))
    return hits.filter(F.col("rank") <= plan.reranked).select("query_id", "id", "doc_id", (F.col("id") % CHUNKS).cast("int").alias("chunk_index"), "score", "rank"), sure


def reranked(hits: DataFrame, queries: DataFrame, chunks: DataFrame, plan: Plan, scorers: dict[str, assembly.Scorer] | None = None) -> DataFrame:
    """The hits scored again by their text and its neighbours, with q and v; only chunks of documents that were hit are read into context."""
    there = chunks.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    seen = assembly.with_neighbours(there, "doc_id", "chunk_index", "text", plan.radius, own=plan.own, other=plan.other).select("doc_id", "chunk_index", F.col("context").alias("text"), "v")
    rows = hits.drop("rank").join(seen, ["doc_id", "chunk_index"]).join(queries.select("query_id", F.coalesce("text", F.lit("")).alias("query"), "q"), "query_id")
    return assembly.rerank_with(plan.driver, rows, {"embedding": assembly.by_embedding, **(scorers or {})}, plan.reranked)


def diverse(ranked: DataFrame, plan: Plan) -> DataFrame:
    """The citations (query_id, id, position): the most relevant that differ; those that have no vector to compare follow by rank."""
    able = F.col("q").isNotNull() & F.col("v").isNotNull()
    chosen = ranking.mmr(ranked.filter(able).select("query_id", "id", "q", "v", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("rank")), plan.shown, plan.relevance)
    rest = ranked.filter(~able).select("query_id", "id", (F.col("rank") + (1 << 20)).cast("long").alias("position"))
    both = chosen.unionByName(rest)
    return both.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).filter(F.col("position") <= plan.shown)


def answer(queries: DataFrame, chunks: DataFrame, docs: DataFrame, plan: Plan = Plan(), *, within: Column | None = None, scorers: dict[str, assembly.Scorer] | None = None) -> DataFrame:
    """A row for each citation of each query, and one without a citation for queries that have none.

    ``queries``: query_id, text, q (a vector or null); ``chunks``: doc_id,
    chunk_index, text, v (or null); ``docs``: doc_id, title, source. Columns:
    query_id, position (null without), doc_id, chunk_index, title, score (of
    reranking), context (the chunk, then its neighbours), citations, confidence
    and ``falls_back``: whether the stock message takes the answer's place.
    Chunks without a document, or outside ``within``, are never cited; a chunk
    is cited once.
    """
    ensure_checkpoints(queries.sparkSession)
    hits, sure = candidates(queries, chunks, docs, plan, within)
    ranked = reranked(hits, queries, chunks, plan, scorers).checkpoint()
    cited = diverse(ranked, plan).join(ranked.select("query_id", "id", "doc_id", "chunk_index", F.round("score", 6).alias("score")), ["query_id", "id"])
    there = chunks.join(cited.select("doc_id").distinct(), "doc_id", "left_semi")
    context = assembly.with_neighbours(there, "doc_id", "chunk_index", "text", plan.radius).select("doc_id", "chunk_index", "context")
    rows = cited.join(context, ["doc_id", "chunk_index"]).join(docs.select("doc_id", "title"), "doc_id")
    counts = rows.groupBy("query_id").agg(F.count("*").alias("citations"))
    gate = queries.select("query_id").join(counts, "query_id", "left").join(sure, "query_id", "left")
    gate = gate.select("query_id", F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    gate = gate.withColumn("falls_back", answers.falls_back(F.col("citations"), F.col("confidence"), least_citations=plan.least_citations, least_confidence=plan.least_confidence, force=plan.force))
    return gate.join(rows, "query_id", "left").select("query_id", "position", "doc_id", "chunk_index", "title", "score", "context", "citations", "confidence", "falls_back")
