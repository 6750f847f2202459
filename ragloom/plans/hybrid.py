"""Hybrid retrieval and the five-factor source score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answering, answers, hybrid, text
from .registry import _LEX, add, add_derived, add_many, spread

_BOOSTS = answers.Boosts(base=1.1, upload=1.5, locations={"that": 1.2})


def _hybrid(b, d, v):
    vectors = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    queries = b.select(F.col("item_id").alias("query_id"), "text").join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id", "left")
    docs = d.select("doc_id", F.lit(None).cast("string").alias("title"), "text", F.when(F.col("source") == "books", "upload").otherwise(F.col("source")).alias("source"))
    return hybrid.hybrid(queries, docs, vectors, boosts=_BOOSTS, within=F.col("source") != "web")


add_many("R15_hybrid", ["benchmark", "documents", "embeddings"], _hybrid, _LEX + """, vec AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id,
    round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS score
    FROM embeddings q JOIN benchmark ON q.vec_id = item_id JOIN embeddings v ON q.vec_id <> v.vec_id)),
fu AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)::DOUBLE), 9) AS score FROM (SELECT query_id, doc_id, rank FROM lex UNION ALL SELECT query_id, doc_id, rank FROM vec WHERE rank <= 10) GROUP BY 1, 2),
bo AS (SELECT query_id, doc_id, round(score * 1.1::DOUBLE * CASE WHEN source = 'books' THEN 1.5 ELSE 1 END::DOUBLE * CASE WHEN contains(lower(b.text), 'that') THEN 1.2 ELSE 1 END::DOUBLE, 9) AS score FROM fu JOIN documents USING (doc_id) JOIN benchmark b ON query_id = item_id WHERE source <> 'web'),
be AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS "rank" FROM bo)
SELECT query_id, doc_id, score, "rank", round(least(1.0, 10 * sum(CASE WHEN "rank" <= 3 THEN score END) OVER (PARTITION BY query_id)), 6) AS confidence FROM be WHERE "rank" <= 5""")

def _answered(b, d, v):
    """Items of ``benchmark`` as questions over chunks of ``documents``; a document's first chunk has its vector."""
    chunks = text.hard_chunks(d.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", 1_500, 200).select("doc_id", "chunk_index", F.col("content").alias("text"))
    vectors = v.select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.col("embedding").cast("array<double>").alias("v")).dropDuplicates(["doc_id"])
    queries = b.select(F.col("item_id").alias("query_id"), "text").join(vectors.select(F.col("doc_id").alias("query_id"), F.col("v").alias("q")), "query_id", "left")
    docs = d.select("doc_id", F.concat(F.lit("Document "), F.col("doc_id")).alias("title"), F.when(F.col("source") == "books", "upload").otherwise(F.col("source")).alias("source"))
    found = answering.answer(queries, chunks.join(vectors, ["doc_id", "chunk_index"], "left"), docs, answering.Plan(boosts=_BOOSTS, least_confidence=0.2, least_citations=3, force=False), within=F.col("source") != "web")
    return found.withColumn("context", F.md5("context"))


add_many("R15_answered", ["benchmark", "documents", "embeddings"], _answered, None)

_RATED = """SELECT * FROM (VALUES (1, 1, 0.9, 'Orari: telefono 06 1234567 e email info@example.org in via Roma 1, 9:00 - 12:00.', 'Orari', 'Orari ufficio comune', 'https://www.comune.example.org/uffici/orari', 'pdf', '06 1', 'i@e.org', NULL, '9-12'),
    (1, 2, 0.5, 'Testo breve', NULL, NULL, NULL, 'txt', NULL, NULL, NULL, NULL), (1, 3, NULL, '- uno\n- due', 'x', 'Informazioni utili', 'https://a.example.gov/x', NULL, NULL, NULL, 'via Roma', NULL)) AS t(q, position, score, text, snippet, title, url, kind, phone, email, address, schedule)"""
_RATED_CASES = spread(_RATED.replace("t(q, position,", "t(q, id,"), 3, "score text snippet title url kind phone email address schedule", "documents", "doc_id", "text")
_RATED_BY = f"SELECT id % 97 AS q, CAST((id - id % 97) / 97 + 1 AS INT) AS position, score, text, snippet, title, url, kind, phone, email, address, schedule FROM ({_RATED_CASES})"
_M = lambda p, c="text", w=0.1: f"CASE WHEN regexp_matches(coalesce({c}, ''), '{p}') THEN {w} ELSE 0 END"
_FILLED = " + ".join(f"(coalesce({c}, '') <> '')::INT" for c in ("phone", "email", "address", "schedule"))
add_derived("QS3_source_score", {"c": _RATED_BY}, lambda c: c.select("q", "position", F.round(answers.five_factors(), 6).alias("score")), f"""SELECT q, position, round((coalesce(score, 0)::DOUBLE * 0.35::DOUBLE
    + least(1.0, CASE WHEN length(text) > 800 THEN 0.3 WHEN length(text) > 400 THEN 0.2 WHEN length(text) > 200 THEN 0.1 ELSE 0 END + CASE WHEN length(coalesce(snippet, '')) > 150 THEN 0.2 ELSE 0 END + CASE WHEN length(coalesce(title, '')) > 10 THEN 0.2 ELSE 0 END
        + {_M(answers.LISTED, w=0.15)} + {_M(answers.CONTACT, w=0.15)})::DOUBLE * 0.25::DOUBLE
    + least(1.0, ({_FILLED}) * 0.25 + CASE WHEN {_FILLED} >= 2 THEN 0.1 ELSE 0 END + {' + '.join(_M(p) for p in answers.SIGNS)})::DOUBLE * 0.2::DOUBLE
    + greatest(0, least(1.0, {_M(answers.HOSTS, 'url', 0.4)} + CASE kind WHEN 'pdf' THEN 0.2 WHEN 'doc' THEN 0.15 WHEN 'docx' THEN 0.15 WHEN 'txt' THEN 0.1 WHEN 'md' THEN 0.1 ELSE 0 END + {_M('/[^/]+/[^/]+', 'url', 0.15)} + {_M(answers.OFFICES, 'title', 0.15)} - CASE WHEN length(coalesce(url, '')) > 150 THEN 0.1 ELSE 0 END))::DOUBLE * 0.15::DOUBLE
    + greatest(0, 1 - (position - 1) / greatest(1, n - 1)::DOUBLE)::DOUBLE * 0.05::DOUBLE), 6) AS score FROM (SELECT *, count(*) OVER (PARTITION BY q) AS n FROM c)""")
_MESSAGES = 10
add("QS7_conversation_context", "conversations", lambda c: answers.conversation_context(c, "conv_id", "turn", "role", "text", most=_MESSAGES).select("conv_id", "turn", "messages", F.md5("context").alias("digest")), """
    WITH m AS (SELECT conv_id, turn, role, trim(coalesce(text, '')) AS t FROM conversations),
    p AS (SELECT a.conv_id, a.turn, b.turn AS place, b.role, b.t, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS r FROM (SELECT * FROM m WHERE role = 'user') a JOIN m b ON a.conv_id = b.conv_id AND b.turn < a.turn)
    SELECT conv_id, turn, count(*)::INT AS messages, md5(string_agg(role || ': ' || CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END, chr(10) ORDER BY place)) AS digest FROM p WHERE r <= 10 AND role IN ('user', 'assistant') AND t <> '' AND NOT starts_with(t, 'Contesto della knowledge base') GROUP BY 1, 2""")
