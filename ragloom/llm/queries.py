"""The registered queries of the numbered operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from . import ann, bpe, divergence, jaccard, language_id, mixing, near_vectors, pii, quality, suffixes, toxicity, trie, whitening
from .util import crc_mod


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = language_id.detect(docs, language_id.learn(docs))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(load(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    ids = ids.withColumn("ids_sha256", F.sha2("ids", 256))
    return bpe.decode(ids, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = quality.score(docs, quality.learn(docs, load(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.learn(docs, load(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages")
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(load(spark, sf_dir, "documents")))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op2_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(load(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors.link(load(spark, sf_dir, "embeddings")).withColumnRenamed("component", "component_id")
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(load(spark, sf_dir, "documents")).withColumnRenamed("component", "component_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove(load(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = divergence.judge(docs, divergence.learn(docs))
    return found.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(load(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load(spark, sf_dir, "embeddings"))


QUERIES = {
    "op11_divergence_rules": op11_divergence_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_whitening": op13_whitening,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op2_additive_ann": op2_additive_ann,
    "op9_near_vectors": op9_near_vectors,
    "op5_pii": op5_pii,
    "op6_source_mix": op6_source_mix,
    "op1_quality_fm": op1_quality_fm,
    "op8_toxicity_segments": op8_toxicity_segments,
    "op10_byte_bpe": op10_byte_bpe,
    "op4_language_id": op4_language_id,
}

ORACLE: dict[str, str] = {
    "op11_divergence_rules": divergence.ORACLE_SQL,
    "op12_prefix_trie": trie.ORACLE_SQL,
    "op5_pii": pii.ORACLE_SQL,
    "op6_source_mix": mixing.ORACLE_SQL,
}
