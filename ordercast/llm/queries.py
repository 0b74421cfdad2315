"""The operators' registered queries, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordercast.llm import (
    chat_repair,
    decontamination,
    divergence,
    jaccard_join,
    language_id,
    licences,
    merkle,
    packing,
    perplexity,
    rule_quality,
    token_counts,
    toxicity,
    warc,
)
from ordercast.llm.common import documents, fold

BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 5) == 0
    return language_id.predict(docs, docs.where(~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.verdicts(documents(spark, sf_dir))


def op3_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = 1024
    docs = documents(spark, sf_dir)
    measured = docs.select("doc_id", token_counts.token_counts(F.col("text"), BPE, limit).alias("m"))
    return measured.select(
        "doc_id", "m.n_bytes", "m.n_tokens", (F.col("m.n_tokens") > limit).alias("over_limit"), "m.fit_chars"
    )


def op4_fuzzy_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 4) == 2
    labels = documents(spark, sf_dir, "labels").where(~held_out)
    scored = toxicity.scores(documents(spark, sf_dir), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_grouped_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), BPE, capacity=2048)


def op6_sharded_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(documents(spark, sf_dir, "pages"), min_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset")


def op7_minimum_cost_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repaired(documents(spark, sf_dir, "conversations")).drop("position")


def op8_token_group_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = jaccard_join.Threshold(num=90, den=100)
    return jaccard_join.jaccard_components(documents(spark, sf_dir), width=3, rule=rule)


def op9_string_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: a folder for each source, and in it one for each language and thousand ids."""
    block = F.floor(F.col("doc_id") / 1000).cast("string")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), block, F.lit("/"), "doc_id")
    files = documents(spark, sf_dir).select(path.alias("path"), "text")
    name = F.element_at(F.split("path", "/"), -1)
    return licences.licences(files).select(name.cast("long").alias("doc_id"), "*")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified with every fifth text's A-Z in lower case."""
    return merkle.manifest(documents(spark, sf_dir), merkle.tampered(F.col("text"), F.col("doc_id")))


def op13_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 4) == 2
    labels = documents(spark, sf_dir, "labels").where(~held_out)
    scored = rule_quality.scores(documents(spark, sf_dir), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


_PATH = "concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/', CAST(doc_id // 1000 AS VARCHAR), '/', CAST(doc_id AS VARCHAR))"

QUERIES = {
    f.__name__: f
    for f in (
        op1_crf_language_id,
        op2_kneser_ney_quality,
        op3_prefix_token_counts,
        op4_fuzzy_lexicon_toxicity,
        op5_grouped_best_fit_packing,
        op6_sharded_warc_writer,
        op7_minimum_cost_chat_repair,
        op8_token_group_jaccard_join,
        op9_string_tiling_decontamination,
        op10_licence_scan,
        op11_source_divergence,
        op12_merkle_manifest,
        op13_rule_ensemble_quality,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {
    "op10_licence_scan": f"SELECT CAST(string_split(path, '/')[-1] AS BIGINT) AS doc_id, * FROM ({licences.oracle(_PATH, 'documents')})",
    "op8_token_group_jaccard_join": jaccard_join.oracle(),
    "op11_source_divergence": divergence.oracle(),
    "op12_merkle_manifest": merkle.oracle(),
}
