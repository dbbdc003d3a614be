"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import chain_dedup, decontaminate, hard_negatives, importance, jaccard_join, oracle, ppm, quality_rules, secret_scan, source_mix, suffix_dedup, token_ids, toxicity, warc_fixity
from lattica.llm.common import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = "crc32(cast(doc_id as string)) % 3 = 1"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(f"not ({held_out})"))
    return toxicity.apply(docs, model, held_out)


def op7_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), order=5)


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages against a replica in which some records are altered, lost or added, by a fixed rule."""
    pages = table(spark, sf_dir, "pages")
    rotten = F.when(F.col("page_id") % 97 == 13, F.concat("html", F.lit("\x01"))).otherwise(F.col("html"))
    replica = pages.where("page_id % 211 <> 5").withColumn("html", rotten)
    added = pages.where("page_id % 307 = 11").withColumn("page_id", -F.col("page_id"))
    return warc_fixity.audit(pages, replica.unionByName(added))


def op9_chain_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_dedup.passages(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings")
    return hard_negatives.mine(t.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as files of ids of a public tokenizer, read back."""
    import public_tokenizers

    at = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    token_ids.write(table(spark, sf_dir, "documents"), at, public_tokenizers.path("word_bpe_49k.json"), by_pieces=True)
    return token_ids.digest(spark, at)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_jaccard_join, op2_decontaminate, op3_secret_scan, op4_source_mix, op5_quality_rules, op6_toxicity, op7_ppm_scoring, op8_warc_fixity, op9_chain_dedup, op10_suffix_dedup, op11_importance_resampling, op12_hard_negatives, op13_token_ids, pipeline)
}

ORACLE: dict[str, str] = oracle.ORACLE
