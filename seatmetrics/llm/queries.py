"""The numbered queries: each applies one operator to a whole table and derives the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatmetrics.llm import bpe, cosine, decontaminate, langid, licenses, lm, minhash, negatives, resample, token_counts, token_files, warc
from seatmetrics.llm import secrets as secret_scans


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rounded = [(F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c) for c in ("log_score", "mean_log_score")]
    return scored.select("doc_id", "n_words", *rounded)


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    root, manifest = warc.archive(pages)
    return warc.resolved(warc.read_archive(spark, root, manifest, with_payload=False).drop("payload", "url"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = secret_scans.scan_secrets(docs).drop("text")
    base = [r.kind for r in secret_scans.BASE_RULES]

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base_spans = F.filter("findings", lambda x: x["kind"].isin(base))
    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(secret_scans.span_text(base_spans), 256).alias("base_sha256"),
        secret_scans.span_text(F.col("findings")).alias("spans"),
        F.col("blob_id"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    root, manifest = token_files.tokenize_to_files(docs)
    return token_files.read_documents(spark, root, manifest)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate.find_leaks(docs, items, settings=decontaminate.PASSAGES)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()).select("text", "lang"))
    named = langid.predict(docs.select("doc_id", "text"), model)
    return named.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample.resample(docs, target)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector has a wrong label, every fiftieth is an anchor."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_lm_scores,
        op2_warc_archive,
        op3_license_scans,
        op4_secret_scans,
        op5_token_files,
        op6_minhash,
        op7_byte_bpe,
        op8_decontamination,
        op9_language_id,
        op10_near_vectors,
        op11_token_counts,
        op12_importance_resampling,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in every}
