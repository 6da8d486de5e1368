"""Five training-data stages over ``documents``; each reads what the stage before it kept.

Every stage but the last returns the columns of its input. A rejected or duplicate document is left out, a secret is
replaced by a mark in the text that later stages read, and the last stage counts and digests each kept document's
token ids.

Defined results of all stages: null texts, texts without a letter and texts unlike every labelled language leave in
the first stage, and a table without labels loses only the first two; rows that repeat an id are judged one by one, and
only those of one id and text stay or go together; a row without id goes if its group has a row with one; an empty table
stays empty; further columns pass through unchanged, whatever their names, unless they start with ``_secret`` or ``_near``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatmetrics.llm import bpe, decontaminate, langid, minhash
from seatmetrics.llm import secrets as secret_scans
from seatmetrics.llm.shared import settle

#: Stages on word shingles take five words and a similarity of 0.8.
SHINGLES = minhash.Settings(width=5, above=80, below=100)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn languages from labelled documents, and leave out texts in none of them.

    These are null texts, texts without a letter, and those whose language is unsure while their nearest codeword is
    farther than that of any held-out labelled text (``Model.far``). Without labels only the first two leave.
    """
    model = langid.fit(docs.where(~langid.held_out()).select("text", "lang"))
    return langid.without_unknown(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group; a row is known by its id and its text, so another text of that id is no victim."""
    marked = minhash.near_duplicates(docs.select("doc_id", "text"), settings=SHINGLES)
    dropped = marked.where("NOT kept AND component_id IS NOT NULL AND text_key IS NOT NULL").select(F.col("doc_id").alias("_near_id"), F.col("text_key").alias("_near_text")).distinct()
    dropped = settle(dropped, "near-dropped")
    if dropped.count() <= SHINGLES.broadcast_rows:  # 16 bytes each
        dropped = F.broadcast(dropped)
    own = docs.withColumn("_near_key", F.xxhash64("text"))
    left = own.join(dropped, own["_near_key"].eqNullSafe(F.col("_near_text")) & own["doc_id"].eqNullSafe(F.col("_near_id")), "left_anti")
    return left.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold a benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), settings=decontaminate.PASSAGES)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every found secret in the text by a mark."""
    found = secret_scans.scan_secrets(docs, names=("_secret_id", "_secrets"))
    any_found = F.size("_secrets") > 0
    text = secret_scans.redacted(F.col("text"), F.col("_secrets"))
    length = F.when(any_found, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("text", text).withColumn("n_chars", length).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes decoded from them."""
    return bpe.round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]
#: SQL cannot express the stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's rows are written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
