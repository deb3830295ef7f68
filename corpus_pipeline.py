"""From raw documents to a training mix: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm.decontaminate import drop_contaminated
from pactlens.llm.langid import identify_languages, train_language_model
from pactlens.llm.mixing import emit_copies, mix_sources
from pactlens.llm.neardup import drop_near_duplicates
from pactlens.llm.secrets import BlobLedger, redact, scan_secrets
from pactlens.llm.sparkside import crc_mod, fresh_path, read, unused


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the calibrated threshold rejects go."""
    model = train_language_model(docs, crc_mod("doc_id", 3) != 1)
    return identify_languages(docs, model).filter("lang_accepted").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return drop_near_duplicates(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars as the text then is."""
    found = scan_secrets(docs, BlobLedger(spark, fresh_path(spark, "blob-ledger")))
    clean = unused(found, "clean_text")
    done = found.withColumn(clean, redact(F.col("text"), F.col("secret_spans")))
    n_chars = F.when(F.size("secret_spans") > 0, F.length(clean)).otherwise(F.col("n_chars")).cast("bigint")
    return done.withColumn("n_chars", n_chars).withColumn("text", F.col(clean)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes of a document, with copy_no from 1."""
    return emit_copies(mix_sources(docs)).select(*docs.columns, "copy_no")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("mix", mix),
]

#: Stages one to four are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet in the shared folder and reread as the next one's docs."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
