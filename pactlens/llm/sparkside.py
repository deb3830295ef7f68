"""Small Spark helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.functions.lineage import cut, shared_dir  # noqa: F401
from pactlens.functions.lineage import scratch as fresh_path  # noqa: F401


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(id_column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % mod


def unused(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
