"""Keyed writes as joins: insert-if-absent, upserts and partial updates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming whose key is new, one per key; null keys compare equal."""
    fresh = incoming.dropDuplicates(keys)
    return fresh.alias("n").join(existing.select(*keys).alias("o"), _same(keys), "left_anti")


def insert_counts(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """total, inserted, skipped in one row."""
    total = incoming.agg(F.count("*").alias("total"))
    new = insert_absent(existing, incoming, keys).agg(F.count("*").alias("inserted"))
    return total.join(new).select("total", "inserted", (F.col("total") - F.col("inserted")).alias("skipped"))


def merge_by_key(existing: DataFrame, incoming: DataFrame, keys: list[str], resolve: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Full outer merge; resolve[column](old, new) decides each other column where both sides may be null.

    Columns without a rule take the new value where the key is in incoming, else the old one; those
    that incoming lacks keep the old one.
    """
    old, new = existing.withColumn("__o", F.lit(True)).alias("o"), incoming.withColumn("__n", F.lit(True)).alias("n")
    joined = old.join(new, _same(keys), "full_outer")
    there = F.col("n.__n").isNotNull()
    columns = [F.when(there, F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in keys]
    for c in existing.columns:
        if c in keys:
            continue
        a = F.col(f"o.{c}")
        b = F.col(f"n.{c}") if c in incoming.columns else F.lit(None).cast(existing.schema[c].dataType)
        default = (lambda x, y: F.when(there, y).otherwise(x)) if c in incoming.columns else (lambda x, y: x)
        columns.append(resolve.get(c, default)(a, b).alias(c))
    return joined.select(*columns)


def patch(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of base with the non-null columns of changes laid over them."""
    columns = [c for c in base.columns if c not in keys]
    joined = base.alias("o").join(changes.alias("n"), _same(keys), "left")
    picked = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in changes.columns else F.col(f"o.{c}") for c in columns]
    return joined.select(*[F.col(f"o.{k}") for k in keys], *picked)


def latest_per_group(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__rank = 1").drop("__rank")


def newest_first(rows: DataFrame, created_at: str, key: str) -> DataFrame:
    """rows in the order of a list view: latest first, those without a time last, then by key."""
    return rows.orderBy(F.desc_nulls_last(created_at), key)
