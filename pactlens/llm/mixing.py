"""Mixing sources to target weights by whole repetitions plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlens.llm.sparkside import cut, read, unused

#: Up to so many sources their targets are broadcast (under 100 bytes each); beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)


def token_count(text: Column) -> Column:
    """Runs without blanks; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Target tokens of each source, from sizes(source, size).

    Returns source, source_size, target, rate.  Sources in ascending code-point order, null last,
    weigh weights[0], weights[1], ..., repeating, and share the total size.  No target is above
    max_repeats times its source's size; what that frees is shared by weight among the others until
    none is above.  Written as one level: with sources ordered by cap over weight, the level of
    those from the i-th on is (total - caps before) / (weight - weights before), and the largest
    level that its own source can take is the one that holds.  One row per source goes through the
    window; documents never do.  Sources without tokens get a target and a rate of 0.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * max_repeats)
    everyone = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (
        F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ).cast("double")
    levels = ranked.withColumn("level", level)
    holds = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everyone)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(holds, F.lit(0.0)))
    return (
        levels.withColumn("target", target)
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .select("source", "source_size", "target", "rate")
    )


def uniform_draw(identity: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the identity and the seed only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), identity)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4503599627370496.0)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: str = "mix-0",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes each document.

    copies is floor(rate) plus one with probability of the rate's fraction, drawn from a hash of the
    seed and the id, so reruns agree.  Rows that share an id share a draw; rows without an id draw
    by their text.  Null texts have size 0; a null source is a source of its own, last in order.
    An empty table gives an empty result.  Columns of docs are kept, whatever their names; only
    ones named like the four added columns are replaced.
    """
    added = ("size", "source_size", "target", "copies")
    docs = docs.drop(*[c for c in docs.columns if c in added])
    sized = docs.withColumn("size", token_count(F.col(text_col)))
    sizes = sized.select(F.col(source_col).alias("source"), "size")
    of, rate = unused(docs, "target_source"), unused(docs, "target_rate")
    targets = cut(source_targets(sizes, weights, max_repeats)).withColumnsRenamed({"source": of, "rate": rate})
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    identity = F.coalesce(
        F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    )
    whole = F.floor(rate)
    copies = whole + F.when(uniform_draw(identity, seed) < F.col(rate) - whole, 1).otherwise(0)
    mixed = sized.join(targets, F.col(source_col).eqNullSafe(F.col(of)))
    return mixed.withColumn("copies", copies.cast("bigint")).drop(of, rate)


def emit_copies(mixed: DataFrame, number_col: str = "copy_no") -> DataFrame:
    """One row per copy that the mix takes, numbered from 1; documents not taken give none."""
    return mixed.filter("copies > 0").withColumn(number_col, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix_sources(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, text, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, source_size * 3 AS cap,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM by_source
), levels AS (
  SELECT *,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE)
           / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM ranked
  WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), held AS (
  SELECT *, max(CASE WHEN level <= cap / weight THEN level END) OVER () AS hold FROM levels
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * coalesce(hold, 0.0)) AS target FROM held
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix-0:' || coalesce(CAST(s.doc_id AS VARCHAR), 'text:' || md5(coalesce(s.text, '')))), 1, 13) AS BIGINT) AS DOUBLE)
           / 4503599627370496.0 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""
