"""Source trees as files with a language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes and the language they stand for.
LANGUAGES = {
    "py": "python",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
}
#: Folders that hold no code of the project's own.
IGNORED = (
    ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "__pycache__", ".mypy_cache", ".ruff_cache", ".pytest_cache", "dist", "build", ".next", ".nuxt",
)


def language_of(path: Column) -> Column:
    suffix = F.regexp_extract(path, r"\.([A-Za-z]+)\z", 1)
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, suffix)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """file (path below root), language, content of every source file outside ignored folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://")[-1].rstrip("/") + "/"
    files = files.withColumn("file", F.substring_index("path", base, -1)).withColumn("language", language_of(F.col("path")))
    skip = F.arrays_overlap(F.split("file", "/"), F.array(*[F.lit(x) for x in IGNORED]))
    return files.filter(F.col("language").isNotNull() & ~skip).select("file", "language", F.col("content").cast("string").alias("content"))
