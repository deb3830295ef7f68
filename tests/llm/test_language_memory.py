"""Fitting a language model leaves little in the driver's memory; a process of its own shows what stays."""

import subprocess
import sys

PROBE = """
import re, sys
import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pactlens.llm import langid

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

langid.EPOCHS = 1
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
word = lambda n: F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.substring(F.sha2(F.concat("id", F.lit("/"), i).cast("string"), 256), 1, 7)))
docs = spark.range(4000).select(F.col("id").alias("doc_id"), word(1200).alias("text"), F.when(F.col("id") % 3 == 0, "de").when(F.col("id") % 3 == 1, "en").otherwise("fr").alias("lang"))
langid.train_language_model(docs.limit(30), F.lit(True))
before = held()
model = langid.train_language_model(docs, F.lit(True))
print("kept", held() - before)
"""


def test_what_the_fit_leaves_behind():
    found = subprocess.run([sys.executable, "-c", PROBE], capture_output=True, text=True, timeout=240)
    assert found.returncode == 0, found.stderr[-2000:]
    assert float(found.stdout.split("kept")[1]) < 32
