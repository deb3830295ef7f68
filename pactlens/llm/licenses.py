"""License scans by diagonal voting, in DataFrame operations only.

All rolling three-word hashes of the documents are joined to their positions in license templates.
A hit votes for the diagonal (document position minus template position); votes are gathered by
document, template and diagonal, and diagonals close to each other are merged.  A span is then held
against the document: words left out and words put in count against it, the words that tell its
license from others must be as they should, and of competing spans the best is kept.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlens.llm.sparkside import read

K = 3
#: Diagonals of one template at most so many words apart are one span (words put in or left out).
DRIFT = 6
#: A span of a template that is not exact gives its label from this coverage on.
MIN_COVERAGE = 0.6

#: Phrases whose exact, consecutive words give a base label.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: License texts and notices, as published; matched with tolerance.
TEMPLATES = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
    ),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
    ),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software""",
    ),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
)

_COMMERCIAL, _ALIKE = ("noncommercial", "commercial"), ("sharealike", "alike")
_DERIVATIVES = ("noderivatives", "noderivs", "derivatives", "derivs")
_OTHER_GPL = ("lesser", "library", "affero")
#: What tells a license from others: words of which a span has one at least, words of which it has
#: none, and the first number in it ("" for any).
MARKS = {
    "apache-2": (("apache",), (), "2"),
    "gpl": (("gnu",), _OTHER_GPL, ""),
    "gpl-3": (("gnu",), _OTHER_GPL, "3"),
    "mpl-2": (("mozilla",), (), "2"),
    "cc-by-nc": (_COMMERCIAL, _ALIKE + _DERIVATIVES, ""),
    "cc-by-sa": (_ALIKE, _COMMERCIAL + _DERIVATIVES, ""),
    "cc-by": ((), _COMMERCIAL + _ALIKE + _DERIVATIVES, ""),
}

#: After lower-casing the same runs as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, which Java matches many times slower.
_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def license_words(text: Column) -> Column:
    """Words of the whole text with A-Z lower-cased; null counts as empty.

    lower() also changes letters beyond ASCII, which no template has, but for two letters whose lower
    case is ASCII; texts with those are translated letter by letter.
    """
    text = F.coalesce(text, F.lit(""))
    odd = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    low = F.when(odd, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))


def _gram_hashes(words: Column) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - K)
    grams = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(K)]))
    return F.when(F.size(words) >= K, grams)


def _template_grams(spark: SparkSession, base, templates) -> DataFrame:
    """Every three-word run of every template: template, label, base, length, t_pos, t_words, hash."""
    short = [text for _, text in (*base, *templates) if len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)) < K]
    if short:
        raise ValueError(f"phrases and templates have {K} words or more: {short}")
    rows = [(n, label, n < len(base), text) for n, (label, text) in enumerate((*base, *templates))]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, text string")
    table = table.withColumn("words", license_words(F.col("text")))
    return table.select(
        "template", "label", "base", F.size("words").alias("length"), F.posexplode(_gram_hashes(F.col("words"))).alias("t_pos", "hash"), "words"
    ).select("template", "label", "base", "length", "t_pos", F.slice("words", F.col("t_pos") + 1, K).alias("t_words"), "hash")


def _marked(label: Column, words: Column) -> Column:
    """Whether the words of a span have what MARKS asks of its label."""
    number = F.get(F.filter(words, lambda w: w.rlike("^v?[0-9]+$")), F.lit(0))
    good = F.lit(True)
    for name, (some, none, version) in MARKS.items():
        holds = F.lit(True)
        if some:
            holds &= F.arrays_overlap(words, F.array(*map(F.lit, some)))
        if none:
            holds &= ~F.arrays_overlap(words, F.array(*map(F.lit, none)))
        if version:
            holds &= F.coalesce(F.ltrim(number, F.lit("v")) == version, F.lit(False))
        good = F.when(label == name, holds).otherwise(good)
    return good


def _uncontested(spans: DataFrame, reach: int) -> DataFrame:
    """spans without the tolerant ones that share half the words of either with a better one; no span is wider than `reach`."""
    near = Window.partitionBy("id", "text_hash").orderBy("start_word").rangeBetween(-reach, reach)
    rank = F.struct("coverage", "matched")
    rivals = F.collect_list(F.when(~F.col("base") & (F.col("coverage") >= MIN_COVERAGE), F.struct("start_word", "end_word", rank.alias("rank")))).over(near)

    def beaten(o: Column) -> Column:
        shared = F.least("end_word", o["end_word"]) - F.greatest("start_word", o["start_word"])
        shorter = F.least(F.col("end_word") - F.col("start_word"), o["end_word"] - o["start_word"])
        return (o["rank"] > rank) & (shared * 2 >= shorter)

    return spans.withColumn("rivals", rivals).filter(F.col("base") | ~F.exists("rivals", beaten)).drop("rivals")


def license_spans(
    docs: DataFrame,
    base=BASE_PHRASES,
    templates=TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Spans of license phrases and texts.

    Returns id, text_hash, label, base, start_word, end_word, coverage: one row per span, word
    positions from 0, the end not included.  For base phrases only exact spans are returned.
    coverage is the share of the template's words that verified runs cover, where words put in count as
    further words of the template.  Tolerant spans that lack what MARKS asks for are not returned, nor
    those that compete with a better one.  The row key is the id with the text's hash, so rows that
    share an id but not a text stay apart, and repeated rows give their spans once.  Null and empty
    texts and empty tables give none.  A phrase or template of fewer than K words is a ValueError.
    """
    spark = docs.sparkSession
    grams = _template_grams(spark, base, templates)
    worded = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), license_words(F.col(text_col)).alias("words")
    )
    rolled = worded.select("id", "text_hash", "words", F.posexplode(_gram_hashes(F.col("words"))).alias("pos", "hash"))
    # The templates are the constants above (or the caller's), a few hundred rows.
    hits = rolled.join(F.broadcast(grams), "hash").filter(F.slice("words", F.col("pos") + 1, K) == F.col("t_words"))
    # A span that holds is no wider than this; some words more show what stands in place of a missing end.
    widest = F.ceil(F.col("length") / MIN_COVERAGE).cast("int")
    votes = (
        hits.withColumn("diagonal", F.col("pos") - F.col("t_pos"))
        .withColumn("ahead", F.slice("words", F.col("pos") + 1, widest + F.col("length") + DRIFT))
        .groupBy("id", "text_hash", "template", "label", "base", "length", "diagonal")
        .agg(F.collect_set("t_pos").alias("t_at"), F.min_by("ahead", "pos").alias("ahead"))
    )
    lane = Window.partitionBy("id", "text_hash", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(lane) > DRIFT
    merged = votes.withColumn("new", F.when(F.col("base") | F.coalesce(far, F.lit(True)), 1).otherwise(0))
    merged = merged.withColumn("span", F.sum("new").over(lane.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("id", "text_hash", "template", "label", "base", "length", "span").agg(
        F.array_distinct(F.flatten(F.collect_list("t_at"))).alias("t_at"),
        F.array_distinct(F.flatten(F.collect_list(F.transform("t_at", lambda p: p + F.col("diagonal"))))).alias("d_at"),
        F.min(F.col("diagonal") + F.array_min("t_at")).alias("start_word"),
        F.max(F.col("diagonal") + F.array_max("t_at") + K).alias("end_word"),
        F.min_by("ahead", F.col("diagonal") + F.array_min("t_at")).alias("ahead"),
    )
    covered = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, p + (K - 1))))))
    spans = spans.withColumn("t_covered", covered("t_at")).withColumn("d_covered", covered("d_at"))
    width, t_end = F.col("end_word") - F.col("start_word"), F.array_max("t_at") + K
    left_out = t_end - F.array_min("t_at") - F.col("t_covered")
    put_in = F.greatest(F.lit(0), width - F.col("d_covered") - left_out)
    spans = spans.withColumn("matched", F.least("t_covered", "d_covered"))
    spans = spans.withColumn("coverage", F.col("matched") / (F.col("length") + put_in))
    missing = F.col("length") - t_end
    aligned = F.slice("ahead", F.lit(1), (width + F.when(missing > 0, missing + DRIFT).otherwise(0)).cast("int"))
    spans = spans.filter(F.when(F.col("base"), F.col("coverage") == 1.0).otherwise(_marked(F.col("label"), aligned)))
    spans = spans.select("id", "text_hash", "label", "base", "start_word", "end_word", "coverage", "matched")
    longest = max((len(text.split()) for _, text in (*base, *templates)), default=0)
    return _uncontested(spans, int(2 * longest / MIN_COVERAGE) + 1).drop("matched")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are their smallest and
    largest start; labels adds those of tolerant spans; score is the best coverage, 0 without any.
    Repeated rows each get their result; other columns are ignored; see license_spans for the rest.
    """
    spans = license_spans(docs, id_col=id_col, text_col=text_col)
    held = F.col("base") | (F.col("coverage") >= MIN_COVERAGE)
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start_word"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start_word"))).alias("last_word"),
        join(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        join(F.when(held, F.col("label"))).alias("labels"),
        F.max("coverage").alias("score"),
    )
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.size(license_words(F.col(text_col))).cast("bigint").alias("n_words"),
    )
    same = [F.col("id").eqNullSafe(F.col("__id")), F.col("text_hash") == F.col("__hash")]
    return rows.join(found, reduce(lambda a, b: a & b, same), "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first_word").cast("bigint"),
        F.col("last_word").cast("bigint"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
