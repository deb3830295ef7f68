"""Content hashes that identify versions, batches, call sites, changes and guides."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def canonical_json(documents: pd.Series) -> pd.Series:
    """JSON text with sorted keys, no blanks and ASCII escapes; null stays null, invalid JSON gives null."""

    def one(text):
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return documents.map(one)


def version_hash(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def batch_hash(har: Column, grpc: Column) -> Column:
    """SHA-256 over the parts that are there and not empty, each under its own heading."""
    har, grpc = (F.coalesce(c.cast("binary"), F.lit(b"")) for c in (har, grpc))
    part = lambda head, c: F.when(F.octet_length(c) > 0, F.concat(F.lit(head), c)).otherwise(F.lit(b""))
    return F.sha2(F.concat(part(b"HAR\n", har), part(b"\nGRPC\n", grpc)), 256)


def call_site_hash(file: Column, line: Column, language: Column, library: Column, method: Column, template: Column, fields: Column) -> Column:
    names = F.array_join(F.array_sort(fields), ",")
    return F.sha2(F.concat_ws("|", file, line.cast("string"), language, library, F.upper(method), template, names), 256)


def change_id(kind: Column, location: Column) -> Column:
    """Not unique: changes of one kind at one location share it."""
    return F.substring(F.sha1(F.concat_ws("::", kind, location)), 1, 16)


def guide_key(diff: Column, client: Column, prompt_version: Column, model: Column) -> Column:
    return F.sha2(F.concat_ws("|", diff, client, prompt_version, model), 256)


def prompt_hash(prompt: Column) -> Column:
    return F.sha2(prompt.cast("binary"), 256)


def short_id(identity: Column) -> Column:
    """The first eight characters, as shown in titles."""
    return F.substring(identity, 1, 8)


def branch_name(campaign: Column, prefix: str = "pactlens") -> Column:
    """The branch that a campaign's change is proposed on."""
    return F.concat(F.lit(f"{prefix}/deprecate-"), campaign)


def surrogate_id(*key: Column) -> Column:
    """An id of 32 hex digits made of a row's natural key: the same row has the same id in every run; null and empty parts differ."""
    parts = [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("-")) for k in key]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)
