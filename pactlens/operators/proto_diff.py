"""Protobuf descriptor sets flattened to rows and compared by outer joins.

specs(pair, side, descriptors): side is `before` or `after`, descriptors a serialised set.  Changes
have the columns of the OpenAPI ones.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlens.functions.lineage import cut

_COLUMNS = ("scope", "name", "member", "number", "type", "label", "input", "output")
_FLAT = T.StructType([T.StructField(c, T.IntegerType() if c == "number" else T.StringType()) for c in _COLUMNS])


@F.pandas_udf(T.ArrayType(_FLAT))
def _flatten(blobs: pd.Series) -> pd.Series:
    """Messages, fields, services and methods of a descriptor set as flat rows; names carry the package."""
    from google.protobuf import descriptor_pb2 as pb
    from google.protobuf.message import DecodeError

    kinds = {pb.FieldDescriptorProto.TYPE_MESSAGE: "message", pb.FieldDescriptorProto.TYPE_ENUM: "enum"}

    def field_type(f) -> str:
        return f"{kinds[f.type]}:{f.type_name}" if f.type in kinds else f"scalar:{pb.FieldDescriptorProto.Type.Name(f.type)}"

    def row(scope, name, member=None, number=None, kind=None, label=None, given=None, back=None) -> dict:
        return {"scope": scope, "name": name, "member": member, "number": number, "type": kind, "label": label, "input": given, "output": back}

    def messages(prefix, found):
        for m in found:
            name = f"{prefix}.{m.name}" if prefix else m.name
            yield row("message", name)
            for f in m.field:
                yield row("field", name, f.name, f.number, field_type(f), pb.FieldDescriptorProto.Label.Name(f.label))
            yield from messages(name, m.nested_type)

    def one(blob) -> list[dict]:
        out = []
        try:
            files = pb.FileDescriptorSet.FromString(blob).file if blob else []
        except DecodeError:
            return [row("problem", "not a descriptor set")]
        for file in files:
            out += messages(file.package, file.message_type)
            for s in file.service:
                name = f"{file.package}.{s.name}" if file.package else s.name
                out.append(row("service", name))
                out += [row("rpc", name, m.name, given=m.input_type, back=m.output_type) for m in s.method]
        return out

    return blobs.map(one)


def flatten_descriptors(specs: DataFrame) -> DataFrame:
    """pair, side, scope (message, field, service, rpc) and what it holds; bytes that are no descriptor set give one row of scope `problem`."""
    return specs.select("pair", "side", F.explode(_flatten(F.col("descriptors"))).alias("d")).select("pair", "side", "d.*")


def descriptor_problems(specs: DataFrame) -> DataFrame:
    """pair, side, problem of the sides that hold no descriptor set; diff_proto gives no changes for their pairs."""
    return flatten_descriptors(specs).filter("scope = 'problem'").select("pair", "side", F.col("name").alias("problem"))


def _both(rows: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """keys, b, a: what each side holds under a key, as lists of structs of the kept columns."""
    one = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct(*kept))).alias(side[0])
    return rows.groupBy(*keys).agg(one("before"), one("after"))


def _sides(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, side and the members of the lists b and a."""
    tagged = lambda c, side: F.transform(c, lambda x: F.struct(F.lit(side).alias("side"), x.alias("x")))
    each = rows.select(*keep, F.explode(F.concat(tagged("b", "before"), tagged("a", "after"))).alias("e"))
    return each.select(*keep, "e.side", "e.x.*")


def _lined_up(rows: DataFrame) -> DataFrame:
    """Every member of b beside every one of a; null where a side has none."""
    return rows.withColumn("b", F.explode_outer("b")).withColumn("a", F.explode_outer("a"))


def _case(test: Column, kind: Column | str, before: Column, after: Column) -> Column:
    """A change if the test holds, else null."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(test, F.struct(kind.alias("kind"), before.cast("string").alias("before"), after.cast("string").alias("after")))


def _emit(rows: DataFrame, location: Column, cases: list[Column], rpc: bool = False) -> DataFrame:
    """One row per case that holds."""
    path = F.concat_ws(".", "name", "member") if rpc else F.lit(None).cast("string")
    methods = F.array(F.lit("POST")) if rpc else F.lit(None).cast("array<string>")
    found = rows.select("pair", location.alias("location"), path.alias("path"), methods.alias("methods"), F.explode(F.array_compact(F.array(*cases))).alias("c"))
    return found.select("pair", "c.kind", "location", "c.before", "c.after", "path", "methods")


def diff_proto(specs: DataFrame) -> DataFrame:
    """All changes of messages, fields, services and methods between the sides of every pair.

    A missing or empty side holds nothing.  Pairs with a side that is no descriptor set have no changes:
    descriptor_problems() tells which they are.  Both sides of a message or service meet in one shuffle
    by its name; its members are lined up by groupings below that name, which need no joins.
    """
    every = cut(flatten_descriptors(specs))  # read for the problems and for the rest
    flat = every.filter("scope <> 'problem'").withColumn("root", F.when(F.col("scope").isin("message", "field"), "message").otherwise("service"))
    owner = F.col("scope") == F.col("root")
    has = lambda side: F.coalesce(F.bool_or(owner & (F.col("side") == side)), F.lit(False)).alias(f"{side[0]}_has")
    one = lambda side: F.collect_list(F.when(~owner & (F.col("side") == side), F.struct("member", "number", "type", "label", "input", "output"))).alias(side[0])
    owners = flat.groupBy("pair", "root", "name").agg(has("before"), has("after"), one("before"), one("after"))
    # Pairs with a problem may be many; a merge join keeps them away from the driver.
    broken = every.filter("scope = 'problem'").select("pair").distinct()
    owners = cut(owners.join(broken.hint("merge"), "pair", "left_anti"))

    as_json = lambda side: F.when(F.col(f"{side}_has"), F.to_json(F.struct("name")))
    kind = lambda what: F.concat(F.lit("proto."), F.col("root"), F.lit(f".{what}"))
    cases = [
        _case(F.col("a_has") & ~F.col("b_has"), kind("added"), as_json("b"), as_json("a")),
        _case(F.col("b_has") & ~F.col("a_has"), kind("removed"), as_json("b"), as_json("a")),
    ]
    out = [_emit(owners, F.concat(F.lit("/"), F.col("root"), F.lit("s/"), F.col("name")), cases)]
    kept = owners.filter("a_has AND b_has")
    new, gone = F.col("b").isNull(), F.col("a").isNull()
    both = ~new & ~gone

    # A field whose name has another number on the other side was renumbered, not added or removed.
    own = ["pair", "root", "name"]
    fields = _sides(kept.filter("root = 'message'"), own)
    named = _both(fields, [*own, "member"], ["number", "type", "label"])
    others = lambda c: F.transform(c, lambda x: x["number"])
    named = _sides(named.withColumns({"b_at": others("b"), "a_at": others("a")}), [*own, "member", "b_at", "a_at"])
    named = named.withColumn("others", F.when(F.col("side") == "before", F.col("a_at")).otherwise(F.col("b_at")))
    by_number = _lined_up(_both(named, [*own, "number"], ["member", "type", "label", "others"]))
    # Of a field that one side lacks, each number that its name has on the other is looked at.
    by_number = by_number.withColumn("other", F.explode_outer(F.when(new, F.col("a.others")).when(gone, F.col("b.others"))))
    at = F.concat(F.lit("/"), F.col("name"), F.lit("/"), F.coalesce("b.member", "a.member"))
    shown = lambda s: F.to_json(F.struct("number", F.col(f"{s}.member").alias("name"), F.col(f"{s}.type").alias("type")))
    moved = F.col("other").isNotNull() & (F.col("other") != F.col("number"))
    nothing = F.lit(None).cast("string")
    cases = [
        _case(new & moved, "proto.field.number_changed", F.col("other"), F.col("number")),
        _case(new & ~moved, "proto.field.added", nothing, shown("a")),
        _case(gone & ~moved, "proto.field.removed", shown("b"), nothing),
    ]
    for column, name in (("type", "type_changed"), ("label", "label_changed"), ("member", "renamed")):
        b, a = F.col(f"b.{column}"), F.col(f"a.{column}")
        cases.append(_case(both & (a != b), f"proto.field.{name}", b, a))
    out.append(_emit(by_number, at, cases))

    rpcs = _lined_up(_both(_sides(kept.filter("root = 'service'"), own), [*own, "member"], ["input", "output"]))
    at = F.concat(F.lit("/"), F.col("name"), F.lit("/"), F.col("member"))
    shown = lambda s: F.when(F.col(s).isNotNull(), F.to_json(F.struct(F.col("member").alias("name"), F.col(f"{s}.input").alias("input_type"), F.col(f"{s}.output").alias("output_type"))))
    cases = [_case(new, "proto.rpc.added", shown("b"), shown("a")), _case(gone, "proto.rpc.removed", shown("b"), shown("a"))]
    for column, name in (("input", "request_type_changed"), ("output", "response_type_changed")):
        b, a = F.col(f"b.{column}"), F.col(f"a.{column}")
        cases.append(_case(both & (a != b), f"proto.rpc.{name}", b, a))
    out.append(_emit(rpcs, at, cases, True))
    return reduce(DataFrame.unionByName, out)
