"""JSON values as paths and types."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NODE = T.StructType([*[T.StructField(name, T.StringType()) for name in ("path", "type", "text", "parent", "name")], T.StructField("depth", T.IntegerType())])
_TYPES = ((bool, "boolean"), (int, "integer"), (float, "number"), (str, "string"), (list, "array"), (dict, "object"))


def json_type(value) -> str:
    return "null" if value is None else next((name for kind, name in _TYPES if isinstance(value, kind)), "unknown")


def walk(value):
    """(path, type, text of a string or None, parent's path, key in it, depth) of every node, containers included.

    Items of arrays are [*] in paths and have no key; the root has no parent.
    """
    stack = [(value, "$", None, None, 0)]
    while stack:
        node, at, parent, name, depth = stack.pop()
        yield at, json_type(node), node if isinstance(node, str) else None, parent, name, depth
        if isinstance(node, dict):
            stack += [(v, f"{at}.{k}", at, k, depth + 1) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            stack += [(v, f"{at}[*]", at, None, depth + 1) for v in reversed(node)]


@F.arrow_udf(T.ArrayType(_NODE))
def field_paths(bodies: pa.Array) -> pa.Array:
    """Nodes of a JSON text; null, blank and invalid texts have none."""
    nodes, ends = [], [0]
    for text in bodies.to_pylist():
        try:
            nodes += list(walk(json.loads(text))) if text and text.strip() else []
        except (ValueError, RecursionError):
            pass
        ends.append(len(nodes))
    columns = list(zip(*nodes)) if nodes else [()] * len(_NODE.names)
    arrays = [pa.array(c, type=pa.int32() if name == "depth" else pa.string()) for name, c in zip(_NODE.names, columns)]
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.StructArray.from_arrays(arrays, names=_NODE.names))


def quoted(text: Column) -> Column:
    """A text as a JSON string, a null one as the word null."""
    return F.regexp_replace(F.to_json(F.array(text)), r"\A\[|\]\z", "")
