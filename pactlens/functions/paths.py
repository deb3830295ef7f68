"""URLs and path templates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks a placeholder slot in a raw URL; cannot occur in one.
SLOT = "\x00"
_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def abstract_static_segments(template: Column) -> Column:
    """Segments that are all digits or a UUID become {id}; empty segments stay."""
    segment = lambda s: F.when(s.rlike(rf"\A([0-9]+|{_UUID})\z"), F.lit("{id}")).otherwise(s)
    return F.array_join(F.transform(F.split(template, "/", -1), segment), "/")


def strip_scheme(url: Column) -> Column:
    """Path and query of an absolute URL (path `/` if it has none); others unchanged."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"(?s)\A[^#]*?(\?[^#]+)", 1)
    return F.when(url.contains("://"), F.concat(F.when(rest == "", F.lit("/")).otherwise(rest), query)).otherwise(url)


def strip_to_path(url: Column) -> Column:
    """Path of a URL with a leading slash; without a scheme only the query is cut off."""
    absolute = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    path = F.when(url.contains("://"), absolute).otherwise(F.substring_index(url, "?", 1))
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def label_placeholders(names: Column) -> Column:
    """Empty names become `param`; the n-th use of a name from the second on gets n as a suffix."""
    full = F.transform(names, lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.lit("param")).otherwise(x))

    def one(x: Column, i: Column) -> Column:
        uses = F.size(F.filter(F.slice(full, F.lit(1), i + 1), lambda y: y == x))
        return F.when(uses > 1, F.concat(x, uses.cast("string"))).otherwise(x)

    return F.transform(full, one)


def normalize_template(raw: Column, names: Column) -> Column:
    """A raw URL with SLOT in its placeholder slots, as a template with the named slots."""
    path = F.substring_index(strip_scheme(raw), "?", 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    parts = F.split(path, SLOT, -1)
    labels = label_placeholders(names)
    # As many slots as there are both names and gaps; text after missing names is dropped with them.
    n = F.least(F.size(labels), F.size(parts) - 1)
    spliced = F.zip_with(
        F.slice(labels, F.lit(1), n), F.slice(parts, F.lit(2), n), lambda name, after: F.concat(F.lit("{"), name, F.lit("}"), after)
    )
    rendered = F.regexp_replace(F.concat(F.get(parts, F.lit(0)), F.array_join(spliced, "")), "/{2,}", "/")
    return F.when((F.length(rendered) > 1) & rendered.endswith("/"), F.regexp_replace(rendered, r"/\z", "")).otherwise(rendered)


def glob_to_regex(glob: str) -> str:
    """A case-sensitive glob (`*` spans slashes, `?`, `[seq]`, `[!seq]`) as an anchored Java pattern."""
    import re

    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i : i + 1] == "!" else i + 1)
            if end < 0:
                out.append(r"\[")
                continue
            inner = glob[i:end].replace("\\", r"\\").replace("[", r"\[").replace("&", r"\&")
            out.append(f"[^{inner[1:]}]" if inner.startswith("!") else f"[{inner.replace('^', chr(92) + '^', 1) if inner.startswith('^') else inner}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return rf"(?s)\A{''.join(out)}\z"
