"""Roll-ups and renderings of classified changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.functions.jsontree import quoted
from pactlens.functions.lineage import tasks_of
from pactlens.operators.rules import VERDICTS

#: What one call may carry, and the order of verdicts.
ANNOTATION_LIMIT = 50
_BADGES = {"breaking": ":no_entry: Breaking", "behavioral": ":warning: Behavioral", "additive": ":white_check_mark: Additive"}


def verdict_rank(verdict: Column) -> Column:
    return F.when(verdict == "breaking", 0).when(verdict == "behavioral", 1).otherwise(2)


def verdict_summary(changes: DataFrame, by: list[str]) -> DataFrame:
    count = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    return changes.groupBy(*by).agg(F.count("*").alias("total"), *count)


def client_impact(changes: DataFrame, by: list[str]) -> DataFrame:
    """Changes per affected client and whether one of them breaks it."""
    each = changes.select(*by, "verdict", F.explode("affected_clients").alias("client"))
    return each.groupBy(*by, "client").agg(F.count("*").alias("changes"), F.bool_or(F.col("verdict") == "breaking").alias("breaking"))


def ranked_impact(changes: DataFrame, by: list[str]) -> DataFrame:
    """client_impact in order: within each report the clients with most changes first, then by name."""
    return client_impact(changes, by).orderBy(*by, F.desc("changes"), "client")


def verdict_matrix(changes: DataFrame, by: list[str]) -> DataFrame:
    """One row per client, one count per verdict."""
    each = changes.select(*by, "verdict", F.explode("affected_clients").alias("client"))
    return each.groupBy(*by, "client").pivot("verdict", list(VERDICTS)).count().na.fill(0)


def annotations(changes: DataFrame, by: list[str], order: str, limit: int = ANNOTATION_LIMIT) -> DataFrame:
    """The first `limit` changes of each report, worst verdict first, then in their own order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(verdict_rank(F.col("verdict")), order))
    level = F.when(F.col("verdict") == "breaking", "failure").when(F.col("verdict") == "behavioral", "warning").otherwise("notice")
    return changes.withColumn("position", rank).filter(F.col("position") <= limit).withColumn("level", level)


def check_annotations(changes: DataFrame, by: list[str], order: str, spec_path: str | Column, limit: int = ANNOTATION_LIMIT) -> DataFrame:
    """by, position, path, start_line, end_line, annotation_level, title, message, raw_details: what a CI check shows beside a specification.

    The first `limit` changes of each report, as in annotations.  spec_path is the file's, or a column
    with each report's; changes name places in a specification and no lines of it, so line 1 holds them
    all and the message and details say where.  A null list of clients counts as empty.
    """
    if isinstance(spec_path, str) and not spec_path:
        raise ValueError("annotations need the path of a file")
    clients = F.coalesce("affected_clients", F.array().cast("array<string>"))
    hint = F.when(F.size(clients) > 0, F.concat(F.lit(" (affects "), F.size(clients).cast("string"), F.when(F.size(clients) == 1, " client repo)").otherwise(" client repos)"))).otherwise("")
    names = F.concat(F.lit("[\n    "), F.array_join(F.transform(clients, quoted), ",\n    "), F.lit("\n  ]"))
    members = [F.concat(F.lit(f'  "{c}": '), quoted(F.col(c))) for c in ("change_id", "kind", "location", "verdict", "rule_id")]
    members.append(F.concat(F.lit('  "affected_clients": '), F.when(F.size(clients) > 0, names).otherwise("[]")))
    return annotations(changes, by, order, limit).select(
        *by,
        "position",
        (F.lit(spec_path) if isinstance(spec_path, str) else spec_path).alias("path"),
        F.lit(1).alias("start_line"),
        F.lit(1).alias("end_line"),
        F.col("level").alias("annotation_level"),
        F.concat("kind", F.lit(" ["), "rule_id", F.lit("]")).alias("title"),
        F.concat("location", F.lit(": "), F.coalesce("rationale", F.lit("")), hint).alias("message"),
        F.concat(F.lit("{\n"), F.array_join(F.array(*members), ",\n"), F.lit("\n}")).alias("raw_details"),
    )


def workflow_command(kind: Column, rule_id: Column, location: Column, rationale: Column, verdict: Column) -> Column:
    """A CI log command for one change."""
    message = F.replace(rationale, F.lit("\n"), F.lit(" "))
    for old, new in (("%", "%25"), ("\r", ""), (":", "%3A"), (",", "%2C")):
        message = F.replace(message, F.lit(old), F.lit(new))
    command = F.when(verdict == "breaking", "error").when(verdict == "behavioral", "warning").otherwise("notice")
    return F.concat(F.lit("::"), command, F.lit(" title="), kind, F.lit(" ["), rule_id, F.lit("]::"), location, F.lit(": "), message)


def _dealt(changes: DataFrame, by: list[str]) -> DataFrame:
    """changes dealt out by report, in tasks by their bytes of text, for which they are read once more."""
    texts = [c for c in ("kind", "location", "rationale", "before", "after") if c in changes.columns]
    return changes.repartition(tasks_of(changes, *texts, F.array_join("affected_clients", ",")), *by)


def _joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _of_verdict(verdict: str) -> Column:
    return F.transform(F.filter("lines", lambda x: x["verdict"] == verdict), lambda x: x["line"])


def report_text(changes: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, report: one plain-text report per group, sections by verdict in the changes' own order."""
    clients = F.when(F.size("affected_clients") > 0, F.concat(F.lit(" (affects: "), F.array_join("affected_clients", ", "), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("    - "), "kind", F.lit(" @ "), "location", F.lit(" ["), "rule_id", F.lit("] "), "rationale", clients)
    per = _dealt(changes, by).groupBy(*by).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS],
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "verdict", line.alias("line")))).alias("lines"),
    )
    head = F.format_string("breaking=%d behavioral=%d additive=%d total=%d", "breaking", "behavioral", "additive", "total")
    parts = [F.array(head)]
    for v in VERDICTS:
        own = _of_verdict(v)
        parts.append(F.when(F.size(own) > 0, F.concat(F.array(F.concat(F.lit(f"  {v} ("), F.size(own).cast("string"), F.lit("):"))), own)).otherwise(F.array().cast("array<string>")))
    return per.select(*by, _joined(F.concat(*parts)).alias("report"))


def report_markdown(changes: DataFrame, by: list[str], order: str, accepted: bool = False) -> DataFrame:
    """by, report: a Markdown report with a verdict table, the gate, sections and the impact on clients."""
    clients = F.when(F.size("affected_clients") > 0, F.concat(F.lit("; affects `"), F.array_join("affected_clients", "`, `"), F.lit("`"))).otherwise("")
    line = F.concat(F.lit("- **"), "kind", F.lit("** at `"), "location", F.lit("` [`"), "rule_id", F.lit("`] "), "rationale", clients)
    dealt = _dealt(changes, by)
    per = dealt.groupBy(*by).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS],
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "verdict", line.alias("line")))).alias("lines"),
    )
    impact = client_impact(dealt, by)  # dealt out alike, so that a report meets its clients where it is
    row = F.concat(F.lit("| `"), "client", F.lit("` | "), F.col("changes").cast("string"), F.lit(" | "), F.when(F.col("breaking"), "yes").otherwise("no"), F.lit(" |"))
    rows = impact.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("changes")).alias("n"), "client", row.alias("line")))).alias("impact"))
    joined = per.join(rows, by, "left")
    table = [F.lit("## Contract changes"), F.lit(""), F.lit("| Verdict | Count |"), F.lit("|---|---:|")]
    table += [F.concat(F.lit(f"| {_BADGES[v]} | "), F.col(v).cast("string"), F.lit(" |")) for v in VERDICTS]
    table += [F.concat(F.lit("| **Total** | **"), F.col("total").cast("string"), F.lit("** |"))]
    banner = "> Breaking changes are accepted." if accepted else "> This change breaks clients."
    parts = [F.array(*table), F.when(F.col("breaking") > 0, F.array(F.lit(""), F.lit(banner))).otherwise(F.array().cast("array<string>"))]
    for v in VERDICTS:
        own = _of_verdict(v)
        title = F.concat(F.lit(f"### {_BADGES[v]} ("), F.size(own).cast("string"), F.lit(")"))
        parts.append(F.when(F.size(own) > 0, F.concat(F.array(F.lit(""), title, F.lit("")), own)).otherwise(F.array().cast("array<string>")))
    listed = F.concat(F.array(F.lit("| Client | Changes | Breaking |"), F.lit("|---|---:|:---:|")), F.transform("impact", lambda x: x["line"]))
    parts.append(F.concat(F.array(F.lit(""), F.lit("### Clients"), F.lit("")), F.coalesce(listed, F.array(F.lit("No client is affected.")))))
    return joined.select(*by, _joined(F.concat(*parts)).alias("report"))


def report_json(changes: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, report: one JSON document per group with sorted keys: counts per verdict, and the changes in their own order."""
    slim = F.struct("affected_clients", "change_id", "kind", "location", "rationale", "rule_id", "verdict")
    per = _dealt(changes, by).groupBy(*by).agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS],
        F.count("*").alias("total"),
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), slim.alias("change")))).alias("listed"),
    )
    summary = F.struct(*sorted((*VERDICTS, "total"))).alias("summary")
    return per.select(*by, F.to_json(F.struct(F.transform("listed", lambda x: x["change"]).alias("changes"), summary)).alias("report"))


def comparison_reports(comparisons: DataFrame, changes: DataFrame, findings: DataFrame, by: list[str], order: str, ruleset_id: str = "default") -> DataFrame:
    """by, report: the JSON report of every comparison, with sorted keys: changes, kind of contract, ruleset, linter findings and counts.

    comparisons(by, contract_kind) holds one row per comparison, so that one without changes or findings
    has a report too; changes are those of all comparisons, with before and after as JSON texts if they
    have them; findings(by, position, code, message, severity, path) are those of linters, which only
    openapi contracts have.  Changes and findings meet their comparison in shuffles by its key.
    """
    texts = [c for c in ("after", "before") if c in changes.columns]
    parts = {c: F.coalesce(F.to_json(F.try_parse_json(c)), quoted(F.col(c))) for c in texts}
    parts |= {"affected_clients": F.coalesce(F.to_json("affected_clients"), F.lit("[]"))}
    parts |= {c: quoted(F.col(c)) for c in ("change_id", "kind", "location", "rationale", "rule_id", "verdict")}
    record = F.concat(F.lit("{"), F.array_join(F.array(*[F.concat(F.lit(f'"{c}":'), parts[c]) for c in sorted(parts)]), ","), F.lit("}"))
    listed = lambda entries: F.array_join(F.transform(F.array_sort(entries), lambda x: x["text"]), ",")
    of_changes = _dealt(changes, by).groupBy(*by).agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS], F.count("*").alias("total"), listed(F.collect_list(F.struct(F.col(order).alias("o"), record.alias("text")))).alias("changes")
    )
    finding = F.to_json(F.struct("code", "message", "path", "severity"))
    of_findings = findings.groupBy(*by).agg(listed(F.collect_list(F.struct(F.col("position").alias("o"), finding.alias("text")))).alias("findings"))
    joined = comparisons.join(of_changes, by, "left").join(of_findings, by, "left")
    summary = F.to_json(F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in sorted((*VERDICTS, "total"))]))
    found = F.when(F.col("contract_kind") == "openapi", F.coalesce("findings", F.lit(""))).otherwise("")
    report = F.concat(
        F.lit('{"changes":['), F.coalesce("changes", F.lit("")), F.lit('],"contract_kind":'), quoted(F.col("contract_kind")),
        F.lit(',"ruleset_id":'), quoted(F.lit(ruleset_id)), F.lit(',"spectral_findings":['), found, F.lit('],"summary":'), summary, F.lit("}"),
    )
    return joined.select(*by, report.alias("report"))


def write_reports(reports: DataFrame, path: str, by: list[str]) -> None:
    """Every report as a text file in a folder of its own key below `path`."""
    reports.select(*by, "report").write.partitionBy(*by).text(path)
