"""Sinks: findings as JSON lines, as SARIF rows, and as a short text. Only the short text passes through the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.document import write_document

#: Severities and SARIF levels.
LEVELS = {"error": "error", "warning": "warning", "info": "note"}
SHOWN = 10


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, nulls included."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def visible(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics that are more than information."""
    return diagnostics.where(F.col("severity") != "info")


#: The order of each kind of rows in a report.
ORDERS = {"measurements": ["metric", "key"], "findings": ["rule", "key", "finding_id"], "diagnostics": ["code", "file", "message"]}


def ordered(rows: DataFrame, kind: str) -> DataFrame:
    """rows in the fixed order of their kind, nulls first; a range sort, no single task."""
    return rows.orderBy(*[F.asc_nulls_first(c) for c in ORDERS[kind]])


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(ruleId, ruleIndex, level) of the rules in the order in which ordered findings name them first."""
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("severity")]
    rules = findings.groupBy(F.col("rule").alias("ruleId")).agg(F.min(F.struct("key", "finding_id", F.coalesce(level, F.lit("warning")).alias("level"))).alias("first"))
    return rules.select("ruleId", (F.row_number().over(Window.orderBy("ruleId")) - 1).alias("ruleIndex"), "first.level")


def sarif_results(findings: DataFrame) -> DataFrame:
    """A SARIF result for each finding: rule and its index, level, message, location, fingerprint. Rules are few and configured."""
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("severity")]
    file = F.regexp_extract("key", "^(.*?)(::|$)", 1)
    place = F.array(F.struct(F.struct(F.struct(file.alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    own = findings.join(sarif_rules(findings).select(F.col("ruleId").alias("rule"), "ruleIndex"), "rule")
    return own.select(F.col("rule").alias("ruleId"), "ruleIndex", F.coalesce(level, F.lit("warning")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"), F.struct(F.col("finding_id").alias("findingId")).alias("partialFingerprints"))


def sarif_notifications(diagnostics: DataFrame) -> DataFrame:
    """A SARIF notification for each visible diagnostic."""
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("severity")]
    return visible(diagnostics).select(F.col("code").alias("descriptorId"), F.coalesce(level, F.lit("warning")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.col("file").alias("uri"))


def places_of(findings: DataFrame) -> DataFrame:
    """findings with files: those a finding is about, the first being where it is shown: the copies of a block, the members of a cycle, else its own file."""
    clone = F.transform(F.split(F.regexp_replace("key", r"^clone:|#\d+$", ""), r"\|"), lambda m: F.regexp_extract(m, "^(.*?)(::|$)", 1))
    cycle, own = F.split("key", r"\|"), F.array(F.regexp_extract("key", "^(.*?)(::|->|$)", 1))
    return findings.withColumn("files", F.when(F.col("rule") == "duplication.token_clone", clone).when(F.col("rule") == "dependency.cycle", cycle).otherwise(own))


def write_sarif(report, path: str, replace: bool = False) -> None:
    """A report as one SARIF document: rules, notifications and results in their orders, written by tasks.

    Resolved findings are no results. A compared finding's message says how it compares. A result stands at its first
    file and names the others as related.
    """
    spark, status = report.findings.sparkSession, report.gate.first()["status"]
    found = places_of(report.findings)
    if "classification" in found.columns:
        found = found.where("classification <> 'resolved'").withColumn("message", F.concat("message", F.lit(" ("), "classification", F.lit(")")))
    level = F.coalesce(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("severity")], F.lit("warning"))
    at = lambda f: F.struct(F.struct(F.struct(f.alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    related = F.when(F.size("files") > 1, F.transform(F.slice("files", 2, F.size("files")), at))
    rules = sarif_rules(found)
    results = ordered(found, "findings").join(F.broadcast(rules.select(F.col("ruleId").alias("rule"), "ruleIndex")), "rule")  # configured rules: few
    columns = [F.col("rule").alias("ruleId"), "ruleIndex", level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.transform(F.slice("files", 1, 1), at).alias("locations"), related.alias("relatedLocations"), F.struct(F.col("finding_id").alias("findingId")).alias("partialFingerprints"), F.struct("blocking", "current", "threshold").alias("properties")]
    shown = ordered(visible(report.diagnostics), "diagnostics")
    notes = shown.select(F.to_json(F.struct(level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.struct(F.col("code").alias("id")).alias("descriptor"), F.when(F.col("file") != "", F.array(at(F.col("file")))).alias("locations"))))
    described = rules.orderBy("ruleIndex").select(F.to_json(F.struct(F.col("ruleId").alias("id"), F.col("ruleId").alias("name"), F.struct("level").alias("defaultConfiguration"))))
    head = '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"plumbline","rules":['
    ran = json.dumps({"executionSuccessful": status != "incomplete", "exitCode": exit_code(status)}, separators=(",", ":"))[:-1]
    write_document(spark, [head, described, "]}},\"invocations\":[" + ran + ',"toolExecutionNotifications":[', notes, ']}],"results":[', results.select(F.to_json(F.struct(*columns))), "]}]}\n"], path, replace)


def write_report(report, path: str, replace: bool = False) -> None:
    """A report as one JSON document: the gate, then measurements, findings and diagnostics in their orders, nulls included."""
    spark = report.findings.sparkSession
    gate = json.dumps(report.gate.first().asDict())
    rows = lambda df, kind: ordered(df, kind).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    pieces = ['{"schemaVersion":"1.0","policy":' + gate + ',"measurements":[', rows(report.measurements, "measurements"), '],"findings":[', rows(report.findings, "findings"), '],"diagnostics":[', rows(report.diagnostics, "diagnostics"), "]}\n"]
    write_document(spark, pieces, path, replace)


def summary(gate: DataFrame, findings: DataFrame, diagnostics: DataFrame) -> str:
    """The gate, and at most ten findings and ten diagnostics that are not only information."""
    status = gate.first()
    lines = [f"{status['status']}: {status['blocking']} blocking, {status['warnings']} warnings"]
    for title, df, order, text in (("findings", findings, ["rule", "key"], lambda r: f"{r['rule']} {r['key']}: {r['message']}"), ("diagnostics", visible(diagnostics), ["code", "file", "message"], lambda r: f"{r['code']} {r['file']}: {r['message']}")):
        total, shown = df.count(), df.orderBy(*order).limit(SHOWN).collect()
        lines += [text(r) for r in shown] + ([f"... and {total - SHOWN} more {title}"] if total > SHOWN else [])
    return "\n".join(lines)


def exit_code(status: str) -> int:
    """0 passed, 1 failed, 2 incomplete."""
    return {"passed": 0, "failed": 1}.get(status, 2)
