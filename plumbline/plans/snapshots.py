"""Comparing a report with a saved baseline, and ranking what is left to fix."""

from __future__ import annotations

import hashlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import stable_json
from plumbline.operators import compare, policy, worklist
from plumbline.plans.check import Report
from plumbline.sources import baseline
from plumbline.sources import config as configuration


def identity(config: dict | None = None) -> dict:
    """What has to be alike for a comparison: the analysers and the configuration."""
    text = stable_json(config or configuration.default_config())
    return {"adapters": {"python": ".".join(map(str, sys.version_info[:2]))}, "configHash": hashlib.sha256(text.encode()).hexdigest()}


def incompatible(spark: SparkSession, root: str, name: str, config: dict | None = None) -> DataFrame:
    """Diagnostics (code, severity, message, file, required): one row if the baseline was made by other analysers or settings, else none.

    Nothing is to be compared with such a baseline, and the diagnostic makes the gate incomplete.
    """
    was, now = baseline.properties(spark, root, name), identity(config)
    reasons = {"adapters": ("baseline.analyzers_incompatible", "language adapters differ from those of the baseline; make a new baseline"), "configHash": ("baseline.config_incompatible", "the configuration differs from that of the baseline; make a new baseline")}
    rows = [(code, "error", message, "", True) for field, (code, message) in reasons.items() if was.get(field) != now[field]][:1]
    return spark.createDataFrame(rows, "code string, severity string, message string, file string, required boolean")


def save(report: Report, root: str, name: str, replace: bool = False, config: dict | None = None) -> None:
    """Measurements, findings and the files' hashes, with what was analysed how; comparison columns are never stored."""
    hashes = report.files.select("path", F.sha2("code", 256).alias("hash"))
    tables = {"measurements": report.measurements.select("metric", "variant", "key", "value"), "findings": report.findings.select("rule", "key", "current", "severity", "message"), "files": hashes}
    baseline.save(tables, root, name, replace, identity(config))


def _renamed(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """Keys of moved files (path or path::symbol) get their new path; cycle and layer keys stay as they are."""
    file = F.regexp_extract("key", "^(.*?)(::|$)", 1)
    moved = rows.withColumn("_file", file).join(renames, F.col("_file") == F.col("previous_path"), "left")
    key = F.when(F.col("path").isNotNull(), F.concat(F.col("path"), F.expr("substring(key, length(_file) + 1)"))).otherwise(F.col("key"))
    return moved.withColumn("key", key).select(*rows.columns)


def against(spark: SparkSession, report: Report, root: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(measurements, findings) with baseline, delta and classification. Unedited moves are followed.

    Of a baseline's measurements with one metric, variant and key the last stored counts. A finding's baseline is that of its measurement,
    else of the previous finding. Findings have severity, blocking and message for the gate and reports; a resolved one has
    those of the baseline, does not block, and says that it is resolved.
    """
    old = {t: baseline.load(spark, root, name, t) for t in ("measurements", "findings", "files")}
    renames = compare.infer_renames(report.files.select("path", F.sha2("code", 256).alias("hash")), old["files"])
    before = _renamed(old["measurements"].withColumn("ord", F.monotonically_increasing_id()), renames)
    measured = compare.compare_measurements(report.measurements.select("metric", "variant", "key", "value"), before, ["metric", "variant", "key"])
    baselines = measured.where("baseline is not null").select(F.col("metric").alias("rule"), "key", "baseline")
    previous = _renamed(old["findings"], renames)
    found = compare.compare_findings(report.findings.select("rule", "key", "current"), previous.select("rule", "key", "current"), ["rule", "key"], baselines)
    now = report.findings.select("rule", "key", "severity", "blocking", "message").distinct()
    gone = previous.select("rule", "key", F.col("severity").alias("_severity"), F.concat(F.lit("Resolved: "), "message").alias("_message")).distinct()
    both = found.join(now, ["rule", "key"], "left").join(gone, ["rule", "key"], "left")
    resolved = F.col("classification") == "resolved"
    pick = lambda c, other: F.when(resolved, other).otherwise(F.col(c)).alias(c)
    return measured, both.select(*found.columns, pick("severity", F.col("_severity")), pick("blocking", F.lit(False)), pick("message", F.col("_message")))


def gate_against(report: Report, found: DataFrame) -> DataFrame:
    """The gate of a report whose findings were compared by against(): only what is new or worsened blocks."""
    return policy.gate(found, report.diagnostics)


def to_fix(report: Report, n: int = 20) -> DataFrame:
    """The first n places of each section: structure (cycles and layers), clones, and functions and files."""
    section = F.when(F.col("rule").rlike("^(dependency|architecture)[.]"), "structure").when(F.col("rule").startswith("duplication."), "clones").otherwise("hotspots")
    return worklist.top_places(worklist.places(report.findings.withColumn("section", section)), n)
