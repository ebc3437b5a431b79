"""Thresholds and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import blocks_gate, exceeds, is_active, number_text, short_id


def threshold_findings(measurements: DataFrame, policies: DataFrame) -> DataFrame:
    """measurements (metric, key, value) above their policy (metric, enabled, threshold, severity, blocking).

    The comparison is strict; a null value is never above. policies is the configuration, one row a metric.
    """
    joined = measurements.join(F.broadcast(policies), "metric").where(F.col("value").isNotNull() & exceeds(F.col("value"), F.col("threshold"), F.col("enabled")))
    message = F.concat(F.col("metric"), F.lit(" is "), number_text(F.col("value")), F.lit("; the limit is "), number_text(F.col("threshold")))
    return joined.select(short_id(F.col("metric"), F.col("key")).alias("finding_id"), F.col("metric").alias("rule"), "key", F.col("value").alias("current"), "threshold", "severity", "blocking", message.alias("message"))


def gate(findings: DataFrame, incomplete: bool | DataFrame = False) -> DataFrame:
    """One row (status, blocking, warnings): incomplete before failed before passed. Counts are partial sums.

    Where findings have a classification, only new and worsened ones block, and resolved ones are no warnings; without
    one all are new. A null blocking is a warning. No findings: passed.
    """
    kind = F.col("classification") if "classification" in findings.columns else F.lit(None).cast("string")
    blocking = F.coalesce("blocking", F.lit(False))
    marks = findings.select(blocks_gate(blocking, kind).alias("b"), (~blocking & is_active(kind)).alias("w"), F.lit(False).alias("e"))
    if isinstance(incomplete, DataFrame):  # diagnostics with required and severity
        marks = marks.unionByName(incomplete.select(F.lit(False).alias("b"), F.lit(False).alias("w"), (F.col("required") & (F.col("severity") == "error")).alias("e")))
    counts = marks.agg(F.count_if("b").alias("blocking"), F.count_if("w").alias("warnings"), (F.count_if("e") + int(incomplete is True)).alias("errors"))
    status = F.when(F.col("errors") > 0, "incomplete").when(F.col("blocking") > 0, "failed").otherwise("passed")
    return counts.select(status.alias("status"), "blocking", "warnings")
