"""Comparing two snapshots: measurements, findings, renamed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.tables import fresh


def compare_measurements(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Each current row with baseline, delta and classification; all three null where either side has no measured value.

    Of previous rows with the same keys the last one (largest ord) counts; both sides have keys and value.
    """
    last = previous.groupBy(*keys).agg(F.max_by("value", "ord").alias("baseline"))
    baseline = F.when(F.col("value").isNotNull(), F.col("baseline"))
    delta = F.col("value") - F.col("baseline")
    kind = F.when(delta > 0, "worsened").when(delta < 0, "improved").when(delta == 0, "existing")
    return current.join(last, keys, "left").select(*keys, "value", baseline.alias("baseline"), delta.alias("delta"), kind.alias("classification"))


def compare_findings(current: DataFrame, previous: DataFrame, keys: list[str], measured: DataFrame | None = None) -> DataFrame:
    """new, worsened, existing or resolved, by a full outer join on keys; both sides have keys and current.

    measured (keys, baseline) has the compared measurements: where one has a baseline, it counts before that of the
    previous finding. A finding without a previous one is new all the same; a resolved one keeps its own value.
    """
    was, is_, by = (fresh(n, [*current.columns, *previous.columns]) for n in ("_was", "_is", "_measured"))
    before = previous.select(*keys, F.col("current").alias("before"), F.lit(True).alias(was))
    joined = current.withColumn(is_, F.lit(True)).join(before, keys, "full_outer")
    joined = joined.withColumn(by, F.lit(None).cast("double")) if measured is None else joined.join(measured.select(*keys, F.col("baseline").alias(by)), keys, "left")
    gone = F.col(is_).isNull()
    baseline = F.when(gone, F.col("before")).otherwise(F.coalesce(F.col(by), F.col("before")))
    delta = F.when(gone, -F.col("before")).otherwise(F.col("current") - baseline)
    kind = F.when(gone, "resolved").when(F.col(was).isNull(), "new").when(delta > 0, "worsened").otherwise("existing")
    return joined.select(*keys, "current", baseline.alias("baseline"), delta.alias("delta"), kind.alias("classification"))


def active(findings: DataFrame) -> DataFrame:
    """Findings that are not resolved."""
    return findings.where(F.col("classification") != "resolved")


def resolved(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("classification") == "resolved")


#: Columns that only a comparison gives.
COMPARED = ("baseline", "delta", "classification")


def stripped(rows: DataFrame) -> DataFrame:
    """rows as a baseline keeps them: without what the comparison added."""
    return rows.drop(*COMPARED)


def infer_renames(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(previous_path, path) of unedited moves: one current file alone has the hash, and the old path lost it."""
    once = current.groupBy("hash").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select("hash", "path")
    moved = previous.select(F.col("path").alias("previous_path"), "hash")
    still = current.select(F.col("path").alias("previous_path"), "hash")
    return moved.join(still, ["previous_path", "hash"], "left_anti").join(once, "hash").select("previous_path", "path")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; the limit works before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    helper = fresh("_place", rows.columns)
    return rows.withColumn(helper, place).where(F.col(helper) == 1).drop(helper)
