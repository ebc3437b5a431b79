"""Coverage reports and diffs: parsed from text lines, then counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import percent
from plumbline.operators.scopes import carried
from plumbline.operators.tables import fresh


def _whole(text: Column) -> Column:
    """A whole number of 64 bits; null for any other text, also for one that is too large."""
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def lcov_entries(lines: DataFrame) -> DataFrame:
    """lines (report, no, text) -> (report, source, kind, line, branch, hits): DA and BRDA entries of each record.

    A record begins with SF and ends with end_of_record or the end of the report; one that another SF cuts off is
    dropped. Entries outside of records and those with bad or too large numbers are skipped; of several DA entries for a
    line the last counts; a taken count that is no number is null. Carriage returns at the end of lines do not count. What
    record a line is in is carried along blocks of lines, so that one huge report is many tasks.
    """
    read = lines.select("report", "no", F.regexp_replace("text", r"\r+$", "").alias("text"))
    begins, ends = F.col("text").startswith("SF:"), F.col("text") == "end_of_record"
    named = F.when(begins, F.expr("substring(text, 4)")).when(ends, F.lit(""))
    placed = carried(read, "report", "no", {"source": named}, {"record": begins}, {"next": F.when(begins, "SF").when(ends, "end")})
    kind = F.when(F.col("text").startswith("DA:"), "line").when(F.col("text").startswith("BRDA:"), "branch")
    inside = placed.where("source <> '' and coalesce(next, 'end') = 'end'").withColumn("kind", kind).where("kind is not null")
    fields = inside.withColumn("f", F.split(F.regexp_replace("text", "^[A-Z]+:", ""), ","))
    is_line = F.col("kind") == "line"
    branch = F.when(~is_line, F.when(F.size("f") > 2, F.concat_ws(",", F.get("f", 1), F.get("f", 2))).otherwise(""))
    read = fields.select("report", "record", "source", "no", "kind", _whole(F.get("f", 0)).alias("line"), branch.alias("branch"), _whole(F.when(is_line, F.get("f", 1)).otherwise(F.get("f", 3))).alias("hits"))
    good = read.where(F.col("line").isNotNull() & (~is_line | F.col("hits").isNotNull()))
    each = good.groupBy("report", "record", "source", "kind", "line", "branch", F.when(~is_line, F.col("no")).alias("_entry"))  # branch entries stay apart
    return each.agg(F.max_by("hits", "no").alias("hits")).select("report", "source", "kind", "line", "branch", "hits")


def covered(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, kind, covered, total, percent): branches that are not known do not count; a total of 0 has no percent."""
    known = (F.col("kind") == "line") | F.col("hits").isNotNull()
    counts = entries.groupBy(*by, "kind").agg(F.count_if(known & (F.col("hits") > 0)).alias("covered"), F.count_if(known).alias("total"))
    return counts.withColumn("percent", percent(F.col("covered"), F.col("total")))


def on_changed_lines(entries: DataFrame, changed: DataFrame) -> DataFrame:
    """Entries on changed lines: a semi-join on (source, line)."""
    return entries.join(changed.select("source", "line"), ["source", "line"], "left_semi")


#: Fixed value: the header of a hunk in a unified diff, with the start and count of its new lines.
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def added_lines(lines: DataFrame) -> DataFrame:
    """lines (diff, no, text) -> (diff, file, line) of added lines.

    '+++ b/x' names the file, any other '+++ ' clears it. A hunk's missing count is 1, and a count of 0 adds nothing; one
    with a number of more than 64 bits is skipped. The file is carried along blocks of lines.
    """
    lines = lines.select("diff", "no", F.regexp_replace("text", r"\r+$", "").alias("text"))
    named = F.when(F.col("text").startswith("+++ b/"), F.expr("substring(text, 7)")).when(F.col("text").startswith("+++ "), F.lit(""))
    at = carried(lines, "diff", "no", {"file": named}, {}, {}).where(F.col("text").rlike(HUNK) & (F.col("file") != ""))
    start, count = (F.regexp_extract("text", HUNK, i) for i in (1, 2))
    sized = at.select("diff", "file", _whole(start).alias("start"), F.when(count == "", F.lit(1)).otherwise(_whole(count)).alias("n")).where("n > 0 and start is not null")
    return sized.select("diff", "file", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("line"))


def all_lines(files: DataFrame) -> DataFrame:
    """Every line of an untracked file is changed: files (file, text) -> (file, line)."""
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    return files.select("file", F.explode(F.sequence(F.lit(1), n)).alias("line"))


def map_sources(entries: DataFrame, files: DataFrame, report_folder: str) -> DataFrame:
    """entries (source, ...) with the path of the analysed file: relative to the report's folder, else to the root; unmapped ones go."""
    paths = files.select("path").distinct()
    n, r = fresh("_near", entries.columns), fresh("_root", entries.columns)
    near, root = paths.select(F.col("path").alias(n)), paths.select(F.col("path").alias(r))
    below = F.concat(F.lit(report_folder.rstrip("/") + "/" if report_folder else ""), F.col("source"))
    joined = entries.join(near, below == F.col(n), "left").join(root, F.col("source") == F.col(r), "left")
    return joined.withColumn("path", F.coalesce(n, r)).where(F.col("path").isNotNull()).drop(n, r)


def fresh_only(entries: DataFrame, files: DataFrame, report_time) -> DataFrame:
    """Entries of files (path, modified) that are not newer than the report by more than a millisecond."""
    old = files.where(F.col("modified") <= report_time + F.expr("interval '0.001' second")).select("path")
    return entries.join(old, "path", "left_semi")


#: The metrics of an entry's kind, over all lines and over changed ones.
METRICS = {("line", False): "coverage.line", ("branch", False): "coverage.branch", ("line", True): "coverage.changed_line", ("branch", True): "coverage.changed_branch"}


def measurements(entries: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """entries (source, kind, line, hits) -> (metric, key, value): percentages of each file, null where nothing counts.

    changed (source, line) adds those of the changed lines, for files that it names.
    """
    known = (F.col("kind") == "line") | F.col("hits").isNotNull()
    hit = known & (F.col("hits") > 0)
    if changed is None:
        marked = entries.withColumn("_changed", F.lit(False))
    else:
        lines = changed.select("source", "line").distinct().withColumn("_changed", F.lit(True))
        marked = entries.join(lines, ["source", "line"], "left").withColumn("_changed", F.coalesce("_changed", F.lit(False)))
    on = F.col("_changed")
    counts = marked.groupBy("source", "kind").agg(F.count_if(hit).alias("c"), F.count_if(known).alias("t"), F.count_if(hit & on).alias("cc"), F.count_if(known & on).alias("tc"), F.count_if(on).alias("nc"))
    names = F.create_map(*[F.lit(x) for (k, c), m in METRICS.items() for x in (f"{k} {c}".lower(), m)])
    row = lambda is_changed, c, t: F.struct(names[F.concat("kind", F.lit(f" {is_changed}".lower()))].alias("metric"), percent(F.col(c), F.col(t)).alias("value"))
    both = F.when(F.col("nc") > 0, F.array(row(False, "c", "t"), row(True, "cc", "tc"))).otherwise(F.array(row(False, "c", "t")))
    return counts.select("source", F.explode(both).alias("m")).select("m.metric", F.col("source").alias("key"), "m.value")
