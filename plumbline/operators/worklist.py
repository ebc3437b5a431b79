"""Ranking what to fix first, and counting attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import excess, glob_any
from plumbline.operators.tables import written


def kept(findings: DataFrame, rules: list[str] = (), paths: list[str] = ()) -> DataFrame:
    """findings (rule, files, ...) of the given rules and with any file that matches any of the path patterns; none given: all."""
    out = findings.where(F.col("rule").isin(list(rules))) if rules else findings
    return out.where(F.exists("files", lambda f: glob_any(f, list(paths)))) if paths else out


def ordered_sections(entries: DataFrame) -> DataFrame:
    """entries (section, rule, key, current, rules, excess, file, line) with their rank in their section.

    structure goes by rule and key, clones by lines (current) from the largest and key, all others by rules and excess
    from the largest, file, line and key. A missing current counts as 0.
    """
    structure, is_clone = F.col("section") == "structure", F.col("section") == "clones"
    size = F.when(is_clone, -F.coalesce("current", F.lit(0.0))).when(~structure, -F.col("rules").cast("double"))
    other = F.when(~structure & ~is_clone, -F.col("excess"))
    by = Window.partitionBy("section").orderBy(F.when(structure, F.col("rule")), size, other, F.when(~structure & ~is_clone, F.col("file")), F.when(~structure & ~is_clone, F.col("line")), "key")
    return entries.withColumn("rank", F.row_number().over(by))


def places(findings: DataFrame) -> DataFrame:
    """findings (section, key, rule, current, threshold) -> (section, key, rules, excess)."""
    return findings.groupBy("section", "key").agg(F.count_distinct("rule").alias("rules"), F.max(excess(F.col("current"), F.col("threshold"))).alias("excess"))


def nested(findings: DataFrame) -> DataFrame:
    """findings (file, symbol, line, rule, current, threshold) -> (file, symbol, line, parent, root, depth, trail, rules, excess) of each place.

    A place is a function (symbol) of a file, or a file (null or empty symbol). A function is folded into the longest one
    of the same file that has findings and whose dotted name begins its own; a file takes no functions in. rules counts
    the different rules of a place and of the places folded directly into it; excess is the largest of all that is folded
    into it at any depth. root and depth name the outermost place and the steps to it, trail has (line, symbol) of all of
    them and of the place. Rows of a place with several lines
    have the first one's; null files are one file. Only names are compared, so functions of one file meet nowhere.
    """
    symbol = F.coalesce("symbol", F.lit(""))
    rows = findings.select("file", symbol.alias("symbol"), "line", "rule", excess(F.col("current"), F.col("threshold")).alias("excess"))
    own = rows.groupBy("file", "symbol").agg(F.min("line").alias("line"), F.collect_set("rule").alias("rules"), F.max("excess").alias("excess"))
    own = written(own.withColumn("file", F.coalesce("file", F.lit(""))), "places")
    parts = F.split("symbol", r"\.")
    outer = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    prefixes = own.where(F.size(parts) > 1).select("file", "symbol", F.explode(outer).alias("above"))
    # every place above, the nearest last: names are short, so this is the whole chain of each place
    above = prefixes.join(own.where("symbol <> ''").select("file", F.col("symbol").alias("above"), F.col("line").alias("_line")), ["file", "above"])
    chain = above.groupBy("file", "symbol").agg(F.min_by("above", F.length("above")).alias("root"), F.max_by("above", F.length("above")).alias("parent"), F.count("*").alias("depth"), F.sort_array(F.collect_list(F.struct(F.length("above").alias("n"), F.col("_line").alias("line"), F.col("above").alias("symbol")))).alias("_up"))
    placed = written(own.join(chain, ["file", "symbol"], "left"), "places")
    direct = placed.where("parent is not null").select("file", F.col("parent").alias("symbol"), F.explode("rules").alias("rule"))
    counted = direct.unionByName(placed.select("file", "symbol", F.explode("rules").alias("rule"))).groupBy("file", "symbol").agg(F.count_distinct("rule").alias("rules"))
    inside = above.join(own.select("file", "symbol", "excess"), ["file", "symbol"]).select("file", F.col("above").alias("symbol"), "excess")
    most = inside.unionByName(own.select("file", "symbol", "excess")).groupBy("file", "symbol").agg(F.max("excess").alias("excess"))
    itself = F.array(F.struct("line", "symbol"))
    trail = F.coalesce(F.concat(F.transform("_up", lambda x: F.struct(x["line"].alias("line"), x["symbol"].alias("symbol"))), itself), itself)
    joined = placed.select("file", "symbol", "line", "parent", F.coalesce("root", "symbol").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"), trail.alias("trail"))
    return joined.join(counted, ["file", "symbol"]).join(most, ["file", "symbol"])


def nested_order(places: DataFrame) -> DataFrame:
    """places of nested(): the outermost by rules and excess from the largest, file, line and symbol, each followed by what is folded into it, by line at each level."""
    roots = places.where("depth = 0").select("file", F.col("symbol").alias("root"), F.struct((-F.col("rules")).alias("rules"), (-F.col("excess")).alias("excess"), "file", "line", "symbol").alias("_first"))
    return places.join(roots, ["file", "root"]).orderBy("_first", "trail").drop("_first")


def top_places(found: DataFrame, n: int) -> DataFrame:
    """The n first places of each section (0: all), by rules and excess from the largest, with rank and how many are left out.

    The ranked rows are limited before the shuffle; the sections' totals are partial counts.
    """
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("rules"), F.desc("excess"), "key"))
    ranked = found.withColumn("rank", rank)
    kept = ranked.where(F.col("rank") <= n) if n else ranked
    totals = found.groupBy("section").agg(F.count("*").alias("total"))
    left_out = F.greatest(F.col("total") - n, F.lit(0)) if n else F.lit(0)
    return kept.join(totals, "section").select("section", "rank", "key", "rules", "excess", left_out.cast("long").alias("omitted"))


def attempts(runs: DataFrame, session: str, order: list[str], failed: str, passed: str, most: int = 2) -> DataFrame:
    """Each failed run with its number since the last pass, and whether it still blocks (up to most times)."""
    upto = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    since = runs.where(f"({failed}) or ({passed})").withColumn("era", F.sum(F.expr(passed).cast("int")).over(upto))
    n = F.row_number().over(Window.partitionBy(session, "era").orderBy(*order))
    return since.where(failed).withColumn("attempt", n.cast("long")).withColumn("blocks", F.col("attempt") <= most).drop("era")
