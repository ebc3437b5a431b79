"""Files: languages, scopes, tokens, adapters, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import glob_any, tokens

#: Extensions of the languages that are known; a header counts as C.
EXTENSIONS = {
    ".c": "C", ".h": "C", ".cc": "C++", ".cpp": "C++", ".cxx": "C++", ".c++": "C++", ".hh": "C++", ".hpp": "C++", ".hxx": "C++", ".h++": "C++", ".go": "Go", ".java": "Java",
    ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".py": "Python", ".pyw": "Python", ".ts": "TypeScript", ".tsx": "TypeScript", ".mts": "TypeScript", ".cts": "TypeScript",
}


def language_of(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds language, by the extension in lower case; Unknown for others."""
    known = F.create_map(*[F.lit(x) for item in EXTENSIONS.items() for x in item])
    return files.withColumn("language", F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))), F.lit("Unknown")))


def language_histogram(files: DataFrame, language: str) -> DataFrame:
    """(language, files), Unknown included."""
    return files.groupBy(F.coalesce(F.lower(language), F.lit("Unknown")).alias("language")).agg(F.count("*").alias("files"))


def token_totals(files: DataFrame) -> DataFrame:
    """(scope, key, tokens) of each file, and of the repository, in one pass over the texts."""
    each = files.select("path", F.size(tokens(F.col("code"))).cast("long").alias("n"))
    sets = each.groupingSets([["path"], []], "path").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.grouping("path").alias("whole"))
    return sets.select(F.when(F.col("whole") == 1, "repository").otherwise("file").alias("scope"), F.when(F.col("whole") == 1, "repository").otherwise(F.col("path")).alias("key"), "tokens")


def total_tokens(files: DataFrame) -> DataFrame:
    """files (code, ok) -> one row (status, tokens): not_applicable without files, unavailable if any could not be analysed."""
    counts = files.agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("lost"), F.coalesce(F.sum(F.when(F.col("ok"), F.greatest(F.size(tokens(F.col("code"))), F.lit(0)))), F.lit(0)).cast("long").alias("t"))
    status = F.when(F.col("n") == 0, "not_applicable").when(F.col("lost") > 0, "unavailable").otherwise("measured")
    return counts.select(status.alias("status"), F.when(status == "measured", F.col("t")).alias("tokens"))


def corpus_report(files: DataFrame, by: list[str]) -> DataFrame:
    """files (by, code, ok, functions) -> (by, files, parsed, failed, functions, bytes); functions of failed files do not count."""
    ok = F.coalesce("ok", F.lit(False))
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.count_if(ok).alias("parsed"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("functions"))), F.lit(0)).cast("long").alias("functions"), F.coalesce(F.sum(F.octet_length("code")), F.lit(0)).cast("long").alias("bytes"))


def scope_of(files: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Adds scope: excluded before included; what nothing includes is unmatched."""
    path = F.col("path")
    return files.withColumn("scope", F.when(glob_any(path, exclude), "excluded").when(glob_any(path, include), "included").otherwise("unmatched"))


def adapter_summary(files: DataFrame, adapters: list[str]) -> DataFrame:
    """files (adapter, ok) -> (adapter, files, complete) of each adapter; one without files is complete."""
    counts = files.groupBy("adapter").agg(F.count("*").alias("files"), F.bool_and("ok").alias("complete"))
    every = files.sparkSession.createDataFrame([(a,) for a in adapters], "adapter string")
    return every.join(counts, "adapter", "left").select("adapter", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("complete", F.lit(True)).alias("complete"))


def evidence(rows: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Adds the named fields of a JSON column, read as a variant; a missing or badly typed field is null."""
    parsed = rows.withColumn("_evidence", F.try_parse_json(column))
    return parsed.select("*", *[F.try_variant_get("_evidence", f"$.{n}", kind).alias(n) for n, kind in fields.items()]).drop("_evidence")


def snapshot_digest(files: DataFrame) -> DataFrame:
    """One row (files, digest): equal for equal collections of (path, content), whatever the order; partial results combine.

    Each file's path and content hash give a SHA-256, whose eight lanes of 32 bits are added up apart (exactly, in
    decimals); the digest is the SHA-256 of the sums. Repeated rows count each: they do not cancel.
    """
    each = files.select(F.sha2(F.concat_ws("\0", "path", F.sha2("code", 256)).cast("binary"), 256).alias("h"))
    lanes = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20, 0)") for i in range(8)]
    sums = each.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(x), F.lit(0)).cast("string").alias(f"l{i}") for i, x in enumerate(lanes)])
    return sums.select("files", F.sha2(F.concat_ws("-", *[f"l{i}" for i in range(8)]).cast("binary"), 256).alias("digest"))
