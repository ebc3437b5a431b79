"""Checking a source tree: scan, facts, measurements, findings and the gate, as one chain of DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.python_facts import facts
from plumbline.functions.scalars import glob_any, short_id, tokens
from plumbline.operators import clones, coverage, files, graph, policy, resolve, scopes
from plumbline.operators.tables import written
from plumbline.sources import config as configuration
from plumbline.sources.tree import exclusions, list_tree, read_files

FACTS = """path string, error string, imports array<struct<specifier: string, line: int, kind: string>>, spans array<struct<line: int, end_line: int>>,
    functions array<struct<name: string, line: int, end_line: int, cyclomatic: double, cognitive: double, nesting_depth: double, function_lines: double, parameter_count: double>>"""
FUNCTION_METRICS = {"cyclomatic": "complexity.cyclomatic", "cognitive": "complexity.cognitive", "nesting_depth": "complexity.nesting_depth", "function_lines": "size.function_lines", "parameter_count": "size.parameter_count"}


@dataclass
class Report:
    files: DataFrame
    measurements: DataFrame
    findings: DataFrame
    diagnostics: DataFrame
    gate: DataFrame
    adapters: DataFrame | None = None  # (adapter, files, complete)
    languages: DataFrame | None = None  # (language, files)
    corpus: DataFrame | None = None  # (language, files, parsed, failed, functions, bytes)
    exclusions: DataFrame | None = None  # (files, directories), of a tree


def python_facts(sources: DataFrame) -> DataFrame:
    """(path, error, imports, spans, functions) of each Python file; a file that cannot be parsed is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [facts(code) for code in batch["code"]]
            yield pd.DataFrame({"path": batch["path"], "error": [f["error"] for f in found], "imports": [f["imports"] for f in found], "spans": [f["spans"] for f in found], "functions": [f["functions"] for f in found]})

    return sources.select("path", "code").mapInPandas(run, FACTS)


def named_functions(parsed: DataFrame) -> DataFrame:
    """parsed (path, functions) -> (path, symbol, line, end_line, and five numbers) of each function."""
    functions = parsed.select("path", F.posexplode("functions").alias("n", "f")).select("path", "n", "f.*")
    return scopes.symbol_ordinals(functions, ["path"], "name", ["line", "n"])


def function_measurements(parsed: DataFrame) -> DataFrame:
    """parsed (path, functions) -> (key, metric, value), five of each function."""
    named = named_functions(parsed).withColumn("key", F.concat_ws("::", "path", "symbol"))
    return named.unpivot(["key"], list(FUNCTION_METRICS), "metric", "value").replace(FUNCTION_METRICS, subset=["metric"])


def clone_findings(sources: DataFrame, functions: DataFrame, config: dict) -> DataFrame:
    """sources (path, code, spans) and functions (path, symbol, line, end_line) -> a finding for each region of copies.

    A copy is named after the innermost function around its first line. current is the lines of all copies; there is no
    threshold of its own, and severity and blocking are those of the density.
    """
    groups = clones.clone_groups(sources, config["clones"]["minTokens"], config["clones"]["minLines"])
    places = groups.select("path", F.col("line").alias("point_id"), F.col("line").alias("at")).distinct()
    spans = functions.select("path", F.col("symbol").alias("span_id"), F.col("line").alias("start"), F.col("end_line").alias("stop"))
    owners = scopes.enclosing_span(places, spans, "path").select("path", F.col("point_id").alias("line"), F.col("span_id").alias("symbol"))
    copies = groups.join(owners, ["path", "line"], "left").select("clone", "tokens", F.col("path").alias("file"), "symbol", F.col("line").alias("start"), F.col("end_line").alias("stop"))
    policy_of, rule = config["policies"]["duplication.token_clone_density"], "duplication.token_clone"
    found = clones.clone_findings(copies)
    return found.select(short_id(F.lit(rule), F.col("key")).alias("finding_id"), F.lit(rule).alias("rule"), "key", F.col("lines").cast("double").alias("current"), F.lit(None).cast("double").alias("threshold"), F.lit(policy_of["severity"]).alias("severity"), F.lit(policy_of["blocking"]).alias("blocking"), "message")


def check_files(sources: DataFrame, config: dict | None = None, lcov: DataFrame | None = None, changed: DataFrame | None = None) -> Report:
    """sources (path, code) -> the report. Excluded before included; other languages are measured by file only.

    lcov (source, kind, line, hits), mapped to paths, and changed (source, line) add coverage.
    """
    spark, config = sources.sparkSession, configuration.checked(config or configuration.default_config())
    taken = written(files.language_of(sources.where(~glob_any(F.col("path"), config["exclude"]) & glob_any(F.col("path"), config["include"]))), "sources")  # read once
    parsed = written(python_facts(taken.where("language = 'Python'")), "facts")

    measured = function_measurements(parsed)
    size = taken.join(parsed.where("error is not null").select("path"), "path", "left_anti").select(F.col("path").alias("key"), F.lit("size.file_tokens").alias("metric"), F.size(tokens(F.col("code"))).cast("double").alias("value"))
    cloned = taken.select("path", "code").join(parsed.select("path", "spans"), "path", "left")
    share = written(clones.clone_density(cloned, config["clones"]["minTokens"], config["clones"]["minLines"]), "density")  # one row
    density = share.select(F.lit("repository").alias("key"), F.lit("duplication.token_clone_density").alias("metric"), F.col("density").alias("value"))

    imports = parsed.select("path", F.posexplode("imports").alias("seq", "i")).select("path", "seq", "i.*")
    resolved = written(resolve.resolve_python(imports, taken.where("language = 'Python'")), "imports")
    edges = graph.edges_of(resolved.where("resolution = 'internal'").select(F.col("path").alias("src"), F.col("target").alias("dst"), "line", F.struct("path", "seq").alias("ord")))
    fan = graph.fan_metrics(edges, taken.select(F.col("path").alias("node")))
    coupling = fan.select(F.col("node").alias("key"), F.expr("stack(2, 'coupling.module_fan_out', cast(fan_out as double), 'coupling.module_fan_in', cast(fan_in as double)) as (metric, value)"))
    states = taken.join(parsed.select("path", F.col("error").isNull().alias("ok")), "path", "left").select("code", F.coalesce("ok", F.lit(True)).alias("ok"))
    total = files.total_tokens(states).select(F.lit("repository").alias("key"), F.lit("size.total_tokens").alias("metric"), F.col("tokens").cast("double").alias("value"))
    measurements = measured.unionByName(size).unionByName(total).unionByName(density).unionByName(coupling)
    if lcov is not None:
        measurements = measurements.unionByName(coverage.measurements(lcov, changed))

    # a measurement is compared with one of the same variant only
    variant = f"tokens:{config['clones']['minTokens']},lines:{config['clones']['minLines']}"
    measurements = measurements.withColumn("variant", F.when(F.col("metric") == "duplication.token_clone_density", variant).otherwise(""))

    rules = lambda rule, key, message: [F.sha2(F.concat_ws("\0", F.lit(rule), key), 256).substr(1, 20).alias("finding_id"), F.lit(rule).alias("rule"), key.alias("key"), F.lit(1.0).alias("current"), F.lit(0.0).alias("threshold"), F.lit("error").alias("severity"), F.lit(True).alias("blocking"), message.alias("message")]
    loops = graph.cycle_keys(graph.components(edges))
    found = policy.threshold_findings(measurements, configuration.policies(spark, config))
    found = found.unionByName(loops.select(*rules("dependency.cycle", F.col("cycle_key"), F.concat(F.lit("a cycle of "), F.col("members").cast("string"), F.lit(" modules")))))
    limit, measured_share = config["policies"]["duplication.token_clone_density"], share.first()["density"]
    if limit["enabled"] and measured_share is not None and measured_share > limit["threshold"]:
        found = found.unionByName(clone_findings(cloned, named_functions(parsed), config))
    if config["layers"]:
        owners = taken.select(F.col("path").alias("node"), graph.owner(F.col("path"), [(x["name"], x["include"]) for x in config["layers"]]).alias("layer"))
        broken = graph.layer_violations(edges, owners, {x["name"]: x["mayDependOn"] for x in config["layers"]})
        found = found.unionByName(broken.select(*rules("architecture.boundary_violation", F.concat_ws("->", "src", "dst"), F.concat_ws(" may not depend on ", "src_layer", "dst_layer"))))

    failed = parsed.where("error is not null").select(F.lit("python.parse_failed").alias("code"), F.lit("error").alias("severity"), "error", "path", F.lit(True).alias("required"))
    lost = resolved.where("resolution = 'unresolved'").select(F.lit("dependency.import_unresolved").alias("code"), F.lit("warning").alias("severity"), F.col("specifier").alias("error"), "path", F.lit(False).alias("required"))
    diagnostics = failed.unionByName(lost).withColumnRenamed("error", "message").withColumnRenamed("path", "file")
    external = graph.external_diagnostic(resolved).select("code", "severity", "message", F.lit("").alias("file"), F.lit(False).alias("required"))
    diagnostics = diagnostics.unionByName(external)
    analysed = parsed.select(F.lit("python").alias("adapter"), F.col("error").isNull().alias("ok"))
    histogram = taken.groupBy("language").agg(F.count("*").alias("files"))
    facts_of = parsed.select("path", F.col("error").isNull().alias("ok"), F.size("functions").alias("functions"))
    corpus = files.corpus_report(taken.join(facts_of, "path", "left").withColumn("ok", F.coalesce("ok", F.lit(True))), ["language"])
    return Report(taken, measurements, found, diagnostics, policy.gate(found, diagnostics), files.adapter_summary(analysed, ["python"]), histogram, corpus)


def check(spark: SparkSession, root: str, config_path: str | None = None) -> Report:
    """The report of the tree under root. Files that the configuration leaves out are listed and counted, and never opened."""
    config = configuration.load(config_path)
    entries = list_tree(spark, root, config["include"], config["exclude"])
    report = check_files(read_files(entries, root), config)
    report.exclusions = exclusions(entries)
    return report
