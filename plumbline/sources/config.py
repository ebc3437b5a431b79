"""The configuration: defaults, and strict checking of a given document (unknown or missing fields are errors)."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.scalars import glob_regex

#: Metric, default threshold.
THRESHOLDS = {
    "complexity.cyclomatic": 12.0,
    "complexity.cognitive": 15.0,
    "complexity.nesting_depth": 4.0,
    "size.function_lines": 80.0,
    "size.parameter_count": 5.0,
    "size.file_tokens": 4000.0,
    "duplication.token_clone_density": 5.0,
    "coupling.module_fan_out": 20.0,
}
SEVERITIES = ("info", "warning", "error")


def default_config() -> dict:
    rules = {m: {"enabled": True, "threshold": t, "severity": "error", "blocking": True} for m, t in THRESHOLDS.items()}
    return {"schemaVersion": "1.0", "include": ["**/*"], "exclude": [], "policies": rules, "clones": {"minTokens": 50, "minLines": 5}, "layers": []}


def checked(config: dict) -> dict:
    """The document itself, or ValueError with the first thing that is wrong."""

    def fields(value, names, where):
        if not isinstance(value, dict) or set(value) != set(names):
            raise ValueError(f"{where}: expected exactly the fields {sorted(names)}")

    def patterns(globs, where):
        for g in globs:
            try:
                re.compile(glob_regex(g))
            except (ValueError, re.error) as e:
                raise ValueError(f"{where}: invalid pattern {g!r}") from e

    fields(config, default_config(), "configuration")
    if config["schemaVersion"] != "1.0":
        raise ValueError("schemaVersion: only 1.0 is known")
    for name in ("include", "exclude"):
        if not all(isinstance(p, str) for p in config[name]):
            raise ValueError(f"{name}: patterns are texts")
        patterns(config[name], name)
    fields(config["policies"], THRESHOLDS, "policies")
    for metric, rule in config["policies"].items():
        fields(rule, ("enabled", "threshold", "severity", "blocking"), metric)
        t = rule["threshold"]
        if isinstance(t, bool) or not isinstance(t, (int, float)) or not math.isfinite(t) or t < 0:
            raise ValueError(f"{metric}: the threshold is a finite number from 0")
        if rule["severity"] not in SEVERITIES:
            raise ValueError(f"{metric}: unknown severity")
    fields(config["clones"], ("minTokens", "minLines"), "clones")
    if any(not isinstance(v, int) or isinstance(v, bool) or v < 1 for v in config["clones"].values()):
        raise ValueError("clones: whole numbers from 1")
    names = [layer.get("name") for layer in config["layers"]]
    for layer in config["layers"]:
        fields(layer, ("name", "include", "mayDependOn"), "layers")
        patterns(layer["include"], f"layers: {layer['name']}")
        if not set(layer["mayDependOn"]) <= set(names):
            raise ValueError(f"layers: {layer['name']} names an unknown layer")
    if len(set(names)) != len(names):
        raise ValueError("layers: names differ")
    return config


def load(path: str | None) -> dict:
    """The checked document in a file, or the defaults without one."""
    if path is None:
        return default_config()
    with open(path, encoding="utf-8") as f:
        return checked(json.load(f))


def policies(spark: SparkSession, config: dict) -> DataFrame:
    rows = [(m, r["enabled"], float(r["threshold"]), r["severity"], r["blocking"]) for m, r in config["policies"].items()]
    return spark.createDataFrame(rows, "metric string, enabled boolean, threshold double, severity string, blocking boolean")
