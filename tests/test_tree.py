"""Listing and reading trees, and reports as single documents."""

import json
import os

import pytest
from pyspark.sql import functions as F

from plumbline.plans import check as plan
from plumbline.plans import report
from plumbline.sources import tree
from plumbline.sources.document import write_document


@pytest.fixture
def folder(tmp_path):
    for name in ["src/b.ts", "src/a.tsx", "src/readme.md", "node_modules/p/i.js", "dist/bundle.js", "lib/app.min.js", "lib/deep/dist/x.ts", "tests/unit.test.ts", ".hidden/_x.ts", "_y.ts"]:
        os.makedirs(tmp_path / "t" / os.path.dirname(name), exist_ok=True)
        (tmp_path / "t" / name).write_text("export const x = 1;\n")
    os.symlink(tmp_path / "t/src", tmp_path / "t/link")
    os.symlink(tmp_path / "t/_y.ts", tmp_path / "t/lib/also.ts")
    os.chmod(tmp_path / "t/lib/app.min.js", 0)
    return str(tmp_path / "t")


def test_listing_prunes_and_counts(spark, folder):
    entries = tree.list_tree(spark, folder, ["**/*.ts", "**/*.tsx", "**/*.js"], ["**/dist/**", "**/*.min.js", "[broken"])
    kinds = {}
    for r in entries.collect():
        kinds.setdefault(r["kind"], set()).add(r["path"])
    assert kinds == {"included": {"src/b.ts", "src/a.tsx", "tests/unit.test.ts", ".hidden/_x.ts", "_y.ts"}, "unmatched": {"src/readme.md"}, "excluded": {"link", "lib/also.ts", "lib/app.min.js"}, "excluded_folder": {"node_modules", "dist", "lib/deep/dist"}}
    assert tuple(tree.exclusions(entries).first()) == (3, 3)
    assert {r["path"] for r in tree.read_files(entries, folder).collect()} == kinds["included"]
    os.makedirs(os.path.join(folder, "empty"))
    assert tree.read_tree(spark, os.path.join(folder, "empty")).count() == 0


def test_documents(spark, tmp_path):
    path = f"{tmp_path}/x.json"
    items = spark.range(1000).repartition(7).select(F.to_json(F.struct("id", F.lit('"é\n').alias("t"))).alias("j")).orderBy(F.get_json_object("j", "$.id").cast("int"))
    none = items.where("j is null")
    write_document(spark, ['{"a":[', items, '],"b":[', none, "]}"], path)
    got = json.load(open(path))
    assert [r["id"] for r in got["a"]] == list(range(1000)) and got["a"][5]["t"] == '"é\n' and got["b"] == []
    with pytest.raises(FileExistsError):
        write_document(spark, ["{}"], path)
    with pytest.raises(Exception):
        write_document(spark, ["[", items.select(F.raise_error(F.lit("no"))), "]"], path, replace=True)
    assert json.load(open(path)) == got
    write_document(spark, ["{}"], path, replace=True)
    assert json.load(open(path)) == {}


def test_report_documents(spark, tmp_path, folder):
    body = "(a, b, c, d, e, f):\n    total = 0\n    for x in a:\n        total += x * 2\n        total -= 1\n    return total\n"
    for name, code in {"p/__init__.py": "", "p/a.py": "import p.b\n\n\ndef one" + body, "p/b.py": "import p.a\n\n\ndef two" + body, "p/bad.py": "def (:\n", "p/out.py": "x = 1\n"}.items():
        os.makedirs(os.path.join(folder, "py", os.path.dirname(name)), exist_ok=True)
        open(os.path.join(folder, "py", name), "w").write(code)
    rules = plan.configuration.default_config() | {"clones": {"minTokens": 8, "minLines": 2}, "exclude": ["**/out.py"]}
    (tmp_path / "c.json").write_text(json.dumps(rules))
    found = plan.check(spark, os.path.join(folder, "py"), str(tmp_path / "c.json"))
    assert tuple(found.exclusions.first()) == (1, 0) and {tuple(r) for r in found.adapters.collect()} == {("python", 4, False)}
    assert {tuple(r) for r in found.languages.collect()} == {("Python", 4)}
    report.write_sarif(found, f"{tmp_path}/r.sarif")
    run = json.load(open(f"{tmp_path}/r.sarif"))["runs"][0]
    rules = [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert rules == sorted(rules) and {"dependency.cycle", "duplication.token_clone", "size.parameter_count"} <= set(rules)
    assert run["invocations"][0]["executionSuccessful"] is False and run["invocations"][0]["toolExecutionNotifications"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "p/bad.py"
    uri = lambda x: x["physicalLocation"]["artifactLocation"]["uri"]
    for r in run["results"]:
        assert rules[r["ruleIndex"]] == r["ruleId"]
        if r["ruleId"] in ("dependency.cycle", "duplication.token_clone"):
            assert uri(r["locations"][0]) == "p/a.py" and [uri(x) for x in r["relatedLocations"]] == ["p/b.py"]
    report.write_report(found, f"{tmp_path}/r.json")
    whole = json.load(open(f"{tmp_path}/r.json"))
    assert whole["policy"]["status"] == "incomplete" and len(whole["findings"]) == len(run["results"]) and whole["measurements"][0]["metric"] <= whole["measurements"][-1]["metric"]
