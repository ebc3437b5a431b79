"""The whole check over small trees, and facts of small sources whose numbers are counted by hand from the rules."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.functions.python_facts import facts
from plumbline.operators.resolve import resolve_python
from plumbline.plans import check as plan
from plumbline.plans import report
from plumbline.sources import baseline, config
from plumbline.sources.tree import read_tree
from plumbline.streaming.attempts import count_attempts

VAN = """class Van:
    def load(self, boxes, *, limit=10, **rest):
        for box in boxes:
            if box.heavy or box.wet or box.odd and limit:
                while limit:
                    limit -= 1
                else:
                    limit = 3
            elif box.light:
                continue
        try:
            self.close()
        except OSError:
            return None
        return rest
"""
PICK = """def pick(rows):
    kept = {r.name for r in rows if r.ok for t in r.tags}
    match kept:
        case []:
            return 1
        case [first, *_]:
            return first
        case _:
            return kept
"""
GIVEN = """def outer(step=1 if FLAG else 2):
    def inner(x, *, y=(5 if FLAG else 6)):
        if x:
            return y
    return lambda z=(7 if FLAG else 8): z and step
"""


def numbers(code, name):
    return next(f[3:] for f in facts(code)["functions"] if f[0] == name)


def test_numbers_of_functions():
    # cyclomatic: for, if, three operators, while, elif, except; cognitive: 1 + 2 + 2 (or, and) + 3 + 1 (else) + 1 (elif) + 1
    assert numbers(VAN, "Van.load") == (9, 11, 3, 14, 4)
    # cyclomatic: two clauses and a condition, two cases; cognitive: the match only
    assert numbers(PICK, "pick") == (6, 1, 1, 9, 1)
    assert facts("class :\n")["error"].startswith("1:") and facts("x = 1\n")["functions"] == []


def test_decorators_and_defaults_belong_to_the_outer_function():
    assert numbers(GIVEN, "outer")[:2] == (1, 5)  # defaults of the two inner ones 1 + 1, an if 2, an operator 1
    assert numbers(GIVEN, "outer.inner")[:3] == (2, 1, 1)
    assert numbers(GIVEN, "outer.<lambda>")[:2] == (2, 1)
    assert numbers("@wrap(1 if A else 2)\ndef f(a=1 if B else 2, *, b=(3 if C else 4)):\n    return a\n", "f")[:3] == (1, 0, 0)


def test_lines_of_functions():
    text = 'def f():\n    # alone\n\n    sql = """\n    # in a text\n\n    """\n    return sql  # behind\n'
    assert numbers(text, "f")[3] == 5
    assert numbers(text.replace("\n", "\r\n"), "f")[3] == 5


def test_imports_of_a_file():
    code = "from .. import up\nimport a.b, c as d\nif True:\n    from x.y import (p as q, r)\nfrom .z import *\nw = __import__('late')\nv = importlib.import_module('later.on')\nu = importlib.import_module(w)\n"
    assert [(s, line) for s, line, _ in facts(code)["imports"]] == [("..up", 1), ("a.b", 2), ("c", 2), ("x.y.p", 4), ("x.y.r", 4), (".z.*", 5), ("late", 6), ("later.on", 7)]


FILES = ["lib/core/__init__.py", "lib/core/io.py", "lib/core/net/__init__.py", "lib/core/net/http.py", "bin/run.py", "bin/shared.py"]
HTTP, IO, RUN = "lib/core/net/http.py", "lib/core/io.py", "bin/run.py"
CASES = [
    (HTTP, "..io.Reader", IO),  # a name inside a module
    (HTTP, "...core.io", IO),
    (HTTP, "....x", "unresolved"),  # above everything
    (HTTP, "io", "external"),  # a package's folder is no root
    (IO, "core.net", "lib/core/net/__init__.py"),
    (IO, "core.net.http.get", HTTP),
    (RUN, "shared", "bin/shared.py"),  # a script's folder is a root
    (RUN, "shared.tool", "bin/shared.py"),
    (RUN, ".shared", "bin/shared.py"),
    (RUN, "core.gone", "lib/core/__init__.py"),
    (RUN, "core.gone.deep", "unresolved"),
    (RUN, "json.decoder", "external"),
]


def test_import_resolution(spark):
    imports = spark.createDataFrame([c[:2] for c in CASES], "path string, specifier string")
    got = {(r["path"], r["specifier"]): r["target"] or r["resolution"] for r in resolve_python(imports, spark.createDataFrame([(f,) for f in FILES], "path string")).collect()}
    assert got == {c[:2]: c[2] for c in CASES}


@pytest.fixture
def tree(tmp_path):
    long = "def deep(a):\n" + "".join("    " * (i + 1) + "if a:\n" for i in range(6)) + "    " * 7 + "pass\n"
    for name, code in {"pkg/__init__.py": "", "pkg/a.py": "from . import b\n" + PICK, "pkg/b.py": "from pkg.a import pick\n" + long, "pkg/broken.py": "def f(:\n", "node_modules/x.py": long, "note.txt": "words"}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(code)
    os.symlink(tmp_path / "pkg", tmp_path / "link")
    return str(tmp_path)


def test_tree_source(spark, tree):
    assert sorted(r["path"] for r in read_tree(spark, tree).collect()) == ["note.txt", "pkg/__init__.py", "pkg/a.py", "pkg/b.py", "pkg/broken.py"]


def test_check(spark, tree, tmp_path):
    result = plan.check(spark, tree)
    by = {(r["metric"], r["key"]): r["value"] for r in result.measurements.collect()}
    assert by["complexity.cyclomatic", "pkg/a.py::pick"] == 6 and by["size.total_tokens", "repository"] is None and by["coupling.module_fan_out", "pkg/a.py"] == 1 and by["coupling.module_fan_in", "pkg/b.py"] == 1
    assert {(r["rule"], r["key"]) for r in result.findings.collect()} == {("complexity.nesting_depth", "pkg/b.py::deep"), ("complexity.cognitive", "pkg/b.py::deep"), ("dependency.cycle", "pkg/a.py|pkg/b.py")}
    assert [(r["code"], r["file"]) for r in result.diagnostics.collect()] == [("python.parse_failed", "pkg/broken.py")]
    assert result.gate.first()["status"] == "incomplete" and report.exit_code("incomplete") == 2
    assert report.summary(result.gate, result.findings, result.diagnostics).startswith("incomplete: 3 blocking")
    assert report.sarif_results(result.findings).count() == 3
    report.write_json(result.findings, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    layers = config.default_config() | {"layers": [{"name": "a", "include": ["**/a.py"], "mayDependOn": []}, {"name": "b", "include": ["**/b.py"], "mayDependOn": ["a"]}], "exclude": ["**/broken.py"]}
    again = plan.check_files(read_tree(spark, tree), layers)
    assert again.gate.first()["status"] == "failed"
    assert [r["key"] for r in again.findings.where("rule = 'architecture.boundary_violation'").collect()] == ["pkg/a.py->pkg/b.py"]


@pytest.mark.parametrize("change", [{"extra": 1}, {"schemaVersion": "2"}, {"clones": {"minTokens": 0, "minLines": 5}}, {"clones": {}}, {"layers": [{"name": "a", "include": [], "mayDependOn": ["z"]}]}, {"exclude": [1]}, {"include": ["a{b"]}, {"layers": [{"name": "a", "include": ["["], "mayDependOn": []}]}])
def test_config_is_strict(change):
    assert config.checked(config.default_config())
    with pytest.raises(ValueError):
        config.checked(config.default_config() | change)


def test_baselines(spark, tmp_path):
    df = spark.createDataFrame([("m", 1.0)], "metric string, value double")
    baseline.save({"measurements": df}, str(tmp_path), "main")
    assert baseline.load(spark, str(tmp_path), "main", "measurements").collect() == df.collect()
    with pytest.raises(Exception):
        baseline.save({"measurements": df}, str(tmp_path), "main")
    baseline.save({"measurements": df}, str(tmp_path), "main", replace=True)
    with pytest.raises(ValueError):
        baseline.save({}, str(tmp_path), "..") or baseline.load(spark, str(tmp_path), "../x", "m")


def test_streamed_attempts(spark, tmp_path):
    rows = [("s", i, p) for i, p in enumerate([False, False, False, True, False])]
    spark.createDataFrame(rows, "session string, at long, passed boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, at long, passed boolean").parquet(str(tmp_path / "in"))
    q = count_attempts(stream).writeStream.format("memory").queryName("attempts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("attempts").orderBy(F.col("at")).collect()
    assert [(r["attempt"], r["blocks"]) for r in got] == [(1, True), (2, True), (3, False), (1, True)]


def test_snapshots_follow_moves(spark, tmp_path):
    from plumbline.plans import snapshots

    deep = lambda n: "def deep(a):\n" + "".join("    " * (i + 1) + "if a:\n" for i in range(n)) + "    " * (n + 1) + "pass\n"
    frame = lambda files: spark.createDataFrame(list(files.items()), "path string, code string")
    snapshots.save(plan.check_files(frame({"a.py": deep(6), "gone.py": deep(7), "same.py": "x = 1\n"})), str(tmp_path), "main")
    now = plan.check_files(frame({"moved.py": deep(6), "new.py": deep(8), "same.py": "x = 1\n"}))
    measured, found = snapshots.against(spark, now, str(tmp_path), "main")
    kinds = {(r["rule"], r["key"]): r["classification"] for r in found.where("rule = 'complexity.nesting_depth'").collect()}
    assert kinds == {("complexity.nesting_depth", "moved.py::deep"): "existing", ("complexity.nesting_depth", "new.py::deep"): "new", ("complexity.nesting_depth", "gone.py::deep"): "resolved"}
    assert {r["classification"] for r in measured.where("key = 'moved.py::deep'").collect()} == {"existing"}
    new = now.findings.where("blocking and key like 'new.py%'").count()
    assert new and now.gate.first()["blocking"] > new
    assert tuple(snapshots.gate_against(now, found).first())[:2] == ("failed", new)
    same = plan.check_files(frame({"moved.py": deep(6), "same.py": "x = 1\n"}))
    assert same.gate.first()["status"] == "failed"
    assert snapshots.gate_against(same, snapshots.against(spark, same, str(tmp_path), "main")[1]).first()["status"] == "passed"
    assert [(r["section"], r["rank"], r["key"], r["omitted"]) for r in snapshots.to_fix(now, 1).collect()] == [("hotspots", 1, "new.py::deep", 1)]


def test_copied_functions_are_findings_and_imports_are_not(spark):
    body = "(items):\n    total = 0\n    for item in items:\n        total += item * 2\n        total -= 1\n    return total\n"
    imports = "import os\nfrom a.b import (\n    c,\n    d,\n)\nimport sys\n"
    rows = [("a.py", imports + "\n\ndef alpha" + body), ("b.py", imports + "\n\nclass Beta:\n    def run(self):\n        pass\n\n\ndef beta" + body), ("c.txt", "words")]
    sources = spark.createDataFrame(rows, "path string, code string")
    rules = config.default_config() | {"clones": {"minTokens": 8, "minLines": 2}}
    found = plan.check_files(sources, rules)
    clone = [r for r in found.findings.collect() if r["rule"] == "duplication.token_clone"]
    assert [(r["key"], r["current"], r["threshold"], r["blocking"]) for r in clone] == [("clone:a.py::alpha|b.py::beta", 10.0, None, True)]
    assert clone[0]["message"] == "The same 17-token block appears in 2 locations, 10 lines in all"
    rules["policies"]["duplication.token_clone_density"] = dict(rules["policies"]["duplication.token_clone_density"], threshold=100.0)
    assert not plan.check_files(sources, rules).findings.where("rule = 'duplication.token_clone'").count()
