"""Values carried along huge keys, coverage with odd numbers, baselines, nested places, attempts over pauses."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.scalars import stable_json
from plumbline.operators import compare, coverage, files, worklist
from plumbline.operators.scopes import carried
from plumbline.plans import check as plan
from plumbline.plans import snapshots
from plumbline.sources import baseline, config
from plumbline.streaming.attempts import count_attempts


def test_carried_equals_one_scan(spark):
    r = random.Random(3)
    rows = [(k, i, r.choice([None, None, "a", "b"]), r.random() < 0.2) for k in ("x", "y", None) for i in sorted(r.sample(range(400), 90))]
    df = spark.createDataFrame(rows, "k string, no long, v string, c boolean").repartition(3)
    expected = []
    for key in ("x", "y", None):
        own = [x for x in rows if x[0] == key]
        last = count = None
        for i, (_, no, v, c) in enumerate(own):
            last, count = (v or last), (count or 0) + c
            expected.append((str(key), no, last, count, next((w for _, _, w, _ in own[i + 1 :] if w), None)))
    for size in (1, 7, 50, 1 << 16):
        got = carried(df, "k", "no", {"last": F.col("v")}, {"n": F.col("c")}, {"next": F.col("v")}, size)
        assert got.columns == ["k", "no", "v", "c", "last", "n", "next"]
        assert sorted((str(x["k"]), x["no"], x["last"] or "", x["n"], x["next"] or "") for x in got.collect()) == sorted((a, b, c or "", d, e or "") for a, b, c, d, e in expected)


def test_numbers_that_are_too_large_skip_their_entry(spark):
    text = ["SF:a", "DA:99999999999,1", "DA:5,99999999999999999999", "DA:x,1", "DA:1,2,sum", "DA:1,3", "BRDA:2,0,1,-", "BRDA:3,0,1,99999999999999999999", "BRDA:4", "BRDA:2,0,1,4", "BRDA:99999999999999999999,0,0,1", "end_of_record", "DA:7,1", "SF:cut", "DA:1,1", "SF:b", "DA:2,0\r"]
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(text)], "report string, no int, text string")
    got = sorted((x["source"], x["kind"], x["line"], x["branch"] or "", -1 if x["hits"] is None else x["hits"]) for x in coverage.lcov_entries(df).collect())
    assert got == [("a", "branch", 2, "0,1", -1), ("a", "branch", 2, "0,1", 4), ("a", "branch", 3, "0,1", -1), ("a", "branch", 4, "", -1), ("a", "line", 1, "", 3), ("a", "line", 99999999999, "", 1), ("b", "line", 2, "", 0)]
    diff = ["+++ b/f", "@@ -1 +3,2 @@", "@@ -1 +99999999999999999999 @@", "@@ -1 +1,99999999999999999999 @@", "@@ -1 +9 @@ x", "@@ -1 +9,0 @@", "+++ /dev/null", "@@ -1 +1 @@"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(diff)], "diff int, no int, text string")
    assert sorted(x["line"] for x in coverage.added_lines(lines).collect()) == [3, 4, 9]


def test_unmeasured_values_have_no_baseline(spark):
    now = spark.createDataFrame([("a", None), ("b", 2.0)], "key string, value double")
    old = spark.createDataFrame([("a", 3.0, 1), ("b", 1.0, 1), ("b", 5.0, 2)], "key string, value double, ord int")
    assert sorted(tuple(r) for r in compare.compare_measurements(now, old, ["key"]).collect()) == [("a", None, None, None, None), ("b", 2.0, 5.0, -3.0, "improved")]


def test_digest_of_repeated_rows(spark):
    digest = lambda rows: files.snapshot_digest(spark.createDataFrame(rows, "path string, code string")).first()["digest"]
    x, y = ("x", "1"), ("y", "2")
    assert len({digest([x, x]), digest([y, y]), digest([x, y]), digest([x]), digest([x, x, x])}) == 5 and digest([x, y]) == digest([y, x])
    assert len(files.snapshot_digest(spark.createDataFrame([], "path string, code string")).first()["digest"]) == 64


def test_a_failed_save_leaves_the_old_baseline(spark, tmp_path):
    old = spark.createDataFrame([(1,)], "n int")
    root = str(tmp_path)
    baseline.save({"t": old, "u": old}, root, "main", properties={"a": 1})
    broken = old.select(F.raise_error(F.lit("no")).alias("n"))
    with pytest.raises(Exception):
        baseline.save({"t": old.selectExpr("n + 1 as n"), "u": broken}, root, "main", replace=True)
    assert baseline.load(spark, root, "main", "t").first()["n"] == 1 and baseline.properties(spark, root, "main") == {"a": 1}
    baseline.save({"t": old.selectExpr("n + 1 as n")}, root, "main", replace=True)
    assert baseline.load(spark, root, "main", "t").first()["n"] == 2
    with pytest.raises(Exception):
        baseline.Store(spark, root).commit("main", {}, replace=False)
    (tmp_path / "odd.json").write_text('{"schemaVersion": "0.9"}')
    with pytest.raises(ValueError):
        baseline.load(spark, root, "odd", "t")


def test_incompatible_baselines_and_resolved_findings(spark, tmp_path):
    code = "def f(a, b, c, d, e, g):\n    return a\n"
    frame = lambda x: spark.createDataFrame([("a.py", x)], "path string, code string")
    snapshots.save(plan.check_files(frame(code)), str(tmp_path), "main")
    now = plan.check_files(frame("x = 1\n"))
    _, found = snapshots.against(spark, now, str(tmp_path), "main")
    row = found.where("rule = 'size.parameter_count'").first()
    assert (row["classification"], row["blocking"], row["severity"], row["baseline"], row["delta"]) == ("resolved", False, "error", 6.0, -6.0)
    assert row["message"] == "Resolved: size.parameter_count is 6; the limit is 5"
    assert snapshots.incompatible(spark, str(tmp_path), "main").count() == 0
    density = lambda rules: snapshots.against(spark, plan.check_files(frame(code), rules), str(tmp_path), "main")[0].where("metric = 'duplication.token_clone_density'").first()["baseline"]
    assert density(None) == 0 and density(config.default_config() | {"clones": {"minTokens": 9, "minLines": 5}}) is None  # another variant
    other = config.default_config() | {"exclude": ["x"]}
    assert [r["code"] for r in snapshots.incompatible(spark, str(tmp_path), "main", other).collect()] == ["baseline.config_incompatible"] and stable_json(other)


def test_nested_places(spark):
    rows = [("f", "a", 9, "r1", 2.0), ("f", "a.b", 3, "r2", 4.0), ("f", "a.b.c", 5, "r3", 9.0), ("f", "a.x.y", 4, "r1", 1.0), ("f", None, 1, "r1", 30.0), ("g", "a.b", 2, "r1", 3.0), ("g", "a.b", 1, "r2", 1.0), ("f", "ab.c", 1, "r1", 1.0), (None, "a.b", 1, "r1", None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "file string, symbol string, line int, rule string, current double, threshold double")
    got = {(r["file"], r["symbol"]): (r["line"], r["parent"], r["root"], r["depth"], r["rules"], r["excess"]) for r in worklist.nested(df).collect()}
    assert got == {("f", "a"): (9, None, "a", 0, 2, 9.0), ("f", "a.b"): (3, "a", "a", 1, 2, 9.0), ("f", "a.b.c"): (5, "a.b", "a", 2, 1, 9.0), ("f", "a.x.y"): (4, "a", "a", 1, 1, 1.0), ("f", ""): (1, None, "", 0, 1, 30.0), ("g", "a.b"): (1, None, "a.b", 0, 2, 3.0), ("f", "ab.c"): (1, None, "ab.c", 0, 1, 1.0), ("", "a.b"): (1, None, "a.b", 0, 1, 0.0)}
    order = [(r["file"], r["symbol"]) for r in worklist.nested_order(worklist.nested(df)).collect()]
    assert order == [("f", "a"), ("f", "a.b"), ("f", "a.b.c"), ("f", "a.x.y"), ("g", "a.b"), ("f", ""), ("f", "ab.c"), ("", "a.b")]
    assert worklist.nested(df.limit(0)).count() == 0


def test_attempts_survive_a_pause(spark, tmp_path):
    schema, outcomes = "session string, at long, passed boolean", [[False, False], [False, True, False], [False]]
    got, at = [], 0
    for i, batch in enumerate(outcomes):
        rows = [("s", at + j, p) for j, p in enumerate(batch)]
        at += len(batch)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = count_attempts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        out.awaitTermination(120)
    got = [(r["at"], r["attempt"], r["blocks"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()]
    assert got == [(0, 1, True), (1, 2, True), (2, 3, False), (4, 1, True), (5, 2, True)]
