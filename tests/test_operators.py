"""Small cases of the operators: nulls, empty tables, ties, and comparisons with brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import clones, compare, coverage, files, graph, policy, scopes, worklist


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rounding_and_percent(spark):
    df = spark.createDataFrame([(1.005, 0.0), (2.5, 3.0), (-1.005, None)], "v double, w double")
    assert [r[0] for r in df.select(S.rounded(F.col("v"))).collect()] == [1.0, 2.5, -1.0]
    assert [r[0] for r in df.select(S.percent(F.lit(1.0), F.col("w"))).collect()] == [None, 33.33, None]


def test_number_text(spark):
    df = spark.createDataFrame([(3.0,), (1e7,), (0.25,), (-2.5,), (100.0,), (None,)], "v double")
    assert [r[0] for r in df.select(S.number_text(F.col("v"))).collect()] == ["3", "10000000", "0.25", "-2.5", "100", None]


def test_short_id_and_clone_key(spark):
    import hashlib

    df = spark.createDataFrame([("a", "b")], "a string, b string")
    assert df.select(S.short_id(F.col("a"), F.col("b"))).first()[0] == hashlib.sha256(b"a\0b").hexdigest()[:20]
    assert df.select(S.clone_key(F.array(F.lit("z"), F.lit("a")))).first()[0] == "clone:a|z"


@pytest.mark.parametrize(
    "pattern, path, found",
    [("**/*.py", "a/b/c.py", True), ("**/*.py", "c.py", True), ("*.py", "a/c.py", False), ("src/**", "src/a/b", True), ("a/{b,c}/?", "a/c/x", True), ("a/{b,c}/?", "a/d/x", False), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("a.b", "axb", False), ("{a", "a", False)],
)
def test_globs(spark, pattern, path, found):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(S.glob_any(F.col("p"), [pattern])).first()[0] is found


def test_stable_json():
    assert S.stable_json({"b": 1, "a": ["<&>"]}) == '{"a":["\\u003c\\u0026\\u003e"],"b":1}'


def test_scalar_names(spark):
    df = spark.createDataFrame([("C", "", "f", 3), (None, "g", "f", 0)], "c string, e string, n string, line int")
    assert [r[0] for r in df.select(S.symbol_name(F.col("c"), F.col("e"), F.col("n"))).collect()] == ["C.f", "g.f"]
    assert [r[0] for r in df.select(S.location(F.col("n"), F.col("line"), F.lit("k"))).collect()] == ["f:3", "f"]


def test_languages(spark):
    df = spark.createDataFrame([("a/B.PY",), ("x.h",), ("Makefile",), ("q.tsx",)], "path string")
    assert [r["language"] for r in files.language_of(df).collect()] == ["Python", "C", "Unknown", "TypeScript"]


def test_threshold_is_strict_and_null_is_never_above(spark):
    m = spark.createDataFrame([("m", "a", 12.0), ("m", "b", 12.5), ("m", "c", None), ("off", "d", 99.0)], "metric string, key string, value double")
    p = spark.createDataFrame([("m", True, 12.0, "error", True), ("off", False, 1.0, "error", True)], "metric string, enabled boolean, threshold double, severity string, blocking boolean")
    found = policy.threshold_findings(m, p)
    assert [(r["key"], r["message"]) for r in found.collect()] == [("b", "m is 12.5; the limit is 12")]
    assert tuple(policy.gate(found).first()) == ("failed", 1, 0)
    assert tuple(policy.gate(found.limit(0)).first()) == ("passed", 0, 0)
    compared = spark.createDataFrame([(b, c) for b in (True, False) for c in ("new", "worsened", "existing", "resolved", None)] + [(None, "resolved")], "blocking boolean, classification string")
    assert tuple(policy.gate(compared).first()) == ("failed", 3, 4)
    assert tuple(policy.gate(compared.where("classification in ('existing', 'resolved')")).first()) == ("passed", 0, 1)
    assert policy.gate(found, spark.createDataFrame([(True, "error")], "required boolean, severity string")).first()["status"] == "incomplete"


def test_compare(spark):
    now = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 5.0)], "k string, value double")
    old = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("b", 1.0, 1)], "k string, value double, ord int")
    assert rows(compare.compare_measurements(now, old, ["k"]).select("k", "delta", "classification")) == [("a", -1.0, "improved"), ("b", 0.0, "existing"), ("c", None, None)]
    f = compare.compare_findings(now.withColumnRenamed("value", "current"), spark.createDataFrame([("a", 1.0), ("z", 4.0)], "k string, current double"), ["k"])
    assert rows(f.select("k", "delta", "classification")) == [("a", 1.0, "worsened"), ("b", None, "new"), ("c", None, "new"), ("z", -4.0, "resolved")]


def test_renames_need_one_candidate(spark):
    now = spark.createDataFrame([("new", "h1"), ("x", "h2"), ("y", "h2"), ("same", "h3")], "path string, hash string")
    old = spark.createDataFrame([("old", "h1"), ("gone", "h2"), ("same", "h3")], "path string, hash string")
    assert rows(compare.infer_renames(now, old)) == [("old", "new")]


def reach(edges, nodes):
    out = {n: {n} for n in nodes}
    while True:
        grown = {n: out[n] | {d for s, d in edges if s in out[n]} for n in nodes}
        if grown == out:
            return out
        out = grown


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_equal_brute_force(spark, seed):
    r = random.Random(seed)
    nodes = list(range(14))
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(20)]
    got = {frozenset(int(m) for m in x["cycle_key"].split("|")) for x in graph.cycles(spark.createDataFrame(edges, "src long, dst long")).collect()}
    to = reach(edges, nodes)
    expected = {frozenset(b for b in nodes if b in to[a] and a in to[b]) for a in nodes}
    assert got == {s for s in expected if len(s) > 1}


def test_long_chains_and_rings(spark, monkeypatch):
    """A chain and a ring of 10,000 nodes, a ring with chords, and a chain between two rings, in a few dozen rounds."""
    n, rounds = 10_000, []
    links = [(i, i + 1) for i in range(n)] + [(20_000 + i, 20_000 + (i + 1) % n) for i in range(n)]
    links += [(40_000 + i, 40_000 + (i + 1) % 3000) for i in range(3000)] + [(40_000 + i, 40_000 + i + 700) for i in range(0, 2000, 500)]
    links += [(50_000, 50_001), (50_001, 50_000), (60_000, 60_001), (60_001, 60_000), (50_000, 50_100)] + [(50_100 + i, 50_101 + i) for i in range(400)] + [(50_500, 60_000)]
    links += [(70_000, 70_001), (70_001, 70_002), (70_002, 70_000), (70_000, 70_003), (70_003, 70_004), (70_004, 70_000)]  # two lines at one node
    real = graph.written
    monkeypatch.setattr(graph, "written", lambda df, tag: rounds.append(tag) or real(df, tag))
    sizes = {r["component"]: r["n"] for r in graph.components(spark.createDataFrame(links, "src long, dst long")).groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert sizes == {20_000: n, 40_000: 3000, 50_000: 2, 60_000: 2, 70_000: 5} and len(rounds) < 80


def test_a_large_cycle_is_written_in_several_tasks_and_its_key_once_a_file(spark, tmp_path):
    """300 rows with a key of 1.2 MB: a page of 100 rows that each hold the key is 120 MB of a task's memory."""
    import pyarrow.parquet as pq

    names = [f"{i:04d}" + "x" * 4000 for i in range(300)]
    kept = {k: spark.conf.get(k, None) for k in ("parquet.dictionary.page.size", "parquet.page.size.row.check.min", "parquet.column.statistics.enabled#cycle_key")}
    try:
        graph.cycles(spark.createDataFrame(list(zip(names, names[1:] + names[:1])), "src string, dst string")).write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.parquet(str(tmp_path / "out")).selectExpr("md5(cycle_key) as k", "members", "member").collect()
    assert {r["member"] for r in rows} == set(names) and len(rows) == 300 and {(r["k"], r["members"]) for r in rows} == {(hashlib.md5("|".join(names).encode()).hexdigest(), 300)}
    files = [f for f in map(pq.ParquetFile, (tmp_path / "out").glob("part-*")) if f.metadata.num_rows]
    size = sum(f.metadata.row_group(i).total_byte_size for f in files for i in range(f.metadata.num_row_groups))
    assert len(files) > 1 and size < 20e6


def test_no_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3)], "src long, dst long")
    assert graph.cycles(edges).count() == 0
    assert graph.cycles(edges.limit(0)).count() == 0


def test_fan_and_layers(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("b", "c", 1)], "src string, dst string, line int")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    assert rows(graph.fan_metrics(edges, nodes)) == [("a", 1, 0), ("b", 1, 1), ("c", 0, 1), ("d", 0, 0)]
    owners = spark.createDataFrame([("a", "ui"), ("b", "db"), ("c", None)], "node string, layer string")
    assert graph.layer_violations(edges, owners, {"ui": ["ui"]}).count() == 2
    assert graph.layer_violations(edges, owners, {"ui": ["db"]}).count() == 0


def test_independent_windows(spark):
    df = spark.createDataFrame([([1, 2, 3, 6, 7, 11],), ([],)], "s array<long>")
    assert [r[0] for r in df.select(clones.independent(F.col("s"), 5)).collect()] == [3, 0]


def test_clones_with_nulls_and_short_texts(spark):
    text = " ".join(f"t{i}" for i in range(12))
    df = spark.createDataFrame([("a", text), ("b", "x " + text), ("c", None), ("d", ""), ("e", "t1 t2")], "path string, code string")
    assert clones.repeated_windows(df, 10).count() == 3
    assert rows(clones.clone_regions(df, 10)) == [("a", 1, 12, 2), ("b", 2, 12, 2)]
    assert clones.repeated_windows(df.limit(0), 10).count() == 0
    assert tuple(clones.clone_density(df.where("path = 'c'"), 10, 1).first()) == (0, 0, None)


def test_scopes(spark):
    df = spark.createDataFrame([(1, 1, "f"), (1, 2, "g"), (1, 3, "f"), (2, 1, "f")], "file int, at int, name string")
    assert [r["symbol"] for r in scopes.symbol_ordinals(df, ["file"], "name", ["at"]).orderBy("file", "at").collect()] == ["f", "g", "f#2", "f"]
    names = spark.createDataFrame([("a",), ("a.b.c",), ("a.b.c.d",), ("ab",)], "symbol string")
    assert rows(scopes.prefix_parent(names).na.fill("-")) == [("a", "-"), ("a.b.c", "a"), ("a.b.c.d", "a.b.c"), ("ab", "-")]
    deep = spark.createDataFrame([([True, True, False, True, True, False],), ([],)], "o array<boolean>")
    assert [r[0] for r in deep.select(scopes.nesting_depth(F.col("o"))).collect()] == [3, 0]


def test_lcov(spark):
    text = ["DA:9,9", "SF:a", "DA:1,0", "DA:1,2", "DA:x,1", "BRDA:1,0,0,-", "BRDA:1,0,1,3", "end_of_record", "DA:7,7", "SF:b", "DA:2,0"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "report int, no int, text string")
    entries = coverage.lcov_entries(lines)
    assert rows(coverage.covered(entries, ["source"])) == [("a", "branch", 1, 1, 100.0), ("a", "line", 1, 1, 100.0), ("b", "line", 0, 1, 0.0)]
    changed = spark.createDataFrame([("b", 2)], "source string, line int")
    assert coverage.on_changed_lines(entries, changed).count() == 1


def test_lcov_records_that_are_cut_off(spark):
    text = ["SF:a.py\r", "DA:1,1\r", "end_of_record\r", "SF:cut.py", "DA:1,1", "SF:b.py", "DA:2,-1", "DA:3", "BRDA:4", "BRDA:5,0,0,x", "BRDA:6,0,0,2", "end_of_record", "SF:last.py", "DA:9,1,abc"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "report int, no int, text string")
    got = sorted((r["source"], r["kind"], r["line"], r["hits"]) for r in coverage.lcov_entries(lines).where("hits is not null").collect())
    assert got == [("a.py", "line", 1, 1), ("b.py", "branch", 6, 2), ("b.py", "line", 2, -1), ("last.py", "line", 9, 1)]
    assert coverage.lcov_entries(lines).where("hits is null").count() == 2


def test_coverage_measurements(spark):
    entries = spark.createDataFrame([("a", "line", 1, 1), ("a", "line", 2, 0), ("a", "branch", 1, None)], "source string, kind string, line int, hits long")
    changed = spark.createDataFrame([("a", 2)], "source string, line int")
    assert sorted((r["metric"], r["value"]) for r in coverage.measurements(entries, changed).collect()) == [("coverage.branch", None), ("coverage.changed_line", 0.0), ("coverage.line", 50.0)]


def test_worklist_filter_and_clone_findings(spark):
    f = spark.createDataFrame([("r", ["a/x.py", "b/y.py"]), ("r", []), ("s", ["a/x.py"])], "rule string, files array<string>")
    assert worklist.kept(f).count() == 3 and worklist.kept(f, ["r"]).count() == 2 and rows(worklist.kept(f, ["r"], ["b/*"]).select("rule")) == [("r",)]
    groups = spark.createDataFrame([(1, 50, "a", "f", 1, 5), (1, 50, "b", None, 3, 7), (2, 60, "b", "", 10, 12), (2, 60, "a", "f", 20, 22)], "clone int, tokens int, file string, symbol string, start int, stop int")
    assert rows(clones.clone_findings(groups).select("key", "lines")) == [("clone:a::f|b", 10), ("clone:a::f|b#2", 6)]


def test_findings_take_the_measurements_baseline_first(spark):
    now = spark.createDataFrame([("a", 5.0), ("b", 5.0)], "k string, current double")
    old = spark.createDataFrame([("a", 1.0), ("z", 2.0)], "k string, current double")
    measured = spark.createDataFrame([("a", 7.0), ("b", 3.0)], "k string, baseline double")
    found = compare.compare_findings(now, old, ["k"], measured)
    assert rows(found.select("k", "baseline", "delta", "classification")) == [("a", 7.0, -2.0, "existing"), ("b", 3.0, 2.0, "new"), ("z", 2.0, -2.0, "resolved")]
    assert compare.active(found).count() == 2 and compare.resolved(found).count() == 1 and compare.stripped(found).columns == ["k", "current"]


def test_total_tokens(spark):
    df = spark.createDataFrame([("a b", True), (None, True), ("c", False)], "code string, ok boolean")
    assert [tuple(files.total_tokens(x).first()) for x in (df.limit(0), df, df.where("ok"))] == [("not_applicable", None), ("unavailable", None), ("measured", 2)]


def test_diff(spark):
    text = ["+++ b/x", "@@ -1,2 +5,2 @@", "+y", "@@ -1 +9 @@", "@@ -4,2 +7,0 @@", "+++ /dev/null", "@@ -1 +1 @@"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "diff int, no int, text string")
    assert rows(coverage.added_lines(lines)) == [(1, "x", 5), (1, "x", 6), (1, "x", 9)]
    assert rows(coverage.all_lines(spark.createDataFrame([("n", "a\nb\n")], "file string, text string"))) == [("n", 1), ("n", 2), ("n", 3)]


def test_worklist(spark):
    f = spark.createDataFrame([("s", "a", "r1", 4.0, 2.0), ("s", "a", "r2", 1.0, None), ("s", "b", "r1", 9.0, 1.0), ("t", "c", "r", 1.0, 0.0)], "section string, key string, rule string, current double, threshold double")
    top = worklist.top_places(worklist.places(f), 1)
    assert rows(top) == [("s", 1, "a", 2, 2.0, 1), ("t", 1, "c", 1, 0.0, 0)]
    assert worklist.top_places(worklist.places(f), 0).count() == 3


def test_attempts_restart_after_a_pass(spark):
    runs = spark.createDataFrame([("s", i, x) for i, x in enumerate("fffpf")], "s string, at int, r string")
    got = worklist.attempts(runs, "s", ["at"], "r = 'f'", "r = 'p'").orderBy("at").collect()
    assert [(x["attempt"], x["blocks"]) for x in got] == [(1, True), (2, True), (3, False), (1, True)]


def test_adapters_and_evidence(spark):
    df = spark.createDataFrame([("py", True), ("py", False), ("go", True)], "adapter string, ok boolean")
    assert rows(files.adapter_summary(df, ["go", "java", "py"])) == [("go", 1, True), ("java", 0, True), ("py", 2, False)]
    e = spark.createDataFrame([('{"k": 3}',), ("{}",), (None,), ("nonsense",)], "j string")
    assert [r["k"] for r in files.evidence(e, "j", {"k": "int"}).collect()] == [3, None, None, None]


def test_outside_spans(spark):
    points = spark.createDataFrame([("u", 1), ("u", 5), ("v", 5), (None, 5), ("u", None)], "k string, at int")
    spans = spark.createDataFrame([("u", 4, 6)], "k string, start int, stop int")
    assert sorted((r["k"] or "", r["at"] or 0) for r in scopes.outside_spans(points, spans, "k").collect()) == [("", 5), ("u", 0), ("u", 1), ("v", 5)]


def test_spans_equal_all_pairs(spark):
    r = random.Random(5)
    points = [(r.choice("kkkkm"), i, r.randint(-40, 120)) for i in range(150)] + [(None, 900, 3), ("k", 901, None), ("z", 902, 3)]
    spans = [(r.choice("kkkkm"), i, a, a + r.randint(-1, 60)) for i, a in enumerate(r.randint(-40, 100) for _ in range(80))] + [(None, 99, -90, 200), ("k", 98, None, 9), ("k", 97, 9, None)]
    p = spark.createDataFrame(points, "k string, point_id int, at int")
    s = spark.createDataFrame(spans, "k string, span_id int, start int, stop int")
    around = lambda k, at: [(stop - start, i) for key, i, start, stop in spans if None not in (k, at, key, start, stop) and k == key and start <= at <= stop]
    assert {x["point_id"]: x["span_id"] for x in scopes.enclosing_span(p, s, "k").collect()} == {i: min(around(k, at))[1] for k, i, at in points if around(k, at)}
    assert sorted(x["point_id"] for x in scopes.outside_spans(p, s, "k").collect()) == sorted(i for k, i, at in points if not around(k, at))
    assert scopes.enclosing_span(p, s.limit(0), "k").count() == 0 and scopes.outside_spans(p, s.limit(0), "k").count() == len(points)
    days = lambda df, *names: df.select(*[F.expr(f"timestamp '2024-01-01' + make_dt_interval({c})").alias(c) if c in names else c for c in df.columns])
    timed = scopes.enclosing_span(days(p, "at"), days(s, "start", "stop"), "k")
    assert rows(timed) == rows(scopes.enclosing_span(p, s, "k"))


def test_first_seen(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 2)], "r string, at int")
    assert rows(scopes.first_seen(df, "r", "at")) == [("a", 1), ("b", 0), ("c", 2)]


def test_mapped_sources_and_stale_files(spark):
    entries = spark.createDataFrame([("a.py",), ("b.py",), ("c.py",)], "source string")
    paths = spark.createDataFrame([("lib/a.py",), ("a.py",), ("b.py",)], "path string")
    mapped = coverage.map_sources(entries, paths, "lib/")
    assert rows(mapped) == [("a.py", "lib/a.py"), ("b.py", "b.py")]
    times = spark.sql("select * from values ('lib/a.py', timestamp '2024-01-01 00:00:00'), ('b.py', timestamp '2024-01-02 00:00:00') t(path, modified)")
    assert rows(coverage.fresh_only(mapped, times, F.lit("2024-01-01").cast("timestamp"))) == [("lib/a.py", "a.py")]


def test_snapshot_digest(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, code string")
    one = files.snapshot_digest(df).first()
    assert one == files.snapshot_digest(df.orderBy(F.desc("path"))).first()
    assert one != files.snapshot_digest(spark.createDataFrame([("a", "y"), ("b", "x")], "path string, code string")).first()
