"""WARC, URL filter, nearest neighbours, sharding, pipeline."""

import gzip
import hashlib
import importlib.util
import os
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from plumbline.llm import hnsw, sharding, urlfilter, warc
from plumbline.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got = QUERIES[name](spark, DATA)
    expected = con.sql(ORACLE_SQL[name]).to_arrow_table().to_pylist()
    shown = lambda r: tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in sorted(got.columns))
    assert sorted(map(repr, (shown(r.asDict()) for r in got.collect()))) == sorted(map(repr, map(shown, expected)))


def test_warc(spark):
    big, other = "a" * 1200, "é\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://b.com/x", big), (2, "http://a.com/", big), (3, "HTTP://a.com/y", other), (4, None, other), (5, "http://a.com/", None), (6, "http://a.com/", ""), (7, "u", "small"), (8, "u", "small"), (9, "nl\r\nX: y", big), (None, "http://z.com", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.read_histories(spark, warc.write_archives(pages)).orderBy("part", "place").collect()
    keys = [(r["urlkey"], r["captured"], r["page_id"] or -1) for r in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (by[i]["payload_bytes"], by[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: r["refers_to"] for i, r in by.items() if r["record_type"] == "revisit"} == {1: 9, 2: 9, 3: 4}
    for r in got:  # each capture's record begins where its index row says
        raw = gzip.decompress(open(r["archive"].removeprefix("file:"), "rb").read())
        assert raw[r["offset"] :].startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
    assert warc.read_histories(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_warc_order_of_any_ids(spark):
    """Ids that are times beyond the years 1 to 9999 keep their order; a record without a number has a record id too."""
    ids = [10**12, -(10**12), 9 * 10**18, -9 * 10**18, 2**63 - 1, -(2**63), 0, 5, 251_824_463_999, 251_824_464_000, -63_713_433_600, None, None]
    page = "x" * 2000
    pages = spark.createDataFrame([(i, "http://a.com/", page if i is None or i % 2 else "short") for i in ids], "page_id long, url string, html string").repartition(3)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        folder = warc.write_archives(pages)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = warc.read_histories(spark, folder).orderBy("part", "place").collect()
    order = [r["page_id"] for r in got if r["page_id"] is not None]
    assert order == sorted(i for i in ids if i is not None) and len(got) == len(ids)
    assert {r["captured"] for r in got if abs(r["page_id"] or 0) < 10} == {"2020-01-01T00:00:00Z", "2020-01-01T00:00:05Z"}
    assert all(len(r["captured"]) == 20 for r in got) and max(r["captured"] for r in got) == "9999-12-31T23:59:59Z"
    assert {(r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"} == {(i, 2**63 - 1) for i in ids if i is not None and i % 2 and i < 2**63 - 1}
    records = [f for name in os.listdir(folder.removeprefix("file:")) if name.endswith(".gz") for _, f, _ in warc.parse(open(os.path.join(folder.removeprefix("file:"), name), "rb").read())]
    assert len({f[b"WARC-Record-ID"] for f in records}) == len(ids)


@pytest.mark.parametrize("members", [False, True])
def test_warc_windows(members, monkeypatch):
    """An archive of one gzip member, or of one for each record, is read alike in windows of any size."""
    payloads = [b"", b"\r\n\r\n", b"x" * 5000, bytes(range(256)) * 9]
    records = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(p), p) for p in payloads]
    archive = b"".join(map(gzip.compress, records)) if members else gzip.compress(b"".join(records))
    places = [sum(map(len, records[:i])) for i in range(len(records))]
    for window in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(warc, "WINDOW", window)
        got = list(warc.parse(archive))
        assert [(at, payload) for at, _, payload in got] == list(zip(places, payloads))
        with pytest.raises(ValueError):
            list(warc.parse(archive[:-5]))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted(r.randrange(30) for _ in range(r.randrange(9))) for _ in range(k)]
    assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


URLS = [None, "", "no scheme/x", "http://", "http://Example.COM/en/a?b#c", "https://WWW.example.com/en/", "http://example.com/fr", "http://notexample.com/en/x", "x://a.net/es/1", "x://net/es/", "x://net?q/es/", "http://a.org/p://q", "http://com", "http://é.com/ü#f", "//a.com/", "http://a.net/e"]


def expected_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [r for r, _ in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_and_model(spark):
    labelled = [f"http://s{i}.example.com/fr/shop{i}" for i in range(60)] + [f"http://s{i}.junk.net/es/pills{i}" for i in range(60)]
    more = ["http://s9.example.org/fr/shop77", "http://s9.junk.org/es/pills77"]
    rows = list(enumerate(URLS + labelled + more))
    got = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame([(i, u, 1) for i, u in rows], "page_id long, url string, host int"), URL_RULES).collect()}
    assert len(got) == len(rows)
    verdicts = dict(URL_RULES)
    for i, url in rows:
        host, path, rule = expected_rule(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] == verdicts[rule] if rule else got[i]["verdict"] in ("allow", "block")
    assert got[rows[-2][0]]["verdict"] == "allow" and got[rows[-1][0]]["verdict"] == "block"
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(empty, URL_RULES).count() == 0


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 300)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 12)).astype(np.float32) * rng.random((900, 1)).astype(np.float32)
    x[100:160] = x[100]  # a group of equal vectors
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(len(x))]
    odd = [(5000, None, 1), (5020, [0.0] * 12, 1), (5040, [1.0] * 11 + [float("nan")], 1), (5060, [1.0] * 11 + [float("inf")], 1), (5080, [None] * 12, 1), (5100, [1.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int")
    found = defaultdict(list)
    for r in hnsw.nearest(df, df["vec_id"] % 20 == 0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 900, 20))
    hits = 0
    for q, got in found.items():
        score = x.astype(float) @ x[q].astype(float)
        best = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:20]
        hits += len({i for _, i, _ in got} & set(best))
        assert [r for r, _, _ in got] == list(range(1, 21)) and q not in {i for _, i, _ in got}
        assert all(abs(s - score[i]) < 1e-12 for _, i, s in got)
        assert got == sorted(got, key=lambda t: (-t[2], t[1])) or [t[1:] for t in got] == [t[1:] for t in sorted(got, key=lambda t: (-t[2], t[1]))]
    assert hits >= 0.95 * 20 * len(found)
    few = df.where("vec_id < 5")
    assert hnsw.nearest(few, few["vec_id"] == 0).count() == 4
    assert hnsw.nearest(df.where("vec_id >= 5000 and vec_id < 5100"), df["vec_id"] > 0).count() == 0


def test_nearest_with_unequal_norms_and_lengths(spark, monkeypatch):
    """One vector 10,000 times longer than the others does not hide them, and every length is answered."""
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 1500)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    x[17] *= 10_000
    x[1000:1500] *= rng.random((500, 1)).astype(np.float32) * 30
    y = rng.standard_normal((200, 7)).astype(np.float32)
    rows = [(i, [float(v) for v in u]) for i, u in enumerate([*x, *y])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in hnsw.nearest(df, df["vec_id"] % 20 == 0).collect():
        got[r["query_id"]].append(r["vec_id"])
    for part, first in ((x, 0), (y, 3000)):
        hits, asked = 0, [q for q in range(first, first + len(part)) if q % 20 == 0]
        for q in asked:
            score = part.astype(float) @ part[q - first].astype(float)
            best = [i + first for i in np.argsort(-score, kind="stable") if i + first != q][:20]
            assert len(got[q]) == 20
            hits += len(set(got[q]) & set(best))
        assert hits >= 0.9 * 20 * len(asked)


def test_nearest_in_double_precision(spark, monkeypatch):
    """Scores are those of the given vectors; huge components do not disturb the search; many blocks share a graph."""
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 100)
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 4)
    monkeypatch.setattr(hnsw, "TASK_BLOCKS", 3)
    x = np.random.default_rng(5).standard_normal((300, 6))
    for big in (1.0, 1e150):
        y = x * big
        df = spark.createDataFrame([(i, [float(v) for v in y[i]]) for i in range(300)], "vec_id long, embedding array<double>")
        got = hnsw.nearest(df, df["vec_id"] % 10 == 0).collect()
        assert len(got) == 30 * 20
        hits = 0
        for r in got:
            exact = float(y[r["query_id"]] @ y[r["vec_id"]])
            assert abs(r["score"] - exact) <= 1e-12 * big * big
        for q in range(0, 300, 10):
            best = [i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:20]
            hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(best))
        assert hits >= 0.95 * 600


def test_url_sample_is_of_different_urls(spark):
    """A hot URL does not fill the sample."""
    rows = [(i, "http://a.com/same") for i in range(300)] + [(1000 + i, f"http://b{i}.com/news") for i in range(80)] + [(2000 + i, f"http://c{i}.net/es/x") for i in range(80)] + [(9999, "http://b7.org/news")]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES, sample_rows=100).collect()}
    assert len(got) == len(rows) and got[9999] == "allow"


def test_sharding_against_recursion(spark):
    r = random.Random(4)
    rows = [(i, "x" * r.choice([0, 10, 500])) for i in range(400)] + [(7, "y" * 3000), (7, "y" * 3000), (None, "z"), (999, None)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, shard int")
    bits = lambda i: int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16)

    def split(part, depth):
        if sum(len(t or "") for _, t in part) <= 2000 or depth == 60:
            return [(depth, part)]
        side = lambda b: [x for x in part if bits(x[0]) >> (59 - depth) & 1 == b]
        return [s for b in (0, 1) if side(b) for s in split(side(b), depth + 1)]

    expected = sorted((d, format(bits(i), "060b")[:d], len(part), sum(len(t or "") for _, t in part)) for d, part in split(rows, 0) for i, _ in part)
    got = sharding.assign(df, 2000).collect()
    assert sorted((x["shard_depth"], x["shard"], x["shard_rows"], x["shard_bytes"]) for x in got) == expected
    assert max(d for d, *_ in expected) == 60 and len(got) == len(rows)
    assert sharding.assign(df.limit(0), 2000).count() == 0
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted((d, s, n, b) for _, s, d, n, b in con.sql(sharding.assign_sql(2000)).fetchall()) == expected


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    now, kept = docs, {}
    for name, stage in P.STAGES:
        now = P.written(stage(spark, now, DATA), name)
        kept[name] = now
        if name != "tokens":
            assert now.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = lambda name: {r["doc_id"] for r in kept[name].collect()}
    assert len(ids("language")) >= 0.99 * len(texts)
    dirty = {i for i in ids("near_duplicates") if any(b in texts[i] for b in bench)}
    assert dirty and not dirty & ids("decontamination") and ids("tokens") == ids("decontamination")
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    left = [shingles(texts[i]) for i in ids("near_duplicates")]
    assert all(len(a & b) < 0.8 * len(a | b) for k, a in enumerate(left) for b in left[:k])
    gone = ids("language") - ids("near_duplicates")
    assert gone and P.run(spark, DATA).count() == len(ids("tokens"))
