"""The registered queries themselves, over the smallest tables, against brute force and the library."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm.queries import QUERIES, URL_RULES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return library, {d: library.encode(t or "", add_special_tokens=False).ids for d, t in texts.items()}


def rows(spark, name):
    return QUERIES[name](spark, DATA).collect()


def test_op2(spark, texts):
    def shingles(text):
        w = re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower())
        w = [x for x in w if x]
        return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, "op2_jaccard")} == {d: (len(s), find(d)) for d, s in sets.items()}


def test_op4(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    verdicts = dict(URL_RULES)
    got = rows(spark, "op4_urlfilter")
    assert {r["page_id"] for r in got} == set(pages)
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", pages[r["page_id"]] or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [x for x in verdicts if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdicts[rule] if rule else r["verdict"] in ("allow", "block")


def test_op5(spark):
    v = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    v = {i: np.array(x, float) for i, x in v.items() if x is not None and None not in x and np.isfinite(x).all() and np.any(x)}
    names = np.array(sorted(v))
    x = np.stack([v[i] for i in names])
    got = rows(spark, "op5_hnsw")
    hits = total = 0
    for q in names[names % 20 == 0].tolist():
        score = x @ v[q]
        best = [i for i in names[np.lexsort((names, -score))].tolist() if i != q][:20]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(best) + 1))
        assert all(abs(r["score"] - float(v[q] @ v[r["vec_id"]])) < 1e-12 for r in own)
        hits, total = hits + len({r["vec_id"] for r in own} & set(best)), total + len(best)
    assert hits >= 0.95 * total


def test_op7(spark, ids):
    library, encoded = ids
    for r in rows(spark, "op7_bpe"):
        own = encoded[r["doc_id"]]
        text = library.decode(own, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op8(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = rows(spark, "op8_langid")
    assert {r["doc_id"]: r["held_out"] for r in got} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in lang}
    assert all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.95


def test_op9(spark, ids):
    start = 0
    got = {r["doc_id"]: r for r in rows(spark, "op9_grammar_ids")}
    for d in sorted(ids[1]):
        own = np.array([*ids[1][d], 2], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)


def test_op10(spark, texts):
    tokens = {d: [w for w in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if w] + [b" "] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    counts = Counter(w for d in tokens if not held[d] for w in tokens[d])
    n, v = sum(counts.values()), len(counts)
    got = rows(spark, "op10_maxent")
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        own = tokens[r["doc_id"]]
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(counts[w] > 0 for w in own), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
