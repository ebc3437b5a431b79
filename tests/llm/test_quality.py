"""The quality classifier: contexts and pooling against plain loops, held-out accuracy, odd input."""

import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import quality as Q
from plumbline.llm.collocations import Powers
from plumbline.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
INDEX = Q.index_vectors()


def words(text: bytes):
    return [m[0] for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9\x09-\x0d\x20]+", text)]


def bucket(word: bytes):
    return int(Q.buckets_of(word, Powers())[0][0])


@pytest.mark.parametrize("piece", [1 << 20, 40, 9])
def test_contexts_and_pooling_equal_plain_loops(monkeypatch, piece):
    monkeypatch.setattr(Q, "PIECE", piece)
    r = random.Random(4)
    texts = ["".join(r.choice(["the", "Of", "é", "###", "12", " ", " ", "\n", "x"]) for _ in range(r.randrange(60))).encode() for _ in range(40)] + [b"", b"  ", b"one"]
    got = np.zeros((Q.BUCKETS, Q.DIM))
    for found, owners, carried in Q.word_blocks(texts, Powers()):
        if len(found) > Q.WINDOW:
            which, more = Q.contexts(found, owners, carried, INDEX)
            got[which] += more
    expected = np.zeros_like(got)
    ids = [[bucket(w) for w in words(t)] for t in texts]
    for own in ids:
        for i, a in enumerate(own):
            for j in range(max(0, i - Q.WINDOW), min(len(own), i + Q.WINDOW + 1)):
                expected[a] += INDEX[own[j]] * (i != j)
    if piece > 1000:  # blocks of at most two words are passed over
        assert np.array_equal(got, expected)
    else:
        assert np.abs(got - expected).sum() <= 4 * 2 * Q.PLACES * len(texts)
    vectors = Q.word_vectors(expected)
    features = Q.pooled(texts, vectors, Powers())
    for own, row in zip(ids, features):
        if not own:
            assert not row.any()
            continue
        mean, each = vectors[own].mean(0, dtype=float), vectors[sorted(set(own))].mean(0, dtype=float)
        assert np.allclose(row, [*mean, *each, np.linalg.norm(mean), np.linalg.norm(each), np.log(len(own)), np.log(len(own) / len(set(own)))], atol=1e-5)


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_quality"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(got) == docs and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [(got[d]["predicted"], y) for d, y in labels.items() if got[d]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.95


def test_sample_is_bounded_and_odd_labels_are_left_out(spark):
    rows = [(i, int(i % 10 > 0)) for i in range(1000)] + [(None, 1), (5, 1), (5, 1), (10, 1), (7, None), (2000, 5)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    got = Q.sampled(labels, "quality", "doc_id", 60, 30).collect()
    assert len(got) == 90 == len({r["id"] for r in got}) and sum(r["label"] for r in got) == 45 and sum(r["trains"] for r in got) == 60
    assert 10 not in {r["id"] for r in got} and 2000 not in {r["id"] for r in got}
    assert sum(r["weight"] for r in got) == pytest.approx(999)  # 10 has both labels
    assert Q.sampled(labels, "quality", "doc_id", 10_000, 5_000).count() == 999


def test_odd_input(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "good words here. " * 9), (4, "good words here. " * 9), (None, "bad###" * 4000), (5, "x" * 3_000_000)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    blank = Q.score(docs, Q.train(docs, none)).collect()
    assert [r["score"] for r in blank] == [0.5] * len(rows) and docs.columns == ["doc_id", "text", "score"] and set(blank[0].asDict()) == {"doc_id", "text", "score", "predicted"}
    both = spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in Q.score(docs, Q.train(docs, both), keep=["doc_id"]).collect())
    assert {r["score"] for r in Q.score(docs, Q.train(docs, both.where("quality = 1"))).collect()} == {1.0}
    assert Q.score(docs.limit(0), Q.train(docs.limit(0), both)).count() == 0
