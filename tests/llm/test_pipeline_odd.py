"""The pipeline's stages on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

DATA = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected string, component_id int, _key string"


@pytest.fixture(scope="module")
def item(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]


@pytest.fixture(scope="module")
def docs(spark, item):
    known = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    first = known[0][1]
    odd = [(None, None, None, None, None), (9001, None, "en", "s", 1), (9002, "", None, None, None), (9003, " \n\t", "fr", "s", 3), (9004, "1234 %%", "en", None, 6), (9005, (first + " ") * 400, None, "long", None), (9006, "x" * 300_000, None, "long", None), (9007, first + " " + item, "en", "s", None), (9008, first, None, "copy", None), (9008, first, None, "copy", None), (None, first, None, "copy", None)]
    return spark.createDataFrame([(*r, 0.5, "no", 7, "k") for r in known + odd], KINDS)


def test_stages_on_odd_rows(spark, docs, item):
    before = docs.collect()
    now, kept = docs, {}
    for name, stage in P.STAGES[:-1]:
        now = P.written(stage(spark, now, DATA), name)
        kept[name] = [tuple(r) for r in now.collect()]
        assert now.columns == docs.columns and set(kept[name]) <= {tuple(r) for r in before}
        before = now.collect()
    ids = {name: [r[0] for r in rows] for name, rows in kept.items()}
    assert not {9001, 9002, 9003, 9004} & set(ids["language"]) and {9005, 9007, 9008} <= set(ids["language"])
    first = before and docs.first()["text"]
    same = [r for r in kept["near_duplicates"] if r[1] == first]
    assert len(same) <= 1 and ids["near_duplicates"].count(9008) <= 1
    assert not any(item in (r[1] or "") for r in kept["decontamination"])
    assert all(r[5:] == (0.5, "no", 7, "k") for r in kept["decontamination"])
    last = P.STAGES[-1][1](spark, docs, DATA).collect()
    assert len(last) == docs.count() and {r["n_tokens"] for r in last if r["doc_id"] in (9001, 9002, 9003)} == {0}


@pytest.mark.parametrize("name", [name for name, _ in P.STAGES])
def test_stages_on_an_empty_table_and_without_labels(spark, docs, name):
    stage = dict(P.STAGES)[name]
    assert stage(spark, docs.limit(0), DATA).count() == 0
    if name == "language":
        assert stage(spark, docs.withColumn("lang", F.lit(None).cast("string")), DATA).count() == 0
