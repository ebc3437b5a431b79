"""A corpus pipeline of the operators in plumbline.llm: each stage works on what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontam, jaccard, langid
from plumbline.llm.common import written
from plumbline.llm.queries import VOCABULARY


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified; the model learns from the labelled ones among them.

    Null and empty texts, and those without a letter, go; a null lang does not train, and if no row has a label no
    language is known, so every document goes. Rows are judged one by one, whole texts of any length, so ties and
    repeated rows do not matter and a null or repeated id is no hindrance. An empty table stays empty. All columns stay.
    """
    whole = docs.select("text", F.struct("*").alias("row"))  # columns of the caller's may have the names of what predict() adds
    found = langid.predict(whole, langid.train(docs), keep=["row"])
    return found.where(~F.col("rejected")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with five-word shingles of similarity 0.8 or more.

    The smallest id stays, of equal ids the smallest hash of id and text; a row without an id only where no row with one
    is in its group. Null and empty texts are like no other document and stay; of rows with equal id and text one
    stays. A very long text is compared whole. An empty table stays empty. All columns stay.
    """
    return jaccard.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a passage of the benchmark.

    Each row is judged by its own text, also with a null or repeated id; null and empty texts hold no passage and stay.
    Items that are null or without words find nothing (one of fewer than five words is one shingle), and an empty benchmark
    takes nothing away. Every
    window of a very long text is looked at. An empty table stays empty. All columns stay.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's BPE ids and of what they decode to.

    A row for each row: a null text is encoded as an empty one (no ids), a null id stays null, repeated rows give
    repeated rows, very long texts are encoded whole. Columns are doc_id, n_tokens and the two digests only.
    """
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: The model of the first stage and the components of the second are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
