"""The queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, collocations, decontam, grammar_ids, hnsw, jaccard, langid, maxent, merkle, quality, sharding, urlfilter, warc

VOCABULARY = "word_bpe_49k.json"
#: The byte limit of a shard.
SHARD_BYTES = 1 << 20
#: Fixed values of the query's contract.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out over all cores where its files have fewer parts than that."""
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return read.repartition(cores) if read.rdd.getNumPartitions() < cores else read


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.read_histories(spark, warc.write_archives(table(spark, sf_dir, "pages")))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES, keep=["doc_id"])


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 5)
    found = langid.predict(docs, langid.train(docs.where(~held)), keep=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op9_grammar_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar_ids.read_documents(grammar_ids.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=2))


def op10_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return maxent.lm_scores(docs, train=~langid.held_out(F.col("doc_id"), 10))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), quality.held_out(F.col("doc_id"), 4, 2)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held))
    found = quality.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents"), top=2000, least=30)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select("doc_id", "source", merkle.leaf(*fields, F.col("text")).alias("leaf"), F.when(tampered, merkle.leaf(*fields, lower)).alias("changed"))
    found = merkle.folded(merkle.manifest(rows, "source", ["doc_id"]), F.coalesce("changed", "leaf"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op1_decontam": op1_decontam, "op2_jaccard": op2_jaccard, "op3_warc": op3_warc, "op4_urlfilter": op4_urlfilter, "op5_hnsw": op5_hnsw, "op6_sharding": op6_sharding, "op7_bpe": op7_bpe, "op8_langid": op8_langid, "op9_grammar_ids": op9_grammar_ids, "op10_maxent": op10_maxent, "op11_quality": op11_quality, "op12_collocations": op12_collocations, "op13_merkle": op13_merkle}
ORACLE_SQL: dict[str, str] = {"op1_decontam": decontam.contaminated_sql(), "op3_warc": warc.captures_sql(), "op6_sharding": sharding.assign_sql(SHARD_BYTES), "op12_collocations": collocations.collocations_sql(), "op13_merkle": merkle.manifest_sql()}
