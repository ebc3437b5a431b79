"""Cutting plans: written tables in the shared folder, and columns that the optimiser leaves alone."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only one machine (a local master, as in tests) may do without, in a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken, for a helper column beside those of a caller."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out over all cores where its source has fewer parts than that (small or unsplittable files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the folder that the cluster names in spark.checkpoint.dir, and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """written(df), and how many rows it has, which are counted while they are written."""
    seen = Observation()
    made = written(df.observe(seen, F.count(F.lit(1)).alias("n")), tag)
    return made, seen.get["n"]


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once. A plain one would be written out wherever lambdas and filters use it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


#: Bytes of a dictionary that Parquet keeps of a column while it writes, by default and at most.
DICTIONARY, LARGEST_DICTIONARY = 1 << 20, 64 << 20


def shared_values(spark: SparkSession, size: int, column: str) -> None:
    """Has Parquet writers of this session keep dictionaries of size bytes, for a column whose values are long and shared by many rows.

    By default they keep 1 MiB, then write every row's value, and first look at a page's size after 100 rows. Sizes within
    the default change nothing.
    """
    if size <= int(spark.conf.get("parquet.dictionary.page.size", str(DICTIONARY))):
        return
    spark.conf.set("parquet.dictionary.page.size", str(min(size, LARGEST_DICTIONARY)))
    spark.conf.set("parquet.page.size.row.check.min", "8")  # a first page of one row would look as if a dictionary saved nothing
    spark.conf.set(f"parquet.column.statistics.enabled#{column}", "false")
