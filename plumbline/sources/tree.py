"""A source tree as tables: its entries, listed folder by folder in tasks, and the texts of the chosen files.

Python lists and reads, as Spark's file sources leave out names that begin with _ or a dot.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import glob_regex
from plumbline.operators.tables import counted, written

#: Folders that are never read.
SKIPPED = {".git", "node_modules", "__pycache__"}
#: Files that a task reads.
FILES_PER_TASK = 200


def _patterns(globs: list[str]) -> list[re.Pattern]:
    """An invalid pattern matches nothing."""
    out = []
    for g in globs:
        try:
            out.append(re.compile(glob_regex(g)))
        except (ValueError, re.error):
            continue
    return out


def list_tree(spark: SparkSession, root: str, include: list[str] = ("**/*",), exclude: list[str] = ()) -> DataFrame:
    """(path, kind) of what is under root: included, excluded, unmatched, excluded_folder or other. All executors see root.

    Excluded goes before included. Links are excluded and not followed; folders that are never read or that a pattern
    excludes (by name, or by name with a slash) are one row, and nothing below them is listed. Each round lists the folders
    of one level in parallel and is a written table, so a deep tree takes as many rounds as it has levels.
    """
    schema = "path string, kind string"
    no, yes = list(exclude), list(include)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, wanted = _patterns(no), _patterns(yes)
        hit = lambda patterns, text: any(p.search(text) for p in patterns)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                with os.scandir(os.path.join(root, folder)) as entries:
                    for e in entries:
                        path = f"{folder}/{e.name}" if folder else e.name
                        if e.is_symlink():
                            kind = "excluded"
                        elif e.is_dir():
                            kind = "excluded_folder" if e.name in SKIPPED or hit(out, path) or hit(out, path + "/") else "folder"
                        elif not e.is_file():
                            kind = "other"
                        else:
                            kind = "excluded" if hit(out, path) else "included" if hit(wanted, path) else "unmatched"
                        rows.append((path, kind))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["path", "kind"])

    level, left, found = spark.createDataFrame([("",)], "path string"), 1, None
    tasks = spark.sparkContext.defaultParallelism
    while left:
        entries = written(level.repartition(min(left, 8 * tasks)).mapInArrow(run, schema), "listing")
        level, left = counted(entries.where("kind = 'folder'").select("path"), "folders")
        rest = entries.where("kind <> 'folder'")
        found = rest if found is None else found.unionByName(rest)
    return found


def exclusions(entries: DataFrame) -> DataFrame:
    """One row (files, directories): how many were excluded."""
    return entries.agg(F.count_if(F.col("kind") == "excluded").alias("files"), F.count_if(F.col("kind") == "excluded_folder").alias("directories"))


def read_files(entries: DataFrame, root: str) -> DataFrame:
    """(path, code) of the included entries; no other file is opened. Bytes that are no UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(os.path.join(root, path), "rb") as f:
                    code = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([code], pa.string())], names=["path", "code"])

    chosen, n = counted(entries.where("kind = 'included'").select("path"), "chosen")
    return chosen.repartition(max(1, -(-n // FILES_PER_TASK))).mapInArrow(run, "path string, code string")


def read_tree(spark: SparkSession, root: str, include: list[str] = ("**/*",), exclude: list[str] = ()) -> DataFrame:
    """(path, code) of every file under root that is included and not excluded."""
    return read_files(list_tree(spark, root, include, exclude), root)
