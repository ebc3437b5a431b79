"""Baselines: named snapshots as Parquet, committed by one small manifest, so that a save is whole or not there."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The form of a name, and the version of what is stored.
NAME = re.compile(r"[a-zA-Z0-9][a-zA-Z0-9._-]{0,63}")
SCHEMA_VERSION = "1.0"


class Store:
    """The manifests of a folder, by Hadoop's file systems, so that any store Spark writes to will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.hadoop, self.conf, self.root = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), root
        self.gateway = spark.sparkContext._gateway

    def path(self, name: str):
        if not NAME.fullmatch(name):
            raise ValueError(f"not a baseline name: {name!r}")
        return self.hadoop.Path(f"{self.root}/{name}.json")

    def exists(self, name: str) -> bool:
        path = self.path(name)
        return path.getFileSystem(self.conf).exists(path)

    def read(self, name: str) -> dict:
        """The manifest; ValueError if it is of another version."""
        path = self.path(name)
        files = path.getFileSystem(self.conf)
        stream = files.open(path)
        try:
            data = bytes(self.gateway.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        found = json.loads(data)
        if found.get("schemaVersion") != SCHEMA_VERSION:
            raise ValueError(f"baseline {name!r} has an unsupported or missing schemaVersion")
        return found

    def commit(self, name: str, manifest: dict, replace: bool) -> None:
        """The manifest appears under its name by one rename; without replace an existing one makes that fail."""
        place, draft = self.path(name), self.hadoop.Path(f"{self.root}/.{name}-{uuid.uuid4().hex}")
        stream = draft.getFileSystem(self.conf).create(draft, False)
        stream.writeBytes(json.dumps(manifest, sort_keys=True))
        stream.close()
        rename = getattr(self.hadoop, "Options$Rename")
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if replace else rename.NONE
        self.hadoop.FileContext.getFileContext(place.toUri(), self.conf).rename(draft, place, how)


def save(tables: dict[str, DataFrame], root: str, name: str, replace: bool = False, properties: dict | None = None) -> None:
    """Tables first, in a folder of their own, then the manifest, which is the commit.

    Without replace, an existing baseline is an error. A save that fails leaves the old one as it was; the tables of
    replaced and failed ones stay until the folder is cleared. properties are kept with the manifest.
    """
    if not NAME.fullmatch(name):
        raise ValueError(f"not a baseline name: {name!r}")
    if not tables:
        raise ValueError("a baseline has a table at least")
    spark = next(iter(tables.values())).sparkSession
    store = Store(spark, root)
    if not replace and store.exists(name):
        raise FileExistsError(f"baseline {name!r} exists")
    folder = f"{root}/tables/{name}-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}")
    store.commit(name, {"schemaVersion": SCHEMA_VERSION, "tables": {t: f"{folder}/{t}" for t in tables}, "properties": properties or {}}, replace)


def load(spark: SparkSession, root: str, name: str, table: str) -> DataFrame:
    """A table of a baseline, as its manifest names it."""
    return spark.read.parquet(Store(spark, root).read(name)["tables"][table])


def properties(spark: SparkSession, root: str, name: str) -> dict:
    return Store(spark, root).read(name)["properties"]
