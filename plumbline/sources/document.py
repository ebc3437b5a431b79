"""One JSON document from tables: tasks write the rows, and a commit joins their parts without any row on the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_document(spark: SparkSession, pieces: list[str | DataFrame], path: str, replace: bool = False) -> None:
    """Texts and tables in turn, each table (one column of JSON objects) as the items of a list, in its order.

    The tables are written as text first, beside the path. Then the parts are copied one after the other as streams of
    bytes, and the whole appears under its name by one rename: a write that fails leaves no document, or the old one.
    Without replace an existing document is an error.
    """
    fs, conf, gateway = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
    place, staging = fs.Path(path), f"{path}.{uuid.uuid4().hex}"
    files = place.getFileSystem(conf)
    if not replace and files.exists(place):
        raise FileExistsError(path)
    for i, piece in enumerate(pieces):
        if isinstance(piece, DataFrame):
            name = piece.columns[0]
            piece.select(F.concat(F.lit(","), F.col(f"`{name}`")).alias("value")).write.text(f"{staging}/{i}")
    draft = fs.Path(f"{staging}/document")
    out = files.create(draft, False)
    try:
        for i, piece in enumerate(pieces):
            if isinstance(piece, str):
                out.write(bytearray(piece.encode()))
                continue
            parts = sorted(s.getPath().getName() for s in files.listStatus(fs.Path(f"{staging}/{i}")))
            first = True
            for part in (p for p in parts if p.startswith("part-")):
                where = fs.Path(f"{staging}/{i}/{part}")
                if not files.getFileStatus(where).getLen():
                    continue
                stream = files.open(where)
                if first:
                    stream.skip(1)  # no comma before the first item
                    first = False
                gateway.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                stream.close()
    finally:
        out.close()
    rename = getattr(fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else rename.NONE
    fs.FileContext.getFileContext(place.toUri(), conf).rename(draft, place, how)
    files.delete(fs.Path(staging), True)
