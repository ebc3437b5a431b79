"""What several operators share: the shared folder, cached tokenising, hashing, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than these (ASCII white space); bytes.split() uses the same set.
WORD_BREAKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, which the cluster names in spark.checkpoint.dir.

    Where that is unset, one machine (a local master, as in tests) takes a temporary folder, and the session then
    keeps it. On a cluster that would lose data, so it is an error there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "local")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors share (master {master})")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder (options: of the writer) and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken, for a helper column beside those of a caller."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle of the whole input gets: the session's own setting, which follows the input's size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary_list(column) -> list[bytes | None]:
    """The values of a string or binary Arrow column as bytes."""
    return column.cast(pa.binary()).to_pylist() if not pa.types.is_binary(column.type) else column.to_pylist()


def batched_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by key into one table for each key."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip(cuts, cuts[1:]):
            part = table.slice(start, end - start)
            if held and held[-1].column(key)[-1] != part.column(key)[0]:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIER
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIER
    return x ^ (x >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Texts are hashed in pieces of about so many bytes, so that the arrays of a batch stay small.
PIECE = 1 << 20


def run_keys(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, 64-bit keys) of the runs of non-space bytes. No key is 0."""
    import xxhash

    space = _SPACE[np.frombuffer(b" " + data + b" " * 9, np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    padded = data + b"\0" * 8
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    key = mix((ends - starts).astype(np.uint64))
    left, at, who = ends - starts, starts.copy(), np.arange(len(starts))
    for _ in range(8):
        n = np.minimum(left, 8)
        part = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - n).astype(np.uint64)))
        key[who] = mix(key[who] * _GOLDEN + part)
        more = left > 8
        who, at, left = who[more], at[more] + 8, left[more] - 8
        if not len(who):
            break
    for i, a in zip(who.tolist(), at.tolist()):  # the rest of runs of more than 64 bytes
        key[i] = (int(key[i]) + xxhash.xxh3_64_intdigest(data[a : ends[i]])) & 0xFFFFFFFFFFFFFFFF
    return starts, ends, np.maximum(key, np.uint64(1))


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut at white space."""
    at = 0
    while len(text) - at > PIECE:
        border = _BREAK.search(text, at + PIECE)
        end = border.end() if border else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all texts' words one after the other, how many words each text has)."""
    counts, keys = np.zeros(len(texts), np.int64), []
    held: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        starts, _, found = run_keys(b"\n".join(held))
        borders = np.cumsum([len(t) + 1 for t in held])
        counts[:] += np.bincount(np.array(owners)[np.searchsorted(borders, starts, "right")], minlength=len(texts))
        keys.append(found)
        held.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for piece in _pieces(text):
            if held and size + len(piece) > PIECE:
                flush()
                size = 0
            held.append(piece)
            owners.append(i)
            size += len(piece)
    if held:
        flush()
    return np.concatenate(keys) if keys else np.empty(0, np.uint64), counts


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of all runs of k words; of the whole sequence where there are fewer; empty without words."""
    h, counts = hashed_words(texts)
    starts = np.cumsum(counts) - counts
    full = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for i in range(k if len(full) else 0):  # also over borders of texts; those are not read below
        full = mix(full * _GOLDEN + h[i : len(full) + i])
    out = []
    for start, n in zip(starts.tolist(), counts.tolist()):
        if n >= k:
            out.append(np.unique(full[start : start + n - k + 1]))
        elif n:
            one = np.full(1, n, np.uint64)
            for i in range(start, start + n):
                one = mix(one * _GOLDEN + h[i])
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(a, b) links of long ids -> (node, component), component being the smallest id that is reachable.

    Alternates the large-star and the small-star step until nothing changes, so the number of rounds grows with
    the logarithm of the longest path. Each round is grouped with partial sums and joined by key, and is cut
    off as a written table. Null ends and self links are dropped; nodes without any link are not returned.
    """

    def distinct(links: DataFrame) -> DataFrame:
        return links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def star(links: DataFrame, both_ways: bool) -> DataFrame:
        near = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else links
        low = near.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        joined = near.join(low, "a")
        if both_ways:  # every larger neighbour goes to the smallest one
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:  # every smaller neighbour, and the node itself
            out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        return distinct(out)

    def state(links: DataFrame):
        return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()

    now = written(distinct(edges.select("a", "b")), tag)
    seen = state(now)
    while True:
        now = written(star(star(now, True), False), tag)
        new = state(now)
        if new == seen:
            break
        seen = new
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
