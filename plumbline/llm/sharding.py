"""Shards of bounded size by extendible hashing, with DataFrame functions only.

A directory is indexed by the first bits of a row's hash. It begins with one bucket; a bucket with more bytes than a
shard may have is split on its next bit, and only such buckets are, until every bucket fits. A round measures the
oversized buckets some bits deeper at once (partial sums, one row for each prefix), and then splits bit by bit within
those sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, written

#: Bits of a hash; a bucket at this depth is not split further.
BITS = 60
#: Bits that a round looks ahead.
STEP = 6


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; of a null key, those of the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _prefix(bits: Column, depth: Column) -> Column:
    return F.call_function("shiftright", bits, (F.lit(BITS) - depth).cast("int"))


def directory(rows: DataFrame, byte_limit: int) -> DataFrame:
    """(depth, prefix, shard_rows, shard_bytes) of each shard; rows has bits and bytes. Written in the shared folder."""
    leaves, depth = None, 0
    whole = rows.agg(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), F.count("*").alias("shard_rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("shard_bytes"))
    open_nodes = written(whole.where("shard_rows > 0"), "shards")
    while True:
        fits = (F.col("shard_bytes") <= byte_limit) | (F.col("depth") >= BITS)
        done = open_nodes.where(fits)
        leaves = done if leaves is None else leaves.unionByName(done)
        over = open_nodes.where(~fits).select(F.col("prefix").alias("parent"))
        if over.isEmpty():
            return leaves
        deeper = min(STEP, BITS - depth)
        split = rows.join(over, _prefix(F.col("bits"), F.lit(depth)) == F.col("parent"), "left_semi") if depth else rows
        fine = split.groupBy(_prefix(F.col("bits"), F.lit(depth + deeper)).alias("fine")).agg(F.count("*").alias("shard_rows"), F.sum("bytes").alias("shard_bytes"))
        at = F.explode(F.sequence(F.lit(1), F.lit(deeper))).alias("up")
        nodes = fine.select("*", at).groupBy((F.col("up") + depth).alias("depth"), F.call_function("shiftright", F.col("fine"), (F.lit(deeper) - F.col("up")).cast("int")).alias("prefix")).agg(F.sum("shard_rows").alias("shard_rows"), F.sum("shard_bytes").alias("shard_bytes"))
        nodes = written(nodes, "shards")
        # a node is there if its parent was split: those above it in this round, or the open ones of the last round
        above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("shard_bytes").alias("above"))
        joined = nodes.withColumn("up", F.call_function("shiftright", F.col("prefix"), F.lit(1))).join(above, ["depth", "up"], "left")
        there = joined.where((F.col("depth") == depth + 1) | (F.col("above") > byte_limit)).select("depth", "prefix", "shard_rows", "shard_bytes")
        leaves = leaves.unionByName(there.where((F.col("depth") < depth + deeper) & (F.col("shard_bytes") <= byte_limit)))
        open_nodes = there.where(F.col("depth") == depth + deeper)
        depth += deeper


def assign(docs: DataFrame, byte_limit: int, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add shard, shard_depth, shard_rows and shard_bytes to the columns keep (all by default) of each row.

    shard is the shard's hash prefix as a string of bits (empty if everything fits one shard). A row weighs the UTF-8
    bytes of its text, 0 for a null or empty one. Rows with equal keys (null counts as the empty text) share a shard, and
    a shard exceeds the limit only if a single key does, at depth 60. Columns of these names are replaced. The
    directory is joined by the hash prefixes of the depths that occur; it has one row for each shard.
    """
    made = ("shard", "shard_depth", "shard_rows", "shard_bytes")
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    weight = F.coalesce(F.octet_length(docs[text].cast("string")), F.lit(0)).cast("long")
    narrow = written(docs.select(hash_bits(docs[key]).alias("bits"), weight.alias("bytes")), "shard-rows")
    shards = written(directory(narrow, byte_limit), "shards")
    depths = sorted(r["depth"] for r in shards.select("depth").distinct().collect())
    prefix = fresh("_prefix", [*names, *made])
    low = F.concat(F.lit("0" * BITS), F.bin("prefix"))
    entries = shards.select(F.col("depth").alias("shard_depth"), F.col("prefix").alias(prefix), F.substring(low, F.length(low) - F.col("depth") + 1, F.col("depth")).alias("shard"), "shard_rows", "shard_bytes")
    # each row has one shard: that depth at which its prefix is in the directory
    bits, depth = (fresh(n, [*names, *made]) for n in ("_bits", "_depth"))
    wide = docs.select(*[docs[c] for c in names], hash_bits(docs[key]).alias(bits))
    tried = wide.withColumn(depth, F.explode(F.array(*[F.lit(d) for d in depths] or [F.lit(0)])))
    joined = tried.join(entries, (tried[depth] == entries["shard_depth"]) & (_prefix(tried[bits], tried[depth]) == entries[prefix]))
    return joined.select(*[F.col(f"`{c}`") for c in names], *made)


def assign_sql(byte_limit: int, deepest: int = 24, documents: str = "documents") -> str:
    """DuckDB SQL of assign() with the column doc_id, for data whose shards are not deeper than deepest, but for those of a key over the limit."""
    return f"""
    with d as (select doc_id, row_number() over () as own, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, {BITS // 4}) as bigint) as bits, cast(coalesce(strlen(text), 0) as bigint) as bytes from {documents}),
    n as (select doc_id, own, k, bits >> ({BITS} - k) as prefix, count(*) over (partition by k, bits >> ({BITS} - k)) as shard_rows, cast(sum(bytes) over (partition by k, bits >> ({BITS} - k)) as bigint) as shard_bytes
        from d, (select unnest(generate_series(0, {deepest})) as k union all select {BITS})),
    f as (select *, row_number() over (partition by own order by k) as r from n where shard_bytes <= {byte_limit} or k = {BITS})
    select doc_id, case when k = 0 then '' else right(repeat('0', {BITS}) || to_binary(prefix), cast(k as bigint)) end as shard, cast(k as integer) as shard_depth, shard_rows, shard_bytes from f where r = 1"""
