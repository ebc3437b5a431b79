"""A Merkle manifest of a table: a digest for each row, a tree for each group of rows, one root, and a proof for each row.

Trees are swept in time-forward order. A node's label is (the last leaf below it, its level), so labels ascend from
children to parents; a priority queue ordered by label holds what children send, and what it delivers for one label are
all children of one node, in order. The reversed sweep sends each node's proof suffix (the siblings from its level up) to
its children, in descending order of labels, so that the queue holds a few nodes of each level.

The queue is external: a block of 4,096 leaves (three levels of 16) is swept in memory by one task, and what blocks send
to each other, digests upwards and suffixes downwards, are rows that Spark shuffles and sorts by label. So a tree of any
size takes log4096(leaves) rounds each way, and neither a large group nor many groups meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import batched_groups, fresh, written

#: Children of a node, and the levels of a block, which one task sweeps.
FAN, LEVELS = 16, 3
#: What manifest() adds.
MADE = ("place", "size", "subroot", "group_place", "groups", "root", "proof")


def leaf(*values: Column) -> Column:
    """The digest of a row's values: of each `-` if it is null, else its UTF-8 bytes' count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def digest(children: str) -> str:
    """A node of its children's digests, which are concatenated as hex text."""
    return hashlib.sha256(children.encode()).hexdigest()


def levels_of(leaves: int) -> int:
    """How many levels stand above so many leaves until one node is left."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def _parent(end: int, level: int, leaves: int) -> tuple[int, int]:
    span = FAN ** (level + 1)
    return min((end // span + 1) * span, leaves) - 1, level + 1


def climb(leaves: list[str], levels: int) -> dict[tuple[int, int], list[str]]:
    """Of a block, label -> children's digests of each node above the leaves; its top has its own digest at (-1, -1)."""
    found: dict[tuple[int, int], list[str]] = {}
    queue: list[tuple[tuple[int, int], int, str]] = []  # label of the receiver, the sender's place in order, what it sends

    def done(end: int, level: int, own: str) -> None:
        if level == levels:
            found[-1, -1] = [own]
        else:
            heappush(queue, (_parent(end, level, len(leaves)), end, own))

    for i, own in enumerate(leaves):
        done(i, 0, own)
        while queue and queue[0][0][0] == i:  # nodes whose last leaf this is have all they wait for
            label, children = queue[0][0], []
            while queue and queue[0][0] == label:
                children.append(heappop(queue)[2])
            found[label] = children
            done(*label, digest("".join(children)))
    return found


def descend(found: dict[tuple[int, int], list[str]], leaves: int, levels: int, suffix: str) -> Iterator[tuple[int, str]]:
    """(leaf, its proof) of a block whose top has the given proof suffix, from the last leaf to the first."""
    queue = [(-(leaves - 1), -levels, suffix)]
    while queue:
        end, level, own = heappop(queue)
        end, level = -end, -level
        if not level:
            yield end, own
            continue
        children, span = found[end, level], FAN ** (level - 1)
        first = end // (span * FAN) * FAN
        for i in range(len(children)):
            last = min((first + i + 1) * span, leaves) - 1
            heappush(queue, (-last, 1 - level, "".join(children[:i] + children[i + 1 :]) + own))


def fold(own: str, proof: str, trees: list[tuple[int, int]]) -> str:
    """The root that a leaf and its proof give; trees has (place, leaves) of the leaf in its tree, and of that in the next."""
    at = 0
    for place, leaves in trees:
        while leaves > 1:
            first = place // FAN * FAN
            siblings = proof[at : at + 64 * (min(FAN, leaves - first) - 1)]
            at += len(siblings)
            cut = 64 * (place - first)
            own = digest(siblings[:cut] + own + siblings[cut:])
            place, leaves = place // FAN, -(-leaves // FAN)
    return own


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (_key, ...) with place, from 0 in their key, and size, the rows of the key.

    Ranges of (key, order) are numbered apart; a range and key has the number of the key's rows in the ranges before it.
    So a key that holds most rows is many ranges, and equal rows are told apart by the place where they were read.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select("*", *[o.alias(n) for n, o in zip(names, order)], F.monotonically_increasing_id().alias("_read"))
    dealt = written(keyed.repartitionByRange("_key", *names, "_read").withColumn("_range", F.spark_partition_id()), "merkle-ranges")
    sizes = dealt.groupBy("_key", "_range").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_key").orderBy("_range")
    sizes = sizes.select("_key", "_range", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("_key")).alias("size"))
    own = F.row_number().over(Window.partitionBy("_key", "_range").orderBy(*names, "_read"))
    placed = dealt.withColumn("_own", own.cast("long")).join(sizes, ["_key", "_range"])
    return placed.withColumn("place", F.col("_own") - 1 + F.col("_before")).drop("_own", "_before", "_range", "_read", *names)


def _blocks(rows: DataFrame) -> DataFrame:
    """rows (_key, place, ...) with the blocks of one task together, in order of labels; messages (place -1) come first."""
    return rows.repartition("_key", "_block").withColumn("_at", F.concat_ws("\0", F.col("_block").cast("string"), "_key")).sortWithinPartitions("_at", "place")


def _up(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes (_key, size, place, digest) -> the same of each block's top; a tree of one block ends at its root."""
    block_size = FAN**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batched_groups(batches, "_at"):
            key, size, at = (block.column(c)[0].as_py() for c in ("_key", "size", "_block"))
            leaves = block.column("digest").to_pylist()
            top = climb(leaves, levels_of(size) if size <= block_size else levels)[-1, -1][0]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((key, pa.string()), (-(-size // block_size), pa.int64()), (at, pa.int64()), (top, pa.string()))], names=["_key", "size", "place", "digest"])

    rows = nodes.select("_key", "size", "place", "digest", F.expr(f"place div {block_size}").alias("_block"))
    return _blocks(rows).mapInArrow(run, "_key string, size long, place long, digest string")


def _down(nodes: DataFrame, messages: DataFrame, levels: int) -> DataFrame:
    """nodes (_key, size, place, digest, ...) and messages (_key, place, proof, ...), one for each block by its number -> nodes with proof.

    What else nodes have stays with them; what else messages have goes to each node of their block.
    """
    block_size = FAN**levels
    extra = [c for c in nodes.columns if c not in ("_key", "size", "place", "digest")]
    sent = [c for c in messages.columns if c not in ("_key", "place", "proof")]
    none = lambda df, names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    own = nodes.select("_key", "size", "place", "digest", F.expr(f"place div {block_size}").alias("_block"), *extra, *none(messages, sent))
    told = messages.select("_key", F.lit(0).cast("long").alias("size"), F.lit(-1).cast("long").alias("place"), F.col("proof").alias("digest"), F.col("place").alias("_block"), *none(nodes, extra), *sent)
    made = own.drop("_block").withColumn("proof", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batched_groups(batches, "_at"):
            block = block.combine_chunks()
            rows = block.slice(1)
            size, leaves = rows.column("size")[0].as_py(), rows.column("digest").to_pylist()
            above = levels_of(size) if size <= block_size else levels
            proofs = [""] * len(leaves)
            part = max(1, (1 << 22) // (64 * FAN * levels + len(block.column("digest")[0].as_py())))  # about 4 MB of proofs go out at once
            first = len(leaves)
            for i, proof in descend(climb(leaves, above), len(leaves), above, block.column("digest")[0].as_py()):
                proofs[i] = proof
                if first - i >= part or not i:
                    out = rows.slice(i, first - i)
                    columns = [pa.array(proofs[i:first], pa.string()) if c == "proof" else pa.array([block.column(c)[0].as_py()] * out.num_rows, out.schema.field(c).type) if c in sent else out.column(c).combine_chunks() for c in made.names]
                    yield pa.RecordBatch.from_arrays(columns, names=made.names)
                    proofs[i:first] = [""] * (first - i)
                    first = i

    return _blocks(own.unionByName(told)).mapInArrow(run, made)


def _sweep_up(nodes: DataFrame, largest: int, levels: int) -> list[DataFrame]:
    """The nodes, and the tops of their blocks, round by round until the tree of largest leaves has one node."""
    out = [nodes]
    while len(out) == 1 or largest > 1:
        out.append(written(_up(out[-1], levels), "merkle-up"))
        largest = -(-largest // FAN**levels)
    return out


def manifest(rows: DataFrame, by: str, order: list[str], digest: str = "leaf", levels: int = LEVELS) -> DataFrame:
    """Each row with place and size (in its group's tree), subroot, group_place and groups (the tree of subroots), root and proof.

    digest is a column of hex text (see leaf()). The rows of a group, which has one value of by, are the leaves of its
    tree in ascending order of the columns order, nulls first, then of the digest; rows alike in all of that are
    interchangeable. While more than one node remains, every 16 consecutive ones (at the end fewer, even one) become
    one; the group's subroot is what remains. The groups' subroots, ordered by by (null first, UTF-8 bytewise), likewise give
    root. proof has the siblings' digests from the leaf's level to the root, left to right, 64 digits each.

    A null by is a group of its own; a row with nulls is a row like others; repeated rows are leaves each; an empty
    table gives an empty one. A task sweeps blocks of 16^levels leaves. Columns of rows are kept, but for those named like the ones that are added.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c.lower() not in MADE]
    whole = F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)]) if names else F.struct(F.lit(0).alias("_"))
    keyed = rows.select(F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("_key"), F.col(digest).alias("digest"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(order)], whole.alias("_row"))
    ranked = _ranked(keyed, [F.col(f"_by{i}") for i in range(len(order))] + [F.col("digest")])
    leaves = written(ranked.select("_key", "size", "place", "digest", "_row"), "merkle-leaves")
    largest = leaves.agg(F.max("size")).first()[0] or 0
    trees = _sweep_up(leaves.select("_key", "size", "place", "digest"), largest, levels)
    subroots = trees[-1].select(F.lit("").alias("_key"), "digest", F.col("_key").alias("_group"))
    top = written(_ranked(subroots, [F.col("_group")]).select("_key", "size", "place", "digest", "_group"), "merkle-groups")
    upper = _sweep_up(top.select("_key", "size", "place", "digest"), top.count(), levels)

    messages = upper[-1].select("_key", F.lit(0).cast("long").alias("place"), F.lit("").alias("proof"))
    for nodes in [*upper[-2:0:-1], top]:
        messages = written(_down(nodes, messages, levels).drop("size", "digest"), "merkle-down")
    of_all = upper[-1].select("_key", F.col("digest").alias("root"))
    known = messages.join(F.broadcast(of_all), "_key").join(top.select("_group", F.col("digest").alias("subroot"), F.col("size").alias("groups")), "_group")  # one root
    known = written(known.select(F.col("_group").alias("_key"), "proof", "subroot", F.col("place").alias("group_place"), "groups", "root"), "merkle-known")
    messages = known.select("_key", F.lit(0).cast("long").alias("place"), "proof")
    for nodes in trees[-2:0:-1]:
        messages = written(_down(nodes, messages, levels).select("_key", "place", "proof"), "merkle-down")
    told = messages.join(known.drop("proof"), "_key")
    out = _down(leaves, told, levels)
    return out.select(*[F.col(f"_row._{i}").alias(c) for i, c in enumerate(names)], *MADE)


def folded(rows: DataFrame, own: Column, name: str = "folded_root") -> DataFrame:
    """rows of manifest() with name: the root that the digest own gives with the row's proof and places, null where own is null."""
    helper = fresh("_own", rows.columns)
    source = rows.drop(name).withColumn(helper, own)
    schema = source.drop(helper).schema.add(name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (helper, "proof", "place", "size", "group_place", "groups")]
            roots = [None if o is None else fold(o, p, [(a, n), (b, m)]) for o, p, a, n, b, m in zip(*read)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in schema.names[:-1]], pa.array(roots, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


def manifest_sql() -> str:
    """DuckDB SQL of the query's columns, with one recursion over the levels of the trees."""
    cell = lambda c: f"coalesce(octet_length(encode({c}::varchar)) || ':' || ({c}::varchar), '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    row = lambda text: f"sha256({' || '.join([cell('doc_id'), cell('source'), cell('lang'), cell('n_chars'), cell(text)])})"
    step = "list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint)), lambda c, b: {step}), 4294967295)"

    def tree(name: str, leaves: str) -> str:
        """name_up has the nodes of all levels, name_path of each leaf the siblings and what a fold needs, level by level."""
        return f"""{name}_up(g, level, i, h, n) as (select g, 0::bigint, i, h, n from {leaves} union all
            select g, level + 1, i // 16, sha256(string_agg(h, '' order by i)), (n + 15) // 16 from {name}_up where n > 1 group by g, level, i // 16, n),
        {name}_run as (select g, level, i // 16 as run, list(h order by i) as hs from {name}_up where n > 1 group by all),
        {name}_path as (select l.g, l.i, list({{'left': array_to_string(r.hs[1:k], ''), 'right': array_to_string(r.hs[k + 2:], '')}} order by r.level) as path
            from (select g, i, level, i // (16 ** level)::bigint as at from {leaves} join (select distinct g, level from {name}_run) using (g)) l
            join {name}_run r on r.g = l.g and r.level = l.level and r.run = l.at // 16 cross join lateral (select l.at % 16 as k) group by l.g, l.i)"""

    return f"""with recursive d as (select doc_id, coalesce('=' || source, '') as g, {row('text')} as leaf, case when {crc} % 5 = 0 then {row(lower)} end as changed from documents),
        l as (select *, leaf as h, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from d), {tree('low', 'l')},
        s as (select '' as g, g as own, h, row_number() over (order by encode(g)) - 1 as i, count(*) over () as n from low_up where n = 1), {tree('top', 's')},
        p as (select l.doc_id, l.leaf, coalesce(l.changed, l.leaf) as start, s.h as subroot, (select h from top_up where n = 1) as root,
            list_concat(coalesce(a.path, []), coalesce(b.path, [])) as path from l join s on s.own = l.g left join low_path a on a.g = l.g and a.i = l.i left join top_path b on b.i = s.i),
        f as (select *, array_to_string(list_transform(path, lambda x: x['left'] || x['right']), '') as proof,
            list_reduce(list_prepend({{'left': '', 'right': start}}, path), lambda a, b: {{'left': '', 'right': sha256(b['left'] || a['right'] || b['right'])}})['right'] as folded_root from p)
        select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded_root, folded_root = root as verified from f"""
