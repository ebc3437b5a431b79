"""Nearest neighbours by largest inner product: a hierarchical navigable small-world graph for each shard.

Equal vectors are one node. Vectors of one length and of norms between two powers of two are a band; a band's nodes are
dealt to shards of bounded size by a hash; each shard is built on its own and stored as flat arrays (vectors, and for each layer its nodes and a matrix of neighbours). A query goes through every
shard of its length: blocks of queries are sent to where a shard's graph is, which moves only once for many blocks, and the
shards' results are merged. Largest inner product becomes nearest direction by one more coordinate that gives all
vectors of a shard the same norm; within a band it is as large as the others, so that single precision tells vectors
apart however unequal the norms of all are. Graphs hold scaled single-precision vectors; scores come from the given ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import batched_groups, written

SHARD_ROWS = 8192
QUERY_BLOCK = 1024
#: So many blocks of queries go to one copy of a shard's graph.
TASK_BLOCKS = 64
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 64, 128


def beam_search(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, products) of the best width nodes that each query reaches from its entries, best first; -1 where fewer.

    All queries step together: each opens its best node that is not yet opened, until none of its best ones is closed.
    """
    count, rows = len(queries), np.arange(len(queries))
    seen = np.zeros((count, len(vectors) + 1), bool)
    seen[:, -1] = True  # stands for "no neighbour"
    first = entries.shape[1]
    nodes = np.full((count, width + first), -1, np.int64)
    score = np.full((count, width + first), -np.inf, np.float32)
    opened = np.ones((count, width + first), bool)
    for k in range(first):
        e = entries[:, k]
        new = ~seen[rows, e]
        seen[rows, e] = True
        r = rows[new]
        nodes[r, k], opened[r, k] = e[new], False
        score[r, k] = np.einsum("ij,ij->i", queries[r], vectors[e[new]])
    order = np.argsort(-score, 1, kind="stable")[:, :width]
    nodes, score, opened = (np.take_along_axis(x, order, 1) for x in (nodes, score, opened))
    live = rows
    while len(live):
        best = np.argmax(np.where(opened[live], -np.inf, score[live]), 1)
        going = ~opened[live, best]
        live, best = live[going], best[going]
        if not len(live):
            break
        opened[live, best] = True
        near = neighbours[nodes[live, best]]
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        found = np.einsum("ij,ikj->ik", queries[live], vectors[np.where(fresh, near, 0)], optimize=False)
        found[~fresh] = -np.inf
        all_nodes = np.concatenate([nodes[live], np.where(fresh, near, -1)], 1)
        all_score = np.concatenate([score[live], found.astype(np.float32)], 1)
        all_open = np.concatenate([opened[live], ~fresh], 1)
        order = np.argpartition(-all_score, width - 1, 1)[:, :width]
        nodes[live], score[live], opened[live] = (np.take_along_axis(x, order, 1) for x in (all_nodes, all_score, all_open))
    order = np.argsort(-score, 1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(score, order, 1)


def _diverse(vectors: np.ndarray, node: int, candidates: np.ndarray, most: int) -> np.ndarray:
    """Of candidates in order of nearness, those that are nearer to the node than to any chosen one; filled up in order."""
    own = vectors[candidates] @ vectors[node]
    between = vectors[candidates] @ vectors[candidates].T
    chosen: list[int] = []
    for i in range(len(candidates)):
        if len(chosen) < most and all(between[i, j] < own[i] for j in chosen):
            chosen.append(i)
    for i in range(len(candidates)):
        if len(chosen) >= most:
            break
        if i not in chosen:
            chosen.append(i)
    return candidates[chosen]


class Graph:
    """The layers of one shard, from the base up: the nodes of each and a matrix of their neighbours (-1: none)."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> Graph:
        n, rng = len(vectors), np.random.default_rng(seed)
        level = np.floor(-np.log(rng.random(n)) / np.log(LINKS)).astype(int)
        level[rng.integers(n)] = level.max()
        graph = cls(vectors, [])
        order = rng.permutation(n)
        for layer in range(level.max(), -1, -1):  # an upper layer leads to the entries of the one below
            members = order[level[order] >= layer]
            most = 2 * LINKS if layer == 0 else LINKS
            full = np.full((n, most), -1, np.int64)
            done = 0
            while done < len(members):
                batch = members[done : done + max(1, min(512, done // 2))]
                if done:
                    entries = graph.entries(vectors[batch]) if graph.layers else np.repeat(members[:1], len(batch))[:, None]
                    if graph.layers and done <= len(graph.layers[0][0]):  # an entry may not be in this layer yet
                        entries = np.repeat(members[:1], len(batch))[:, None]
                    elif graph.layers:
                        placed = np.zeros(n, bool)
                        placed[members[:done]] = True
                        entries = np.where(placed[entries], entries, members[0])
                    near, _ = beam_search(vectors, full, vectors[batch], entries, BUILD_WIDTH)
                    mates = vectors[batch] @ vectors[batch].T
                    for i, node in enumerate(batch.tolist()):
                        known = near[i][near[i] >= 0]
                        earlier = batch[:i][np.argsort(-mates[i, :i])[:LINKS]]
                        both = np.concatenate([known, earlier])
                        both = both[np.argsort(-(vectors[both] @ vectors[node]), kind="stable")]
                        chosen = _diverse(vectors, node, both[:BUILD_WIDTH], LINKS)
                        full[node, : len(chosen)] = chosen
                        for other in chosen.tolist():
                            row = full[other]
                            free = np.flatnonzero(row < 0)
                            if len(free):
                                row[free[0]] = node
                            else:
                                all_near = np.append(row, node)
                                all_near = all_near[np.argsort(-(vectors[all_near] @ vectors[other]), kind="stable")]
                                full[other] = _diverse(vectors, other, all_near, most)
                done += len(batch)
            graph.layers.insert(0, (members, full[members]))
        return graph

    def _matrix(self, layer: int) -> np.ndarray:
        members, near = self.layers[layer]
        full = np.full((len(self.vectors), near.shape[1]), -1, np.int64)
        full[members] = near
        return full

    def entries(self, queries: np.ndarray, down_to: int = 0, width: int = 4) -> np.ndarray:
        """The nodes where each query enters the layer below down_to."""
        at = np.repeat(self.layers[-1][0][:1], len(queries))[:, None]
        for layer in range(len(self.layers) - 1, down_to - 1, -1):
            at, _ = beam_search(self.vectors, self._matrix(layer), queries, np.where(at < 0, at[:, :1], at), width)
        return np.where(at < 0, at[:, :1], at)

    def search(self, queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
        """The nodes nearest to each query, best first; -1 where there are fewer."""
        start = self.entries(queries, 1) if len(self.layers) > 1 else np.repeat(self.layers[0][0][:1], len(queries))[:, None]
        return beam_search(self.vectors, self._matrix(0), queries, start, width)[0]


def _matrix_of(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


INDEX = "shard int, members array<array<long>>, exact binary, vectors binary, levels array<int>, layer_nodes binary, neighbours binary"


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors over their largest component: the order of inner products stays, and single precision holds them."""
    return vectors / np.abs(vectors).max(initial=1e-300)


def band(vector: Column) -> Column:
    """The power of two at or below a vector's norm, without overflow; rounding may put a norm near a border beyond it."""
    most = F.array_max(F.transform(vector, F.abs))
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + (x / most) * (x / most))
    return F.floor(F.log2(most) + F.log2(squares) / 2).cast("int")


def dealt(nodes: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """nodes (members, vector) with their shard, and the first and last shard of each length. Lengths and bands are few."""
    marked = nodes.withColumn("n", F.size("vector")).withColumn("band", band(F.col("vector")))
    rows, spans, first = [], {}, 0
    for r in marked.groupBy("n", "band").count().orderBy("n", "band").collect():
        count = -(-r["count"] // SHARD_ROWS)
        rows.append((r["n"], r["band"], first, count))
        first += count
        spans[r["n"]] = spans.get(r["n"], (first - count, 0))[0], first - 1
    bands = nodes.sparkSession.createDataFrame(rows, "n int, band int, first int, count int")
    placed = marked.join(F.broadcast(bands), ["n", "band"])  # a row for each length and power of two
    return placed.select("members", "vector", (F.col("first") + F.expr("cast(pmod(xxhash64(vector), count) as int)")).alias("shard")), spans


def build_index(placed: DataFrame, shards: int) -> DataFrame:
    """placed (members, vector, shard) -> a row of INDEX for each shard, written in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in batched_groups(batches, "shard"):
            exact = _matrix_of(group.column("vector")).astype(np.float64)
            scaled = _scaled(exact)
            norm2 = np.einsum("ij,ij->i", scaled, scaled)
            longer = np.concatenate([scaled, np.sqrt(np.maximum(0, norm2.max() - norm2))[:, None]], 1).astype(np.float32)
            graph = Graph.build(longer, seed=len(longer))
            shard = group.column("shard")[0].as_py()
            members = pa.array([group.column("members").to_pylist()], pa.list_(pa.list_(pa.int64())))
            made = [exact.astype("<f8").tobytes(), longer.astype("<f4").tobytes(), [len(m) for m, _ in graph.layers], b"".join(m.astype("<i4").tobytes() for m, _ in graph.layers), b"".join(x.astype("<i4").tobytes() for _, x in graph.layers)]
            kinds = [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), members, *(pa.array([x], k) for x, k in zip(made, kinds))], names=[x.split()[0] for x in INDEX.split(", ")])

    built = placed.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, INDEX)
    return written(built, "hnsw")


def load(vectors: bytes, levels: list[int], layer_nodes: bytes, neighbours: bytes, n: int) -> Graph:
    nodes, near = np.frombuffer(layer_nodes, "<i4").astype(np.int64), np.frombuffer(neighbours, "<i4").astype(np.int64)
    layers, a, b = [], 0, 0
    for k, size in enumerate(levels):
        most = 2 * LINKS if k == 0 else LINKS
        layers.append((nodes[a : a + size], near[b : b + size * most].reshape(size, most)))
        a, b = a + size, b + size * most
    return Graph(np.frombuffer(vectors, "<f4").reshape(n, -1), layers)


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows that are found with the largest inner product to each query's row.

    Every row but the query's own is a candidate. score is the inner product in double precision of the vectors as
    stored; ties go to the smaller id. Vectors that are null, zero or hold null or non-finite components, and null ids,
    take no part. Vectors of different lengths have no product: a query's candidates are those of its own length. With
    fewer than k candidates all that a shard reaches are returned. Other columns are not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    source = rows.select(rows[id_column].cast("long").alias("id"), rows[vector].cast("array<double>").alias("vector"), is_query.alias("is_query")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    # of equal vectors the k + 1 smallest ids are enough for any answer; the limit works before the shuffle
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    nodes = written(source.withColumn("p", place).where(F.col("p") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("members")), "vectors")
    placed, spans = dealt(nodes)
    if not spans:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = max(last for _, last in spans.values()) + 1
    index = build_index(placed, shards)

    asked = source.where(F.coalesce(F.col("is_query"), F.lit(False))).select("id", "vector")
    distinct = written(asked.select("vector").distinct().withColumn("query", F.xxhash64("vector")), "queries")
    blocks = max(1, -(-distinct.count() // QUERY_BLOCK))
    groups = -(-blocks // TASK_BLOCKS)
    packed = distinct.groupBy(F.size("vector").alias("n"), F.expr(f"cast(pmod(query, {blocks}) as int)").alias("block")).agg(F.collect_list(F.struct("query", "vector")).alias("q"))  # about QUERY_BLOCK queries
    task = (F.col("shard") * groups + F.col("group")).cast("int").alias("task")
    graphs = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(task, F.lit(-1).alias("block"), *[x.split()[0] for x in INDEX.split(", ")])
    of_length = lambda i: F.create_map(*[F.lit(x) for n, span in spans.items() for x in (n, span[i])])[F.col("n")]
    sent = packed.select("block", F.expr(f"block % {groups}").alias("group"), "q", F.explode(F.sequence(of_length(0), of_length(1))).alias("shard")).select(task, "block", "q")
    rows_of_tasks = graphs.unionByName(sent, allowMissingColumns=True).repartitionById(shards * groups, "task").sortWithinPartitions("task", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, exact, graph = [], np.empty((0, 1)), None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                if row["block"].as_py() < 0:
                    members = row["members"].as_py()
                    exact = np.frombuffer(row["exact"].as_py(), "<f8").reshape(len(members), -1)
                    graph = load(row["vectors"].as_py(), row["levels"].as_py(), row["layer_nodes"].as_py(), row["neighbours"].as_py(), len(members))
                    continue
                if graph is None:  # a shard without vectors
                    continue
                q = row["q"].values
                keys, queries = q.field("query").to_pylist(), _matrix_of(q.field("vector"))
                longer = np.concatenate([queries / np.abs(queries).max(1, keepdims=True), np.zeros((len(queries), 1))], 1).astype(np.float32)
                found = [[], [], []]
                for j, near in enumerate(graph.search(longer)):
                    near = near[near >= 0]
                    score = exact[near] @ queries[j]
                    best = np.lexsort(([members[x][0] for x in near], -score))[: k + 1]
                    ids = [(s, m) for x, s in zip(near[best].tolist(), score[best].tolist()) for m in members[x]]
                    for s, m in sorted(ids, key=lambda t: (-t[0], t[1]))[: k + 1]:
                        found[0].append(keys[j])
                        found[1].append(s)
                        found[2].append(m)
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.int64())], names=["query", "score", "id"])

    results = rows_of_tasks.mapInArrow(run, "query long, score double, id long")
    # k + 1 of each shard are merged to k + 1 of all, limited before the shuffle too; one of them may be the query's own row
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    merged = results.withColumn("p", F.row_number().over(best)).where(F.col("p") <= k + 1)
    merged = merged.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("p", "id", "score"))).alias("best"))
    of = asked.select("id", F.xxhash64("vector").alias("query")).join(merged, "query")
    mine = of.select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k).alias("best"))
    return mine.select("query_id", F.posexplode("best").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
