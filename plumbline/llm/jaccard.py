"""Near duplicates by Jaccard similarity of word shingles: exact, over all documents, as linked components.

1. Two sets of n and m shingles that are similar enough differ in at most (n + m) (1 - t) / (1 + t) of them. Shingles are
   dealt to more parts than that by their hash, so some parts of similar sets must be equal (pigeonhole); a set's keys
   are the hashes of so many of its parts, and of the whole set for exact copies. How many parts there are depends on a
   band of sizes only, and similar sets are in the same band or in neighbouring ones.
2. Each chunk of documents deals its keys by hash range. Where a range meets, the documents of a key that several have
   form a group, named after its smallest id. Copies are linked there, and only one of them goes on.
3. Size-banded tiles of a group's documents (two blocks of neighbouring bands; a small group is one tile) compare
   hashed bitmaps: the bits that one has and the other has not bound the overlap from above. What passes is decided by
   intersecting the sorted arrays.
4. The components of the found links are the classes.

No step emits the pairs of a group: keys are dealt as one row per document, a tile returns a spanning forest of its
links. A key that very many documents of a chunk have goes on as one of them, and the others follow by a join that
Spark can split. Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import batched_groups, binary_list, connected_components, fresh, mix, partitions, shingle_sets, written

CHUNK_SHINGLES, CHUNK_DOCS = 1_000_000, 20_000
TILE_DOCS, TILE_SHINGLES = 1024, 2_000_000
#: A key that more documents of a chunk have is hot there.
HOT = 16
#: Bytes of text whose keys meet in one task.
PART_BYTES = 32 << 20
DOCUMENT, COPY, NEAR, HOT_KEY = range(4)
_G = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def least_overlap(n, percent: int):
    """The fewest common shingles that a set of n can have with a similar one."""
    return (percent * n + 99) // 100


def _band(n: np.ndarray, percent: int) -> np.ndarray:
    """Similar sets are in the same band or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64)


def _most_different(n, m, percent: int):
    """The most shingles that only one of two similar sets of n and m has."""
    return (n + m) * (100 - percent) // (100 + percent)


@cache
def _levels(percent: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each level (a band with the one below it): the largest size, and the number of parts, some more than may differ."""
    top = np.floor((100 / percent) ** np.arange(1, bands + 1) + 1).astype(np.int64)
    for _ in range(3):
        top -= _band(top, percent) > np.arange(bands)
    top = np.maximum(top, 1)
    return top, _most_different(top, top, percent) + 2 + top // 30


def _keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places of their sets). Two similar and different sets have a key in common.

    At most m parts of a set differ from those of any partner of the level. It takes its first m + 1 parts that are not
    empty: up to the last of these one is equal in the partner, who takes it too unless that one ended earlier, and then
    the same holds the other way round. A set with fewer such parts takes them all, and the shingles one of which two
    of that kind must share (prefix filter by hash).
    """
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    mixed = mix(flat * _G[1] + np.uint64(1))
    band = _band(n, percent)
    top, parts = _levels(percent, int(band.max(initial=0)) + 2)
    found, owner = [], []
    for up in (0, 1):
        level = band + up
        most = np.where(n > 0, _most_different(n, np.minimum(top[level], 100 * n // percent), percent), 0)
        of = np.flatnonzero(most > 0)  # else only equal sets are similar
        if not len(of):
            continue
        inside = np.repeat(most > 0, n)
        k = parts[level[of]]
        first = np.cumsum(k) - k
        place = np.repeat(first, n[of]) + ((flat[inside] >> np.uint64(20)) % np.repeat(k, n[of]).astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(k.sum()), np.uint64)
        np.add.at(total, place, mixed[inside])
        full = np.bincount(place, minlength=len(total)) > 0
        rank = np.cumsum(full)
        rank -= np.repeat(np.concatenate([[0], rank[first[1:] - 1]]), k)
        taken = np.flatnonzero(full & (rank <= np.repeat(most[of] + 1, k)))
        who = np.repeat(np.arange(len(of)), k)
        tag = mix((taken - first[who[taken]]).astype(np.uint64) * _G[0] + level[of][who[taken]].astype(np.uint64) * np.uint64(2))
        found.append(mix(total[taken] + tag))
        owner.append(of[who[taken]])
        for i in np.flatnonzero(np.bincount(who[full], minlength=len(of)) <= most[of]).tolist():
            some = sets[of[i]][: int(n[of[i]] - least_overlap(n[of[i]], percent) + 1)]
            found.append(mix(some * _G[2] + np.uint64(2 * int(level[of[i]]) + 1)))
            owner.append(np.full(len(some), of[i]))
    return (np.concatenate(found) if found else np.empty(0, np.uint64)) & ~np.uint64(1), np.concatenate(owner) if owner else np.empty(0, np.int64)


def _deal(batches: Iterator[pa.RecordBatch], k: int, percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk: one row with what is known of its documents, and for each bucket rows with keys and their documents."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId()
    ids: list[int | None] = []
    sets: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        nonlocal chunk
        none = np.array([i is None for i in ids], bool)
        doc = np.array([0 if i is None else i for i in ids], np.int64)
        n = np.array([len(s) for s in sets], np.int64)
        whole = mix(np.array([int(np.bitwise_xor.reduce(s)) if len(s) else 0 for s in sets], np.uint64) + n.astype(np.uint64)) | np.uint64(1)  # odd: a key of copies
        order = np.lexsort((doc, none, n, whole))
        new = np.concatenate([[True], (whole[order][1:] != whole[order][:-1]) | (n[order][1:] != n[order][:-1])])
        owner_of = np.empty(len(n), np.int64)
        owner_of[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # of equal sets that with the smallest id deals for all
        own = np.flatnonzero((owner_of == np.arange(len(n))) & (n > 0) & ~none)
        copy = np.flatnonzero((n > 0) & ~none & (doc != doc[owner_of]))
        keys, owner = _keys([sets[i] for i in own], percent)
        kinds, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        hot = count[which] > HOT
        least = np.full(len(kinds), np.iinfo(np.int64).max)
        dealer = doc[own][owner]
        np.minimum.at(least, which[hot], dealer[hot])
        follows = hot & (dealer != least[which])
        kept = ~follows
        once = np.unique(keys[hot & kept])
        parts = [(False, np.concatenate([keys[kept & ~hot], whole[own]]), np.concatenate([dealer[kept & ~hot], doc[own]])), (True, once, least[np.searchsorted(kinds, once)])]
        rows: list[tuple] = [(chunk % buckets, None, np.concatenate([doc, n, whole.view(np.int64), none.astype(np.int64)]).tobytes(), np.concatenate([doc[copy], doc[owner_of[copy]], whole[copy].view(np.int64), dealer[follows], keys[follows].view(np.int64)]).tobytes(), len(copy))]
        for is_hot, key, who in parts:
            bucket = (key >> np.uint64(20)) % np.uint64(buckets)
            by = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))
            key, who = key[by], who[by]
            for b in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
                at = slice(int(ends[b - 1]) if b else 0, int(ends[b]))
                rows.append((b, is_hot, key[at].tobytes(), who[at].tobytes(), 0))
        ids.clear()
        sets.clear()
        chunk += 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int64()))], names=["bucket", "hot", "data", "docs", "copies"])

    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found = shingle_sets([(t or b"").lower() for t in binary_list(part.column(1))], k)
            for doc, one in zip(part.column(0).to_pylist(), found):
                ids.append(doc)
                sets.append(one)
                held += len(one)
                if held >= CHUNK_SHINGLES or len(ids) >= CHUNK_DOCS:
                    yield flush()
                    held = 0
    if ids:
        yield flush()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's keys: which documents are copies of which, and which share a key with others.

    Rows are (kind, a, b, c): a document, its set's size and its set's hash; a copy, what it is a copy of, and the hash; a
    document and the smallest one of a group; a document (b is 0) and a hot key.
    """

    def made(kind: int, a, b, c, none=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a, mask=none), pa.array(b), pa.array(c)], names=["kind", "a", "b", "c"])

    keys, docs, hot = [], [], []
    for batch in batches:
        for is_hot, data, who, copies in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            if is_hot is None:
                doc, n, whole, none = np.frombuffer(data, np.int64).reshape(4, -1)
                yield made(DOCUMENT, doc, n, whole, none == 1)
                rest = np.frombuffer(who, np.int64)
                if copies:
                    yield made(COPY, *rest[: 3 * copies].reshape(3, -1))
                doc, key = rest[3 * copies :].reshape(2, -1)
                if len(doc):
                    yield made(HOT_KEY, doc, np.zeros(len(doc), np.int64), key)
            else:
                keys.append(np.frombuffer(data, np.uint64))
                docs.append(np.frombuffer(who, np.int64))
                hot.append(np.full(len(docs[-1]), is_hot))
    if not keys:
        return
    key, doc, is_hot = np.concatenate(keys), np.concatenate(docs), np.concatenate(hot)
    keys.clear()
    docs.clear()
    order = np.argsort(key, kind="stable")
    key, doc, is_hot = key[order], doc[order], is_hot[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    least = np.repeat(np.minimum.reduceat(doc, start), size)
    several = np.repeat(size > 1, size)
    hot_run = np.repeat(np.logical_or.reduceat(is_hot, start), size)
    copies = (key & np.uint64(1)) == 1
    at = np.flatnonzero(copies & (doc != least))
    yield made(COPY, doc[at], least[at], key[at].view(np.int64))
    at = np.flatnonzero(~copies & hot_run)
    yield made(HOT_KEY, doc[at], np.zeros(len(at), np.int64), key[at].view(np.int64))
    at = np.flatnonzero(~copies & ~hot_run & several & (doc != least))
    at = at[np.lexsort((least[at], doc[at]))]
    a, b = doc[at], least[at]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(at)]
    yield made(NEAR, a[new], b[new], np.zeros(int(new.sum()), np.int64))


def _verify(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The links of each tile, as a spanning forest."""
    for group in batched_groups(batches, "tile"):
        ids = group.column("doc_id").to_numpy()
        side = group.column("side").to_numpy()
        sets = shingle_sets([(t or b"").lower() for t in binary_list(group.column("text").combine_chunks())], k)
        n = np.array([len(s) for s in sets])
        order = np.argsort(n, kind="stable")
        ids, side, sets, n = ids[order], side[order], [sets[i] for i in order], n[order]
        bits = 1 << int(np.clip(np.ceil(np.log2(2 * n.max() + 1)), 8, 14))
        maps = np.zeros((len(n), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            b = np.unique(s >> np.uint64(20)) & np.uint64(bits - 1)
            np.bitwise_or.at(maps[i], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        root = np.arange(len(n))
        links: list[tuple[int, int]] = []
        last = np.searchsorted(n, n * 100 // percent, "right")
        for i in range(len(n)):
            j = np.arange(i + 1, last[i])
            j = j[(root[j] != root[i]) & ((side[j] != side[i]) | (side[i] == 0))]
            if n[i] == 0 or not len(j):
                continue
            bound = np.minimum(n[i] - np.bitwise_count(maps[i] & ~maps[j]).sum(1, dtype=np.int64), n[j] - np.bitwise_count(maps[j] & ~maps[i]).sum(1, dtype=np.int64))
            for m in j[100 * bound >= percent * (n[i] + n[j] - bound)].tolist():
                if root[m] == root[i]:
                    continue
                common = len(np.intersect1d(sets[i], sets[m], assume_unique=True))
                if 100 * common >= percent * (n[i] + n[m] - common):
                    root[root == root[m]] = root[i]
                    links.append((int(ids[i]), int(ids[m])))
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """(tile, side, doc_id) of what has to be compared: members has the group, doc_id, n.

    A group within the bounds is one tile (side 0: all with all). Else each size band is cut into blocks by a hash;
    a tile is a block with itself (0) or two blocks of the same band or of neighbours (sides 1 and 2).
    """
    whole = members.groupBy("group").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).where("docs > 1")
    small = (F.col("docs") <= TILE_DOCS) & (F.col("shingles") <= TILE_SHINGLES)
    placed = members.join(whole, "group").withColumn("band", F.floor(F.ln(F.greatest("n", F.lit(1))) / float(np.log(100 / percent)) + 1e-9))
    one = placed.where(small).select(F.xxhash64("group").alias("tile"), F.lit(0).alias("side"), "doc_id")
    big = placed.where(~small)
    cut = big.groupBy("group", "band").agg(F.ceil(F.greatest(F.count("*") / TILE_DOCS, F.sum("n") / TILE_SHINGLES)).alias("blocks"))
    near = cut
    for up, name in ((1, "above"), (-1, "below")):
        near = near.join(cut.select("group", (F.col("band") - up).alias("band"), F.col("blocks").alias(name)), ["group", "band"], "left")
    own = big.join(near, ["group", "band"]).withColumn("block", F.expr("pmod(xxhash64(doc_id), blocks)"))
    tile = lambda *cols: F.xxhash64("group", *cols)
    up, down = F.col("band") + 1, F.col("band") - 1
    same = own.select("*", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other")).select(
        tile("band", F.least("block", "other"), "band", F.greatest("block", "other")).alias("tile"),
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"), "doc_id")
    above = own.where("above is not null").select("*", F.explode(F.expr("sequence(0L, above - 1)")).alias("other")).select(tile("band", "block", up, "other").alias("tile"), F.lit(1).alias("side"), "doc_id")
    below = own.where("below is not null").select("*", F.explode(F.expr("sequence(0L, below - 1)")).alias("other")).select(tile(down, "other", "band", "block").alias("tile"), F.lit(2).alias("side"), "doc_id")
    return one.unionByName(same).unionByName(above).unionByName(below).distinct()


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs.

    Words are runs of other than ASCII white space, with A-Z in lower case; a document's set has its distinct shingles
    of k words, or its whole sequence where it has fewer. Two documents link when 100 * common >= percent * union;
    component_id is the smallest id that is reachable, itself included. Null and empty texts (n_shingles 0) link with
    nothing. Rows with equal ids are one node of the graph, and each row is returned. A null id is returned with a
    null component. Ids are integers. Other columns are not read; an empty table gives an empty result.
    """
    source = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-size // PART_BYTES))
    dealt = source.mapInArrow(lambda b: _deal(b, k, percent, buckets), "bucket int, hot boolean, data binary, docs binary, copies long")
    rows = written(dealt.repartitionById(buckets, "bucket").mapInArrow(_meet, "kind byte, a long, b long, c long"), "shingle-keys")
    described = rows.where(f"kind = {DOCUMENT}").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("content"))
    copies = rows.where(f"kind = {COPY}").select("a", "b", "c")

    hot = rows.where(f"kind = {HOT_KEY}").select("a", "c")
    hot = hot.join(hot.groupBy("c").agg(F.min("a").alias("b")), "c").select("a", "b").where("a <> b")
    star = rows.where(f"kind = {NEAR}").select("a", "b").unionByName(hot).distinct().select("b", F.col("a").alias("doc_id"))
    star = star.unionByName(star.select("b", F.col("b").alias("doc_id")).distinct())
    singles = described.where("n > 0 and doc_id is not null").distinct().join(copies.select(F.col("a").alias("doc_id"), F.col("c").alias("content")), ["doc_id", "content"], "left_anti")
    members = star.join(singles, "doc_id").select(F.col("b").alias("group"), "doc_id", "n")
    tiles = written(_tiles(written(members, "members"), percent), "tiles")
    verified = tiles.hint("merge").join(source, "doc_id").repartition(buckets, "tile").sortWithinPartitions("tile").mapInArrow(lambda b: _verify(b, k, percent), "a long, b long")
    found = connected_components(verified.unionByName(copies.select("a", "b")), "links")
    joined = described.join(found, described["doc_id"] == found["node"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: that with the smallest id, of equal ids that with the smallest text hash.

    A row is judged by its own text, also where its id is null or another row has it too: rows are told apart by a hash
    of id and text. Rows without an id are kept only where no row with one is in their component. Of rows with
    equal id and text one stays; rows with neither an id nor a word all stay. Columns and names stay as they are.
    """
    names = docs.columns
    key, place, stays = fresh("_key", names), fresh("_place", names), fresh("_stays", names)
    own_id, own_text = docs[id_column].cast("long"), docs[text].cast("string")
    keyed = docs.withColumn(key, F.xxhash64(own_id, own_text))
    classes = jaccard_components(keyed.select(F.col(key).alias("doc_id"), own_text.alias("text")), k, percent).select("doc_id", "component_id").distinct()
    ids = keyed.select(F.col(key).alias("doc_id"), own_id.alias("id")).distinct()
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "doc_id")
    first = classes.join(ids, "doc_id").groupBy("component_id").agg(F.min(rank)["doc_id"].alias(stays))
    kept = keyed.join(first.select(stays), F.col(key) == F.col(stays), "left_semi")
    same = Window.partitionBy(key).orderBy(key)  # as the join leaves the rows: texts are neither dealt nor sorted again
    once = kept.withColumn(place, F.row_number().over(same))
    wordless = own_id.isNull() & ~F.coalesce(own_text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return once.where((F.col(place) == 1) | wordless).select(*[F.col(f"`{c}`") for c in names])
