"""Benchmark decontamination, with DataFrame functions only.

A window is as many words of a document as a benchmark item has (the whole document where that is shorter). Windows,
like items, are multisets of hashed five-word shingles. Similarity is that of weighted sets: the sum of the smaller
counts over the sum of the larger ones.

1. A window without a shingle of any item has similarity 0, so windows are laid only where a shingle of an item
   stands: beginning there (or as far to the right as the document allows). Sliding any window right to its first
   shingle of the item loses none of them, so among these is a most similar one. A window with too few shingles of
   items of its length cannot be similar enough to any of them, and is not laid either.
2. Each window and item gets a SimHash: each bit is the majority of that bit over all shingles, counted in lanes.
3. Multi-index Hamming search: fingerprints are cut into blocks. Two within the radius agree, but for few bits, in at
   least one block (pigeonhole); the index holds each item's blocks with all those few bits turned, so that an equal
   join finds every pair within the radius. It holds fingerprints only.
4. Pairs within the radius are verified by the exact similarity.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, written

#: A shingle has this many words.
WORDS = 5
#: At similarity 0.8 fingerprints differ by 10 of 64 bits on average (standard deviation 3).
RADIUS, BLOCK_BITS = 20, 8
LANES, LANE_MASK = 16, 0x0001000100010001
#: Four counters of 16 bits share a signed long, so they count up to this.
LANE_MOST = 32_767


def _words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingled(rows: DataFrame, text: str) -> DataFrame:
    """Adds _s: the hash of each run of five words in order; of the whole sequence where there are fewer; none without words.

    explode() of a single value keeps the optimiser from writing it out in every place that uses it, which would hash
    all words again for each shingle.
    """
    hashed = rows.select("*", F.explode(F.array(F.transform(_words(F.col(text)), lambda w: F.xxhash64(w)))).alias("_h"))
    runs = F.transform(F.sequence(F.lit(1), F.size("_h") - (WORDS - 1)), lambda i: F.xxhash64(*[F.element_at(F.col("_h"), i + k) for k in range(WORDS)]))
    whole = F.when(F.size("_h") >= WORDS, runs).when(F.size("_h") > 0, F.array(F.xxhash64(F.col("_h")))).otherwise(F.array().cast("array<bigint>"))
    return hashed.select("*", F.explode(F.array(whole)).alias("_s")).drop("_h", text)


def _held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once: explode() of a single value, as above."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _with_print(rows: DataFrame, shingles: str, name: str) -> DataFrame:
    """Adds the SimHash: a bit is set if more than half of the shingles have it.

    Four counters of 16 bits share a sum; where there are too many shingles for that, each bit is counted by itself.
    """

    def summed(k: int, mask: int) -> Column:
        return F.aggregate(F.col(shingles), F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(mask)))

    lanes = F.array(*[summed(k, LANE_MASK) for k in range(LANES)])
    unpacked = F.flatten(F.transform(F.col("_lanes"), lambda x: F.array(*[F.shiftrightunsigned(x, 16 * lane).bitwiseAND(F.lit(0xFFFF)) for lane in range(4)])))
    single = F.array(*[summed(16 * lane + k, 1) for k in range(LANES) for lane in range(4)])
    few = F.size(shingles) <= LANE_MOST
    counted = _held(_held(rows, "_lanes", F.when(few, lanes)), "_counts", F.when(few, unpacked).otherwise(single))
    bits = None
    for k in range(LANES):
        for lane in range(4):
            bit = F.shiftleft((F.col("_counts")[4 * k + lane] * 2 > F.size(shingles)).cast("long"), 16 * lane + k)
            bits = bit if bits is None else bits.bitwiseOR(bit)
    return _held(counted, name, bits).drop("_lanes", "_counts")


def _block(fingerprint: Column, b: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _near(radius: int) -> list[int]:
    """The changes of a block that at least one block stays within, if at most radius bits differ in all."""
    most = radius // (64 // BLOCK_BITS)
    return [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(BLOCK_BITS), n)]


def _with_occurrences(rows: DataFrame, shingles: str, name: str) -> DataFrame:
    """Adds hashes of (shingle, how often it came before), so that multisets are compared as sets, in linear time."""
    ordered = _held(rows, "_o", F.sort_array(shingles))
    places = F.when(F.size("_o") > 0, F.filter(F.sequence(F.lit(0), F.size("_o") - 1), lambda i: F.coalesce(F.get(F.col("_o"), i) != F.get(F.col("_o"), i - 1), F.lit(True))))
    begun = _held(ordered, "_b", F.coalesce(places, F.array().cast("array<int>")))
    runs = F.transform("_b", lambda start, j: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(F.col("_b"), j + 1), F.size("_o")) - start), lambda n: F.xxhash64(F.get(F.col("_o"), start), n)))
    return _held(begun, name, F.flatten(runs)).drop("_o", "_b")


def _windows(source: DataFrame, items: DataFrame, similarity: float, broadcast_bytes: int) -> DataFrame:
    """source (key, doc_id, text) -> (key, doc_id, word_start, length, window) that may be similar to an item of that length.

    Places of items' shingles are gathered by document and length: narrow rows. Texts are only read again where windows
    lie. The smaller side is broadcast if its counted bytes allow it, else both are shuffled once.
    """
    marks = items.select(F.explode("item").alias("mark"), F.size("item").alias("length")).distinct()
    lengths = marks.groupBy("mark").agg(F.sort_array(F.collect_set("length")).alias("lengths"))
    found = _shingled(source.select("key", "text"), "text").select("key", F.size("_s").alias("n"), F.posexplode("_s").alias("place", "mark"))
    hits = found.join(_small(lengths, F.lit(64) + 8 * F.size("lengths"), broadcast_bytes), "mark").select("key", "n", "place", F.explode("lengths").alias("length"))
    placed = hits.groupBy("key", "length").agg(F.max("n").alias("n"), F.sort_array(F.collect_set("place")).alias("p"))
    size, last = F.least("n", "length"), F.greatest(F.lit(0), F.col("n") - F.col("length"))
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (size + F.col("length")) - 1e-6).cast("int")  # shingles in common
    starts = F.filter("p", lambda x, i: (x <= last) & (F.get(F.col("p"), i + least - 1) < x + size))
    ends_there = F.when(F.get(F.col("p"), F.size("p") - least) >= last, F.array(last)).otherwise(F.array().cast("array<int>"))
    laid = placed.select("key", "length", F.array_union(starts, ends_there).alias("starts")).where(F.size("starts") > 0)
    laid = written(laid.groupBy("key").agg(F.collect_list(F.struct("length", "starts")).alias("laid")), "windows")
    texts = source.join(_small(laid, F.aggregate("laid", F.lit(64), lambda acc, x: acc + 32 + 4 * F.size(x["starts"])), broadcast_bytes), "key")
    at = _shingled(texts, "text").select("key", "doc_id", "_s", F.explode("laid").alias("l")).select("key", "doc_id", "_s", "l.length", F.explode("l.starts").alias("word_start"))
    return at.where(F.col("word_start") < F.size("_s")).select("key", "doc_id", "word_start", "length", F.slice("_s", F.col("word_start") + 1, F.col("length")).alias("window"))


def _small(rows: DataFrame, width: Column, limit: int) -> DataFrame:
    """rows, to be broadcast if the sum of their widths in bytes is within the limit."""
    return F.broadcast(rows) if (rows.agg(F.sum(width)).first()[0] or 0) <= limit else rows


def _found(docs: DataFrame, benchmark: DataFrame, similarity: float, radius: int, id_column: str, text: str, item_id: str, item_text: str, broadcast_bytes: int) -> DataFrame:
    """(key, doc_id, item_id, similarity, word_start) of all windows that are similar enough; key is that of row_key."""
    items = _shingled(benchmark.select(benchmark[item_id].alias("item_id"), benchmark[item_text].cast("string").alias("_t")), "_t")
    items = items.select("item_id", F.col("_s").alias("item")).distinct().where(F.size("item") > 0)
    items = written(_with_occurrences(_with_print(items, "item", "item_print"), "item", "item_set").withColumn("item_key", F.xxhash64("item_id", "item")), "benchmark")

    source = docs.select(row_key(docs, id_column, text).alias("key"), docs[id_column].alias("doc_id"), docs[text].cast("string").alias("text"))
    prints = _with_print(_windows(source, items, similarity, broadcast_bytes), "window", "print")

    index = items.select("item_key", "item_print", F.size("item").alias("length"), F.explode(F.array(*[F.struct(F.lit(b).alias("b"), _block(F.col("item_print"), b).alias("v")) for b in range(64 // BLOCK_BITS)])).alias("k"))
    index = index.select("item_key", "item_print", "length", "k.b", "k.v", F.explode(F.array(*[F.lit(x) for x in _near(radius)])).alias("turned")).withColumn("v", F.col("v").bitwiseXOR(F.col("turned").cast("long"))).drop("turned")
    probes = prints.select("*", F.posexplode(F.array(*[_block(F.col("print"), b) for b in range(64 // BLOCK_BITS)])).alias("b", "v"))
    close = probes.join(_small(index, F.lit(64), broadcast_bytes), ["length", "b", "v"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    # a pair that meets in several blocks is verified in the first one
    first = F.least(*[F.when(F.bit_count(_block(F.col("print").bitwiseXOR(F.col("item_print")), b)) <= radius // (64 // BLOCK_BITS), F.lit(b)) for b in range(64 // BLOCK_BITS)])
    pairs = _with_occurrences(close.where(F.col("b") == first).select("key", "doc_id", "word_start", "window", "item_key"), "window", "window_set")
    sets = items.select("item_key", "item_id", "item_set")
    common = F.size(F.array_intersect("window_set", "item_set"))
    scored = pairs.join(_small(sets, F.lit(64) + 8 * F.size("item_set"), broadcast_bytes), "item_key").select("key", "doc_id", "item_id", "word_start", (common / (F.size("window_set") + F.size("item_set") - common)).alias("similarity"))
    return scored.where(F.col("similarity") >= similarity)


def row_key(docs: DataFrame, id_column: str, text: str) -> Column:
    """A hash of a row's id and text; equal rows have equal keys."""
    return F.xxhash64(docs[id_column], docs[text].cast("string"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = RADIUS, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, item_id, similarity, word_start) of each document and item with a window of at least that similarity.

    similarity is the largest of the document's windows, word_start the first word (from 0) of the earliest such window.
    Words are runs of letters and digits in lower case. A document or item with fewer than five words is one shingle.
    Null and empty texts match nothing; null ids are kept as null and grouped as one. Repeated items each count, rows
    with the same doc_id are one document. What is made of the benchmark is broadcast where its counted bytes are
    within broadcast_bytes; else it is joined by shuffles. Other columns are not read.
    """
    scored = _found(docs, benchmark, similarity, radius, id_column, text, item_id, item_text, broadcast_bytes)
    best = scored.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max(F.struct("similarity", (-F.col("word_start")).alias("at"))).alias("best"))
    return best.select("doc_id", "item_id", "similarity", (-F.col("best.at")).cast("long").alias("word_start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = RADIUS, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """docs without the contaminated rows; columns and names stay as they are.

    Each row is judged by its own text, also where its id is null or that of another row. See contaminated.
    """
    key = fresh("_gone", docs.columns)
    gone = written(_found(docs, benchmark, similarity, radius, id_column, text, item_id, item_text, broadcast_bytes).select(F.col("key").alias(key)).distinct(), "contaminated")
    return docs.join(_small(gone, F.lit(16), broadcast_bytes), row_key(docs, id_column, text) == gone[key], "left_anti")


def contaminated_sql(similarity: float = 0.8, documents: str = "documents", benchmark: str = "benchmark") -> str:
    """DuckDB SQL of contaminated(): all windows that begin at a shared shingle, compared without fingerprints."""
    shingled = lambda t, i: f"""
        select {i}, case when len(w) >= {WORDS} then list_transform(generate_series(1, len(w) - {WORDS - 1}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) else [array_to_string(w, ' ')] end as s
        from (select {i}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') as w from {t}) where len(w) > 0"""  # noqa: E731
    return f"""
    with d as materialized ({shingled(documents, "doc_id")}), b as materialized ({shingled(benchmark, "item_id")}),
    marks as materialized (select distinct item_id, len(s) as n, unnest(s) as mark from b),
    places as (select doc_id, len(s) as size, unnest(s) as mark, unnest(generate_series(0, len(s) - 1)) as place from d),
    laid as materialized (select distinct p.doc_id, m.item_id, greatest(0, least(p.place, p.size - m.n)) as word_start, m.n from places p join marks m using (mark)),
    inside as (select l.doc_id, l.item_id, l.word_start, d.s[l.word_start + 1:l.word_start + l.n] as win, b.s as item from laid l join d using (doc_id) join b using (item_id)),
    scored as (select doc_id, item_id, word_start, len(win) as nw, len(item) as ni,
        list_sum(list_transform(list_distinct(win), lambda x: least(len(list_filter(win, lambda y: y = x)), len(list_filter(item, lambda y: y = x))))) as common from inside)
    select doc_id, item_id, max(common / (nw + ni - common)) as similarity, cast(arg_max(word_start, (common / (nw + ni - common), -word_start)) as bigint) as word_start
    from scored where common / (nw + ni - common) >= {similarity} group by all"""
