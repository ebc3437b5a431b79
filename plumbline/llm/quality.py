"""Document quality: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Words are runs of letters, of digits or of other marks, as they are written. A word falls into a bucket by its hash, and a
bucket has an index vector: a few places with a plus or a minus, fixed by a seed. Random indexing adds to a bucket's
context vector the index vectors of its neighbours, over the whole corpus: each task sums what it reads, and the sums,
whose size is fixed (buckets times dimensions), are added up by parts of the table. A word's vector is its context
vector, of unit length and without what all words have in common, plus its own index vector.

A document is pooled into the mean vector of its words, that of its different words, the lengths of both and two counts.
The network (one hidden layer) is fitted in numpy on a bounded sample of labelled documents (sample_rows), of which the
driver gets the pooled numbers only; other labelled documents (calibration_rows) set the temperature. Both classes give
equally many rows where they can, and are weighed as they stand in the labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.collocations import Powers
from plumbline.llm.common import binary_list, fresh, mix

#: Buckets of words, dimensions, places of an index vector that are not 0, and neighbours on each side.
BUCKETS, DIM, PLACES, WINDOW = 1 << 14, 32, 4, 2
#: Buckets in a part of the table of context vectors, and the groups of tasks whose sums are added up first.
PART, GROUPS = 256, 32
#: Texts are read in blocks of about so many bytes, and pooled so many at a time.
PIECE, TEXTS = 1 << 20, 500
HIDDEN = 32
FEATURES = 2 * DIM + 4
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def index_vectors(seed: int = 11) -> np.ndarray:
    """Each bucket's index vector: PLACES of DIM numbers are 1 or -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), np.float32)
    out[np.arange(BUCKETS)[:, None], np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :PLACES]] = rng.choice([-1.0, 1.0], (BUCKETS, PLACES))
    return out


def buckets_of(data: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts) of the words of some bytes. 16 bits, as those are sorted by radix."""
    raw = np.frombuffer(data + b"\n", np.uint8)
    kind = _KIND[raw]
    new = np.concatenate([np.ones(1, bool), kind[1:] != kind[:-1]])
    edges = np.flatnonzero(new)
    word = kind[edges[:-1]] > 0  # the last edge is the line break's or before it
    starts, ends = edges[:-1][word], edges[1:][word]
    up, down = powers.of(len(raw) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * up[:-1], dtype=np.uint64)])
    return (mix((prefix[ends] - prefix[starts]) * down[starts]) % np.uint64(BUCKETS)).astype(np.uint16), starts


def word_blocks(texts: list[bytes], powers: Powers) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets, texts, words carried over) of all words, block by block. A long text carries its last words over to its next block."""
    held, owners, size = [], [], 0

    def joined() -> tuple[np.ndarray, np.ndarray, int]:
        found, starts = buckets_of(b"\n".join(held), powers)
        borders = np.cumsum([len(t) + 1 for t in held])
        return found, np.array(owners, np.int64)[np.searchsorted(borders, starts, "right")], 0

    for i, text in enumerate(texts):
        if len(text) > PIECE:
            begin = at = carried = 0
            while at < len(text):
                cut = _SPACE.search(text, at + PIECE) if len(text) - at > PIECE else None
                at = cut.end() if cut else len(text)
                found, starts = buckets_of(text[begin:at], powers)
                yield found, np.full(len(found), i, np.int64), carried
                carried = min(WINDOW, len(found))
                begin += int(starts[-carried]) if carried else at - begin
            continue
        if held and size + len(text) > PIECE:
            yield joined()
            held, owners, size = [], [], 0
        held.append(text)
        owners.append(i)
        size += len(text) + 1
    if held:
        yield joined()


def contexts(found: np.ndarray, owners: np.ndarray, carried: int, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, what a block adds to their context vectors): sums of neighbours. Pairs of words that were both carried over were added before."""
    own = index[found]
    near = np.zeros_like(own)
    for apart in range(1, WINDOW + 1):
        near[apart:] += own[:-apart]
        near[:-apart] += own[apart:]
        other = owners[apart:] != owners[:-apart]
        other[: max(0, carried - apart)] = True
        at = np.flatnonzero(other)
        near[at + apart] -= own[at]
        near[at] -= own[at + apart]
    order = np.argsort(found, kind="stable")
    first = np.flatnonzero(np.diff(found[order].astype(np.int32), prepend=-1))
    return found[order][first], np.add.reduceat(near[order], first, axis=0)


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The context vectors of all texts, buckets x dimensions, as the driver's array of fixed size (4 MB)."""
    parts = BUCKETS // PART
    schema = "part int, sums binary"

    def rows(sums: np.ndarray) -> pa.RecordBatch:
        table = sums.reshape(parts, -1)
        some = np.flatnonzero(table.any(1))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([table[i].tobytes() for i in some], pa.binary())], names=["part", "sums"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, index, sums = Powers(), index_vectors(), np.zeros((BUCKETS, DIM), np.int64)
        for batch in batches:
            for found, owners, carried in word_blocks([t or b"" for t in binary_list(batch.column(0))], powers):
                if len(found) > WINDOW:
                    which, more = contexts(found, owners, carried, index)
                    sums[which] += more.astype(np.int64)
        yield rows(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, PART * DIM), np.int64)
        for batch in batches:
            for part, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] += np.frombuffer(own, np.int64)
        yield rows(sums)

    each = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(read, schema)
    some = each.repartition("part", F.spark_partition_id() % GROUPS).mapInArrow(add, schema)
    whole = some.repartition(F.col("part")).mapInArrow(add, schema)
    out = np.zeros((parts, PART * DIM))
    for r in whole.collect():
        out[r["part"]] += np.frombuffer(r["sums"], np.int64)
    return out.reshape(BUCKETS, DIM)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context vectors of unit length without their mean, plus the index vectors."""
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    met = length[:, 0] > 0
    unit = sums / np.maximum(length, 1e-12)
    if met.any():
        unit[met] -= unit[met].mean(0)
    return (unit + index_vectors() / math.sqrt(PLACES)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray, powers: Powers) -> np.ndarray:
    """A row of FEATURES numbers for each text: all 0 without words."""
    keys, times, again = [np.empty(0, np.int64)], [np.empty(0, np.int64)], False
    for found, owners, carried in word_blocks(texts, powers):
        found, owners = found[carried:], owners[carried:]
        order = np.argsort(found, kind="stable")
        order = order[np.argsort(owners[order].astype(np.uint16), kind="stable")]
        key = owners[order] * BUCKETS + found[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        keys.append(key[first])
        times.append(np.diff(np.append(first, len(key))))
        again |= carried > 0
    key, n = np.concatenate(keys), np.concatenate(times)
    if again:  # words of a long text were met in several blocks
        key, which = np.unique(key, return_inverse=True)
        n = np.bincount(which, n, len(key))
    owner, own = key // BUCKETS, vectors[key % BUCKETS]
    out = np.zeros((len(texts), FEATURES))
    if not len(key):
        return out
    first = np.flatnonzero(np.concatenate([np.ones(1, bool), owner[1:] != owner[:-1]]))
    who = owner[first]
    words, types = np.add.reduceat(n, first), np.diff(np.append(first, len(owner)))
    mean = np.add.reduceat(own * n[:, None].astype(np.float32), first, axis=0, dtype=np.float64) / words[:, None]
    each = np.add.reduceat(own, first, axis=0, dtype=np.float64) / types[:, None]
    extra = np.column_stack([np.linalg.norm(mean, axis=1), np.linalg.norm(each, axis=1), np.log(words), np.log(words / types)])
    out[who] = np.hstack([mean, each, extra])
    return out


@dataclass
class QualityModel:
    """Word vectors, the standardised network, and its temperature; prior is the share of label 1."""

    vectors: np.ndarray
    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((features - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; the prior where there is no word or no network."""
        out = np.full(len(features), self.prior)
        some = features.any(1)
        if self.layers and some.any():
            out[some] = 1 / (1 + np.exp(-np.clip(self.logits(features[some]) / self.temperature, -500, 500)))
        return out


def fit(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 80, rate: float = 0.003, decay: float = 1e-4, seed: int = 5) -> QualityModel:
    """Fit the network to pooled rows x, labels y and the rows' weights (mean 1) by Adam. Rows of one class only: no network."""
    model = QualityModel(vectors, float((y * weight).sum() / weight.sum()) if len(y) else 0.5)
    if len(np.unique(y)) < 2:
        return model
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-6
    z = (x - model.centre) / model.scale
    rng = np.random.default_rng(seed)
    layers = [rng.standard_normal((x.shape[1], HIDDEN)) / math.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / math.sqrt(HIDDEN), np.zeros(())]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    steps = max(1, len(y) // 64)
    for step in range(steps * epochs):
        if step % steps == 0:
            order = np.array_split(rng.permutation(len(y)), steps)
        part = order[step % steps]
        hidden = np.tanh(z[part] @ layers[0] + layers[1])
        error = (1 / (1 + np.exp(-(hidden @ layers[2] + layers[3]))) - y[part]) * weight[part] / len(part)
        back = np.outer(error, layers[2]) * (1 - hidden**2)
        grads = [z[part].T @ back + decay * layers[0], back.sum(0), hidden.T @ error + decay * layers[2], error.sum()]
        eta = rate * (1 - step / (steps * epochs))
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            layers[i] = layers[i] - eta * (first[i] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[i] / (1 - 0.999 ** (step + 1))) + 1e-8)
    model.layers = tuple(layers)
    return model


def calibrate(model: QualityModel, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """Set the temperature that makes rows which did not train likeliest."""
    if not model.layers or not len(y):
        return
    z, grid = model.logits(x), np.geomspace(0.25, 20, 90)
    losses = [(weight * np.logaddexp(0, np.where(y == 1, -z, z) / t)).sum() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])


def sampled(labels: DataFrame, label: str, id_column: str, rows: int, calibration: int) -> DataFrame:
    """labels -> (id, label, trains, weight): at most rows + calibration ids, those with the smallest hash of each class.

    Both classes give equally many, or what they have. A null id or label, a label that is not 0 or 1, and an id with both
    labels are left out; an id with one label many times counts once.
    """
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_column).alias("id")).agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("_most"))
    known = known.where("label = _most").select("id", "label", F.xxhash64("id").alias("place"))
    have = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = rows + calibration
    quota = {x: min(n, max(total // 2, total - sum(m for y, m in have.items() if y != x))) for x, n in have.items()}
    numbers = lambda d: F.create_map(*[F.lit(v) for kv in d.items() for v in kv])[F.col("label")] if d else F.lit(0)
    # only so many of a class as hold its quota with near certainty are ordered
    share = {x: min(1_000_000, math.ceil(1e6 * (1.2 * quota[x] + 100) / n)) for x, n in have.items()}
    thin = known.where(F.pmod(F.shiftrightunsigned("place", 8), F.lit(1_000_000)) < numbers(share))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("place", "id"))
    trains = F.col("rank") <= numbers({x: -(-quota[x] * rows // total) for x in have})
    weight = numbers({x: n / quota[x] for x, n in have.items()}).cast("double")
    return thin.withColumn("rank", rank).where(F.col("rank") <= numbers(quota)).select("id", "label", trains.alias("trains"), weight.alias("weight"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_column: str = "doc_id", sample_rows: int = 6000, calibration_rows: int = 3000) -> QualityModel:
    """Word vectors from the texts of all docs; the network from a bounded sample of the labelled ones.

    Of rows with one id the one with the smallest pooled numbers counts. Without labels every score is 0.5, and with
    labels of one class it is that class.
    """
    spark = docs.sparkSession
    vectors = word_vectors(context_vectors(docs, text))
    shared = spark.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                numbers = pooled([t or b"" for t in binary_list(part.column(1))], shared.value, powers)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(numbers), pa.list_(pa.float64())), *part.columns[2:]], names=["id", "pooled", "label", "trains", "weight"])

    ids = sampled(labels, label, id_column, sample_rows, calibration_rows)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(ids), "id").select("id", "text", "label", "trains", "weight")  # at most sample_rows + calibration_rows ids
    schema = chosen.schema
    found = chosen.mapInArrow(run, f"id {schema['id'].dataType.simpleString()}, pooled array<double>, label int, trains boolean, weight double")
    rows = found.groupBy("id").agg(F.min(F.struct("pooled", "label", "trains", "weight")).alias("r")).orderBy("id").collect()
    x, y, w = np.array([r["r"]["pooled"] for r in rows]).reshape(len(rows), FEATURES), np.array([r["r"]["label"] for r in rows], float), np.array([r["r"]["weight"] for r in rows])
    own = np.array([r["r"]["trains"] for r in rows], bool)
    w = w / w.mean() if len(w) else w
    model = fit(vectors, x[own], y[own], w[own])
    calibrate(model, x[~own], y[~own], w[~own])
    return model


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None, least: float = 0.7) -> DataFrame:
    """The columns keep (all by default) of each row with score, the probability of label 1, and predicted, 1 from least on.

    Whole texts count. A null or empty text, or one of white space, has the share of label 1 among the labels. Columns of
    these names are replaced; a row comes out for each row in.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    helper = fresh("_text", names)
    source = docs.select(*[docs[c] for c in names], docs[text].cast("string").alias(helper))
    schema = source.drop(helper).schema.add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, own = Powers(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                scores = own.scores(pooled([t or b"" for t in binary_list(part.column(part.num_columns - 1))], own.vectors, powers))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores), pa.array((scores >= least).astype(np.int32))], names=schema.names)

    return source.mapInArrow(run, schema)


def held_out(id_column: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder fold. A null id does not."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(False))
