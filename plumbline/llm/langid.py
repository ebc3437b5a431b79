"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

A word's features are hashes of its bytes' n-grams, with markers at its ends. A text is the average of all its
features' embeddings; a linear layer and a softmax follow. Training (stochastic gradient descent in numpy) sees a
bounded sample of labelled rows, shared out over the labels; other rows of the sample calibrate: a temperature that makes
the scores probabilities, and the limits of rejection. A text is rejected where its score, or the share of its n-grams that
training met, is well below what all but a few of the calibrating rows reach. Met n-grams are marked apart from the
buckets of the embeddings, of which unrelated n-grams share many.

A text of a language that was not learned reads like some other one, but weakly: its largest logit, before the softmax,
is small. How small is seen by rotation: labels are left out of training in turn (at most ROTATIONS), and the texts of
each are measured by the model that never saw it. A text is rejected, too, where its logit is below what nearly all
of those reach, unless more than a few of the calibrating rows are there; short texts, whose mean is uncertain, are
given the benefit of the doubt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import binary_list, fresh, mix, written

NGRAMS = (2, 3, 4)
#: The limits of rejection, as parts of the lowest score and share of known n-grams among calibrating rows (but for a few).
SCORE_MARGIN, SHARE_MARGIN = 0.75, 0.7
BUCKETS = 1 << 16
#: Labels that are left out in turn, what part of their texts is to be rejected, and how many standard errors of its mean logit a text is given.
ROTATIONS, REJECTED, DOUBT = 4, 0.9, 6.0
#: Texts whose words are held at once.
TEXTS = 500


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the n-grams of all words one after the other, how many each word has)."""
    flat = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    place = np.arange(len(flat)) - np.repeat(begins, size)
    left = np.repeat(size, size) - place
    found, owner = [], []
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = h * np.uint64(257) + flat[at + i] + np.uint64(1)
        found.append(mix(h))
        owner.append(at)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    word_of = np.repeat(np.arange(len(words)), size)[owner[order]]
    return np.concatenate(found)[order], np.bincount(word_of, minlength=len(words))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes % np.uint64(buckets)).astype(np.int64)


def _mark(hashes: np.ndarray, size: int) -> np.ndarray:
    """The place of an n-gram among the marks of what was met, by other bits than its bucket's; size is a power of two."""
    return ((hashes >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)


def words_of(text: bytes) -> list[bytes]:
    """Runs of non-space bytes in lower case (also beyond ASCII), without the common marks around them."""
    return [w for w in (x.strip(b".,;:!?\"'()[]|#*%-+=_<>/0123456789") for x in text.decode("utf-8", "replace").lower().encode().split()) if w]


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


@dataclass
class LanguageModel:
    """What a worker needs: per bucket the logits of its embedding, the bias, and the calibration."""

    labels: list[str]
    table: np.ndarray  # buckets x labels: embeddings times the linear layer
    known: np.ndarray  # marks of the n-grams that training met
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    familiar: float = 0.0  # the least share of features that training met
    weak: float = -math.inf  # the least strength

    def strength(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The largest mean logit, and what a text of so many features is given besides."""
        return (sums / np.maximum(counts, 1)[:, None] + self.bias).max(1) + DOUBT / np.sqrt(counts + 1)

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _sparse(texts: list[bytes], buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(for each text its buckets and their shares, the distinct n-grams of all)."""
    out, met = [], [np.empty(0, np.uint64)]
    for text in texts:
        grams, times = np.unique(subwords(words)[0] if (words := words_of(text)) else met[0][:0], return_counts=True)
        ids, which = np.unique(_bucket(grams, buckets), return_inverse=True)
        out.append((ids, (np.bincount(which, times, len(ids)) / max(1, times.sum())).astype(np.float32)))
        met.append(grams)
        if len(met) > 200:
            met = [np.unique(np.concatenate(met))]
    return out, np.unique(np.concatenate(met))


def fit(texts: list[bytes], labels: list[str], buckets: int = BUCKETS, **how) -> LanguageModel:
    """Train on texts. Until it is calibrated, the temperature is 1 and nothing is rejected but what has no letter."""
    rows, met = _sparse(texts, buckets)
    return _learned(rows, labels, met, buckets, **how)


def _learned(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], met: np.ndarray, buckets: int = BUCKETS, dim: int = 16, epochs: int = 4, rate: float = 20.0, seed: int = 7) -> LanguageModel:
    """The model of rows of _sparse(), whose n-grams are met."""
    names = sorted(set(labels))
    index = {x: i for i, x in enumerate(names)}
    y = np.array([index[x] for x in labels], np.int64)
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((buckets, dim)) * 0.1).astype(np.float32)
    lin = (rng.standard_normal((dim, len(names))) * 0.1).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    steps = max(1, -(-len(rows) // 32))
    epochs = max(epochs, -(-240 // steps))  # a small sample is seen more often
    for epoch in range(epochs):
        for step, part in enumerate(np.array_split(rng.permutation(len(rows)), steps)):
            ids = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            owner = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            mean = np.stack([np.bincount(owner, value * emb[ids, d], minlength=len(part)) for d in range(dim)], 1)
            z = mean @ lin + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            eta = rate * (1 - (epoch * steps + step) / (epochs * steps))
            unique, which = np.unique(ids, return_inverse=True)
            pull = np.stack([np.bincount(which, value * p[owner, c], minlength=len(unique)) for c in range(len(names))], 1)
            emb[unique] -= (eta * pull @ lin.T / len(part)).astype(np.float32)
            lin -= (eta * 0.1 * mean.T @ p / len(part)).astype(np.float32)
            bias -= (eta * 0.02 * p.mean(0)).astype(np.float32)
    # an n-gram that training did not meet says nothing; at most a thirty-second of the marks is set, up to 2^21 n-grams
    table = emb @ lin
    unseen = np.ones(buckets, bool)
    for ids, _ in rows:
        unseen[ids] = False
    table[unseen] = 0
    known = np.zeros(1 << int(np.clip(np.ceil(np.log2(32 * max(1, len(met)))), 16, 26)), bool)
    known[_mark(met, len(known))] = True
    return LanguageModel(names, table.astype(np.float32), known, bias)


def calibrate(model: LanguageModel, labels: list[str], measured: np.ndarray, false_rejections: float = 0.0005) -> None:
    """Set temperature and limits by what measure() found of rows that did not train; rows of unknown labels are passed over."""
    index = {x: i for i, x in enumerate(model.labels)}
    usable = [i for i, x in enumerate(labels) if x in index and measured[i, -1] > 0]
    if not usable:
        return
    sums, met, counts = measured[usable, :-2], measured[usable, -2], measured[usable, -1]
    truth = np.array([index[labels[i]] for i in usable])
    losses, grid = [], np.geomspace(0.1, 10, 60)
    for t in grid:
        model.temperature = float(t)
        p = model.probabilities(sums, counts)
        losses.append(-np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean())
    model.temperature = float(grid[int(np.argmin(losses))])
    # below what all but a few reach, as other texts of known languages may be shorter or more mixed than these
    model.weak = min(model.weak, float(np.quantile(model.strength(sums, counts), false_rejections * 0.4)))
    model.threshold = float(np.quantile(model.probabilities(sums, counts).max(1), false_rejections) * SCORE_MARGIN)
    model.familiar = float(np.quantile(met / counts, false_rejections) * SHARE_MARGIN)


def measure(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """rows (text, label) -> (label, measured): the sums of the logits, how many n-grams are known, how many there are."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordLogits(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                sums, counts, met = known.texts(binary_list(part.column(0)))
                numbers = np.column_stack([sums, met, counts])
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(numbers), pa.list_(pa.float64()))], names=["label", "measured"])

    return rows.select("text", "label").mapInArrow(run, "label string, measured array<double>")


class WordLogits(dict):
    """word -> row of a growing matrix: the sum of its features' logits, how many are known, how many there are; bounded."""

    LIMIT = 100_000

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.matrix = np.zeros((1 << 16, len(model.labels) + 2), np.float32)

    def learn(self, words: list[bytes]) -> None:
        if len(self) + len(words) > self.LIMIT:
            self.clear()
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            grams, size = subwords(part)
            start, base = np.cumsum(size) - size, len(self)
            while base + len(part) > len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[base : base + len(part), :-2] = np.add.reduceat(self.model.table[_bucket(grams, len(self.model.table))], start, axis=0)
            self.matrix[base : base + len(part), -2] = np.add.reduceat(self.model.known[_mark(grams, len(self.model.known))].astype(np.float32), start)
            self.matrix[base : base + len(part), -1] = size
            self.update(zip(part, range(base, base + len(part))))

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the sum of all features' logits, their number, and how many of them are known."""
        runs = [words_of(t) for t in texts]
        new = set().union(*runs)
        if len(self) + len(new) > self.LIMIT:
            self.clear()
        self.learn(list(new.difference(self)))
        out = np.zeros((len(texts), self.matrix.shape[1]))
        for i, words in enumerate(runs):
            if words:
                out[i] = self.matrix[np.fromiter(map(self.__getitem__, words), np.int64, len(words))].sum(0, dtype=np.float64)
        return out[:, :-2], out[:, -1], out[:, -2]


def _quotas(rows: dict[str, int], total: int) -> dict[str, int]:
    """How many of each label's rows are taken: equally many, but what rare labels do not have goes to the others."""
    out, left = {}, total
    for done, (label, n) in enumerate(sorted(rows.items(), key=lambda x: (x[1], x[0]))):
        out[label] = min(n, max(1, left // (len(rows) - done)))
        left -= out[label]
    return out


def train(labelled: DataFrame, text: str = "text", label: str = "lang", id_column: str = "doc_id", sample_rows: int = 2000, calibration_rows: int = 6000) -> LanguageModel | None:
    """Fit on a sample of at most sample_rows + calibration_rows labelled rows (one of each label at least); the driver gets the texts of sample_rows.

    Rows with a null label or text are left out; whole texts are taken. Each label gives its rows with the smallest hash of
    their id and text, equally many where it has them. Of a label's rows the first train, and those beyond its part of
    sample_rows, or a tenth if it has no more, calibrate. Labels are few (languages). None if nothing is labelled.
    """
    usable = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(id_column).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    rows = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    if not rows:
        return None
    quota, training = _quotas(rows, sample_rows + calibration_rows), _quotas(rows, sample_rows)
    trains = {x: min(training[x], quota[x] - quota[x] // 10) for x in rows}
    # only so many of a label's rows as hold its quota with near certainty are ordered
    share = {x: min(1_000_000, math.ceil(1e6 * (1.2 * quota[x] + 100) / n)) for x, n in rows.items()}
    of_label = lambda numbers: F.create_map(*[F.lit(v) for kv in numbers.items() for v in kv])[F.col("label")]
    thin = usable.withColumn("place", F.expr("pmod(xxhash64(id, text), 1000000)")).where(F.col("place") < of_label(share))
    ranked = thin.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("place", "id")))
    sample = written(ranked.where(F.col("rank") <= of_label(quota)).select("text", "label", "rank"), "language-sample")
    own = sample.where(F.col("rank") <= of_label(trains)).orderBy("label", "rank").select("text", "label").toArrow()
    labels_of = own.column(1).to_pylist()
    sparse, met = _sparse(binary_list(own.column(0).combine_chunks()), BUCKETS)
    del own
    model = _learned(sparse, labels_of, met)
    # the texts that calibrate stay with the executors
    rest = sample.where(F.col("rank") > of_label(trains))
    others = measure(rest, model).collect()
    if others:
        model.weak = _strength_of_unlearned(sparse, labels_of, rest)
        calibrate(model, [r["label"] for r in others], np.array([r["measured"] for r in others]))
    return model


def _strength_of_unlearned(sparse: list, labels: list[str], rest: DataFrame) -> float:
    """What nearly all texts of a label that was left out stay below, the most of all labels that are left out; without three labels nothing is known."""
    names = sorted(set(labels))
    if len(names) < 3:
        return -math.inf
    found = []
    for left in names[:: -(-len(names) // ROTATIONS)]:
        some = [i for i, x in enumerate(labels) if x != left]
        model = _learned([sparse[i] for i in some], [labels[i] for i in some], np.empty(0, np.uint64))
        rows = np.array([r["measured"] for r in measure(rest.where(F.col("label") == left), model).collect()])
        rows = rows[rows[:, -1] > 0] if len(rows) else rows
        if len(rows) >= 20:
            found.append(float(np.quantile(model.strength(rows[:, :-2], rows[:, -1]), REJECTED)))
    return max(found, default=-math.inf)


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred, score (0 to 1, calibrated) and rejected to the columns keep (all by default) of each row.

    A null text, or one without a letter, is `und` with score 0, and rejected; so is everything if there is no model.
    Else lang_pred is a learned label, and rejected says that its score, the share of its subwords that training met, or
    its largest logit is below the calibrated limit. Columns of these
    names are replaced. Whole texts count. A row comes out for each row in.
    """
    made = ("lang_pred", "score", "rejected")
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    helper = fresh("_text", names)
    source = docs.select(*[docs[c] for c in names], docs[text].cast("string").alias(helper))
    schema = source.drop(helper).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = WordLogits(own) if own else None
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                texts = [t or b"" for t in binary_list(part.column(part.num_columns - 1))]
                readable = np.array([own is not None and has_letter(t) for t in texts], bool)
                lang, score, share, strength = ["und"] * len(texts), *(np.zeros(len(texts)) for _ in range(3))
                if readable.any():
                    sums, counts, met = known.texts(texts)
                    p, share, strength = own.probabilities(sums, counts), met / np.maximum(counts, 1), own.strength(sums, counts)
                    best = p.argmax(1)
                    lang = [own.labels[b] if r else "und" for b, r in zip(best.tolist(), readable.tolist())]
                    score = np.where(readable, p.max(1), 0.0)
                rejected = ~readable | (score < (own.threshold if own else 1.0)) | (share < (own.familiar if own else 1.0)) | (strength < (own.weak if own else 1.0))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=schema.names)

    return source.mapInArrow(run, schema)


def held_out(id_column: Column, folds: int) -> Column:
    """Whether crc32 of the id as text leaves no remainder by folds. A null id counts as not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(False))
