"""Language-model scores: unigram counts over the whole corpus, and a hashed maximum-entropy model.

The model factors a token's probability: P(class | history) * P(token | class, history). Classes are the most frequent
tokens, each by itself, and groups of the others by a hash of how they end. P(class | history) is a softmax over
hashed features of the last three classes: n-grams (1; 1,2; 1,2,3) and skips (2; 3; 1,3; 2,3), and of the last two
words: n-grams (1; 1,2) and a skip (2), for words that are frequent (the next NEAR_WORDS after those that are classes by
themselves, which the features of classes tell apart already). P(token | class, history) is a softmax over all tokens of
the class, of the logarithm of the smoothed count and a weight for the pair of the last word and the token, where both are
among the WORDS most frequent ones. Only such pairs differ from the smoothed relative frequency, so that the sum over a class
is 1 and a correction for each of its frequent tokens, and is the same for all histories with one last word.

Work goes by chunks of documents, written once as numbers of the chunk's own vocabulary, each chunk read by itself:
1. Every chunk deals its distinct tokens, counted, by hash range; where a range meets they are summed up, and the
   sums go back to the chunks (so a token that is in every document costs one row a chunk).
2. Every task counts pairs of frequent words; the sums are dealt by last word, and gradient steps on them give the
   weights of pairs.
3. In each round every task starts from the same weights, runs gradient steps over its chunks (equal histories are
   one row with a count), and hands out how far each weight moved; these are averaged by how often each feature was
   met, and the next round starts there. The weights have a fixed size; nothing else reaches the driver.
4. Every chunk is scored by its distinct histories.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batched_groups, binary_list, mix, partitions, written

CHUNK_TOKENS, CHUNK_DOCS = 1_000_000, 20_000
STEP_TOKENS = 1_500_000  # training tokens (at least, if there are more) whose histories are counted together
WIDE = 0xFFFF  # numbers of tokens from here on do not fit into 16 bits
#: A chunk is a page and a row group, so that neither writing nor reading holds those of a whole file.
CHUNK_FILES = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(1 << 20)}
TOP, ENDINGS = 39, 24
CLASSES = TOP + ENDINGS
PAD = CLASSES  # the history before a text
FEATURES = 1 << 15
BLOCK = 256  # rows of weights that travel together
#: Words of the features within classes, those of the features of classes, and how many last words are fitted together.
WORDS, NEAR_WORDS, WORD_BLOCK = 1024, 256, 64
PAIR_STEPS, PAIR_VARIANCE = 30, 1.0
END = b" "  # the end of a text as a token: no word has a space
CHUNK_SCHEMA = "chunk long, doc_ids array<long>, sizes array<long>, trains array<boolean>, ids binary, wide binary, vocab binary, counts binary, endings binary"


class Numbers(dict):
    """token -> its number in the chunk."""

    def __missing__(self, token: bytes) -> int:
        number = self[token] = len(self)
        return number


def _packed(ids: np.ndarray) -> tuple[bytes, bytes]:
    """16 bits of each number, and the whole numbers of those that need more. Numbers go by first use, so few do."""
    return np.minimum(ids, WIDE).astype("<u2").tobytes(), ids[ids >= WIDE].astype("<u4").tobytes()


def _unpacked(ids, wide) -> np.ndarray:
    out = np.frombuffer(ids, "<u2").astype(np.uint32)
    out[out == WIDE] = np.frombuffer(wide, "<u4")
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 5]
    numbers, docs, sizes, trains, ids, held = Numbers(), [], [], [], [], 0

    def row() -> pa.RecordBatch:
        flat = np.concatenate(ids)
        weight = np.repeat(np.array(trains, bool), sizes)
        counts = np.bincount(flat[weight], minlength=len(numbers))
        vocab = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in numbers), np.uint64, len(numbers))
        endings = np.fromiter((xxhash.xxh3_64_intdigest(t.rstrip(b".,;:!?\"'")[-2:]) % ENDINGS for t in numbers), np.uint8, len(numbers))
        made = [chunk, docs[:], sizes[:], trains[:], *_packed(flat), vocab.tobytes(), counts.astype("<u4").tobytes(), endings.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(made, kinds)], names=names)

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            for doc, train, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), binary_list(part.column(2))):
                words = (text or b"").lower().split()
                words.append(END)
                ids.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)).astype(np.uint32))
                docs.append(doc)
                sizes.append(len(words))
                trains.append(train)
                held += len(words)
                if held >= CHUNK_TOKENS or len(docs) >= CHUNK_DOCS:
                    yield row()
                    numbers, docs, sizes, trains, ids, held = Numbers(), [], [], [], [], 0
                    chunk += 1
    if docs:
        yield row()


def _bucket(vocab: np.ndarray, buckets: int) -> np.ndarray:
    return ((vocab >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _deal(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            chunk, vocab, counts, endings = (batch.column(k)[i].as_py() for k in range(4))
            vocab, counts, endings = np.frombuffer(vocab, np.uint64), np.frombuffer(counts, "<u4"), np.frombuffer(endings, np.uint8)
            bucket = _bucket(vocab, buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            spans = [(b, a, e) for b, (a, e) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())) if e > a]
            packed = [(vocab[o := order[a:e]].tobytes(), counts[o].tobytes(), endings[o].tobytes()) for _, a, e in spans]
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in spans], pa.int32()), pa.array([chunk] * len(spans), pa.int64()), *(pa.array([p[k] for p in packed], pa.binary()) for k in range(3))], names=["bucket", "chunk", "vocab", "counts", "endings"])


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket: the summed counts for each of its chunks, and one row (no chunk) with totals and the top tokens."""
    for group in batched_groups(batches, "bucket"):
        bucket = group.column("bucket")[0].as_py()
        vocab, counts, endings = (group.column(c).to_pylist() for c in ("vocab", "counts", "endings"))
        size = [len(e) for e in endings]
        unique, first, which = np.unique(np.frombuffer(b"".join(vocab), np.uint64), return_index=True, return_inverse=True)
        total = np.bincount(which, np.frombuffer(b"".join(counts), "<u4"), minlength=len(unique)).astype(np.int64)
        ending = np.frombuffer(b"".join(endings), np.uint8)[first]
        back, ends = total[which], np.cumsum(size)
        top = np.lexsort((unique, -total))[:WORDS]
        top = top[total[top] > 0]
        summary = np.concatenate([np.bincount(ending, total, minlength=ENDINGS), np.bincount(ending[total > 0], minlength=ENDINGS)]).astype(np.int64)
        chunks = [*group.column("chunk").to_pylist(), None]
        data = [back[a:e].tobytes() for a, e in zip([0, *ends[:-1].tolist()], ends.tolist())]
        tops = [{"token": int(unique[i].view(np.int64)), "n": int(total[i]), "ending": int(ending[i])} for i in top]
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket] * len(chunks), pa.int32()), pa.array(chunks, pa.int64()), pa.array([*data, None], pa.binary()),
             pa.array([*[None] * len(data), tops], pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64()), ("ending", pa.int32())]))),
             pa.array([*[None] * len(data), summary], pa.list_(pa.int64()))],
            names=["bucket", "chunk", "data", "top", "totals"],
        )


@dataclass
class Classes:
    """The frequent words from the most frequent one, of which the first ones are classes, and the training tokens (n) and distinct ones (v) of each class."""

    words: np.ndarray
    n: np.ndarray
    v: np.ndarray

    def symbols(self, vocab: np.ndarray) -> np.ndarray:
        """The place of each token among the frequent words, from 1 on; 0 for others."""
        out = np.zeros(len(vocab), np.int32)
        if len(self.words):
            order = np.argsort(self.words)
            at = np.minimum(np.searchsorted(self.words[order], vocab), len(order) - 1)
            found = self.words[order][at] == vocab
            out[found] = order[at[found]] + 1
        return out

    def of(self, symbols: np.ndarray, endings: np.ndarray) -> np.ndarray:
        return np.where((symbols > 0) & (symbols <= TOP), symbols - 1, TOP + endings.astype(np.int32)).astype(np.int32)


@dataclass
class Pairs:
    """Of each last word (0: not frequent): the weight of each token after it, and the logarithm of each class's sum."""

    weights: np.ndarray
    sums: np.ndarray


def _place(sizes: np.ndarray) -> np.ndarray:
    """Of each token: how many of its text stand before it."""
    return np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)


def _past(values: np.ndarray, place: np.ndarray, back: int, none: int) -> np.ndarray:
    """What stands so many tokens before each one in its text."""
    out = np.full(len(values), none, values.dtype)
    out[back:] = np.where(place[back:] >= back, values[:-back], none)
    return out


def _histories(ids: np.ndarray, sizes: np.ndarray, classes: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(history, class, last word) of each token.

    A history is three classes of six bits, the latest lowest, above the last two words of ten bits, the latest lowest: a word
    is 0 where it is not frequent or a class by itself.
    """
    c, own, place = classes[ids], symbols[ids], _place(sizes)
    history = np.zeros(len(c), np.int64)
    for back in (1, 2, 3):
        history |= _past(c, place, back, PAD).astype(np.int64) << (20 + 6 * (back - 1))
    last = _past(own, place, 1, 0)
    near = np.where((own > TOP) & (own <= TOP + NEAR_WORDS), own - TOP, 0)
    history |= _past(near, place, 1, 0).astype(np.int64) | _past(near, place, 2, 0).astype(np.int64) << 10
    return history, c, last


def _features(history: np.ndarray) -> np.ndarray:
    """One row of weights for each n-gram and skip feature of each history."""
    a, b, c = history & 63, history >> 6 & 63, history >> 12 & 63
    keys = np.stack([a, a | b << 6, a | b << 6 | c << 12, b, c, a | c << 12, b | c << 6], 1)
    return (mix((keys * 8 + np.arange(7) + 1).astype(np.uint64)) % np.uint64(FEATURES)).astype(np.int64)


def _word_features(history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which histories, their rows of weights) of the features of words, as far as there are frequent words."""
    first, second = history & 1023, history >> 10 & 1023
    at = [np.flatnonzero(first), np.flatnonzero(second), np.flatnonzero((first > 0) & (second > 0))]
    keys = np.concatenate([first[at[0]], second[at[1]] << 10, (history & 0xFFFFF)[at[2]]])
    kind = np.repeat(np.arange(8, 11), [len(a) for a in at])
    return np.concatenate(at), (mix((keys * 16 + kind).astype(np.uint64) ^ np.uint64(1 << 40)) % np.uint64(FEATURES)).astype(np.int64)


def _log_softmax(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    z = _logits(weights, features)
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _logits(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    z = weights.take(features[:, 0], axis=0)
    for k in range(1, features.shape[1]):
        z += weights.take(features[:, k], axis=0)
    return z


def _with_words(weights: np.ndarray, z: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds the weights of features of words to z; returns which histories have which."""
    at, rows = _word_features(history)
    begins = np.concatenate([[0], np.flatnonzero(at[1:] <= at[:-1]) + 1, [len(at)]])  # a history is in each of the three lists once
    for a, b in zip(begins[:-1], begins[1:]):
        z[at[a:b]] += weights.take(rows[a:b], axis=0)
    return at, rows


def _cuts(keys: np.ndarray) -> np.ndarray:
    """Where another key begins in sorted keys, and their end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _spans(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places from starts to the next start of all which, how many each has)"""
    size = starts[which + 1] - starts[which]
    return np.repeat(starts[which] - np.cumsum(size) + size, size) + np.arange(size.sum()), size


def _sums_by(values: np.ndarray, owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums over each key of the rows owner of values). Most keys have few rows: these are added one of each key at a time."""
    order = np.argsort(key, kind="stable")
    cuts = _cuts(key[order])
    size = np.diff(cuts)
    by_size = np.argsort(-size, kind="stable")
    start, size, owner = cuts[:-1][by_size], size[by_size], owner[order]
    sums = values.take(owner[start], axis=0)
    for k in range(1, 8):
        n = np.searchsorted(-size, -k)
        sums[:n] += values.take(owner[start[:n] + k], axis=0)
    n = np.searchsorted(-size, -8)
    for i in range(n):
        sums[i] += np.ones(size[i] - 8, np.float32) @ values.take(owner[start[i] + 8 : start[i] + size[i]], axis=0)
    return key[order][start].astype(np.int64), sums


def _descend(weights: np.ndarray, squares: np.ndarray, met: np.ndarray, history: np.ndarray, c: np.ndarray, rng, rate: float, epochs: int, batch: int = 4096) -> None:
    """Gradient steps over a chunk's training tokens, with a step size for each weight (AdaGrad).

    Equal histories are one row; rows with the same classes share what the features of classes give.
    """
    pair = history << 6
    pair |= c
    pair, n = np.unique(pair, return_counts=True)
    starts = _cuts(pair >> 6)
    rows, kind, n = (pair >> 6)[starts[:-1]], (pair & 63).astype(np.int32), n.astype(np.float32)
    tokens = np.add.reduceat(n, starts[:-1])
    own = _cuts(rows >> 20)
    features = _features(rows[own[:-1]] >> 20)
    of_row = np.add.reduceat(tokens, own[:-1])
    for k in range(features.shape[1]):
        met += np.bincount(features[:, k], of_row, minlength=FEATURES)
    ones = np.ones(CLASSES, np.float32)
    at, word_rows = _word_features(rows)
    met += np.bincount(word_rows, tokens[at], minlength=FEATURES)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(own) - 1), -(-(len(own) - 1) // batch)):
            f = features[part]
            inner, size = _spans(own, part)
            parent = np.repeat(np.arange(len(part)), size)
            z = _logits(weights, f).take(parent, axis=0)
            words, word_rows = _with_words(weights, z, rows[inner])
            z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            total = tokens[inner]
            z *= (total / (z @ ones))[:, None]
            seen, seen_size = _spans(starts, inner)
            z[np.repeat(np.arange(len(inner)), seen_size), kind[seen]] -= n[seen]
            z /= total.sum()
            which, summed = _sums_by(z, np.arange(len(inner)), parent)
            gradient = np.empty_like(summed)
            gradient[which] = summed
            owner = np.concatenate([np.repeat(np.arange(len(part)), f.shape[1]), len(part) + words])
            unique, moved = _sums_by(np.concatenate([gradient, z]), owner, np.concatenate([f.ravel(), word_rows]).astype(np.uint16))
            step = squares.take(unique, axis=0)
            step += moved * moved
            squares[unique] = step
            step += 1e-10
            moved *= rate
            moved /= np.sqrt(step, out=step)
            weights[unique] -= moved


def _opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """(sizes, trains, ids, vocab, endings) of a chunk, as far as they can be the batch's own bytes."""
    sizes, trains = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("sizes", "trains"))
    ids, wide, vocab, endings = (batch.column(c)[i].as_buffer() for c in ("ids", "wide", "vocab", "endings"))
    return sizes, trains.astype(bool), _unpacked(ids, wide), np.frombuffer(vocab, np.uint64), np.frombuffer(endings, np.uint8)


def _pair_counts(batches: Iterator[pa.RecordBatch], classes: Classes) -> Iterator[pa.RecordBatch]:
    """How often each frequent word follows each, and each class does: of training tokens in classes of several."""
    side = len(classes.words) + 1
    pairs, sums = np.zeros(side * side, np.int64), np.zeros(side * CLASSES, np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, trains, ids, vocab, endings = _opened(batch, i)
            symbols = classes.symbols(vocab)
            last, c = _past(symbols[ids], _place(sizes), 1, 0), classes.of(symbols, endings)[ids]
            keep = np.flatnonzero(np.repeat(trains, sizes) & (last > 0) & (c >= TOP))
            last, c, token = last[keep], c[keep], symbols[ids[keep]]
            sums += np.bincount(last * CLASSES + c, minlength=len(sums))
            pairs += np.bincount((last * side + token)[token > 0], minlength=len(pairs))
    pairs, sums = pairs.reshape(side, side), sums.reshape(side, CLASSES)
    blocks = [b for b in range(-(-side // WORD_BLOCK)) if sums[b * WORD_BLOCK : (b + 1) * WORD_BLOCK].any()]
    at = [slice(b * WORD_BLOCK, (b + 1) * WORD_BLOCK) for b in blocks]
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([pairs[x].tobytes() for x in at], pa.binary()), pa.array([sums[x].tobytes() for x in at], pa.binary())], names=["block", "pairs", "sums"])


def _fit_pairs(batches: Iterator[pa.RecordBatch], share: np.ndarray, of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Weights of pairs, of each block of last words: gradient steps on the summed counts, scaled by the curvature, with a Gaussian prior.

    share is what each word has of its class by its count, of is its class; place 0 stands for all other tokens.
    """
    side = len(share)
    free = of >= TOP
    member = (of[:, None] == np.arange(CLASSES)) & free[:, None]
    for group in batched_groups(batches, "block"):
        block = group.column("block")[0].as_py()
        n, sums = (sum(np.frombuffer(x, np.int64) for x in group.column(c).to_pylist()).reshape(-1, w).astype(np.float64) for c, w in (("pairs", side), ("sums", CLASSES)))
        weights = np.zeros_like(n)
        for _ in range(PAIR_STEPS):
            p = share * np.exp(weights)
            p /= (1 + (p - share) @ member)[:, of]
            expected = sums[:, of] * p
            step = (n - expected - weights / PAIR_VARIANCE) / (expected * (1 - p) + 1 / PAIR_VARIANCE)
            weights += np.where(free, np.clip(step, -1, 1), 0)
        log_sums = np.log(1 + (share * np.exp(weights) - share) @ member)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([log_sums.astype(np.float32).tobytes()], pa.binary())], names=["block", "weights", "sums"])


def _learnt(batches: Iterator[pa.RecordBatch], classes: Classes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first chunk, history, class) of the training tokens of a few chunks at a time: the more tokens, the more histories are equal."""

    def one(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        sizes, trains, ids, vocab, endings = _opened(batch, i)
        symbols = classes.symbols(vocab)
        history, c, _ = _histories(ids, sizes, classes.of(symbols, endings), symbols)
        keep = np.repeat(trains, sizes)
        return history[keep], c[keep].astype(np.uint8)

    def together() -> tuple[int, np.ndarray, np.ndarray]:
        made = first, *(np.concatenate(x) for x in zip(*held))
        held.clear()
        return made

    held: list[tuple[np.ndarray, np.ndarray]] = []
    first = size = 0
    for batch in batches:
        for i in range(batch.num_rows):
            first = first if held else batch.column("chunk")[i].as_py()
            held.append(one(batch, i))
            size += len(held[-1][0])
            if size >= STEP_TOKENS:
                yield together()
                size = 0
    if size:
        yield together()


def _train(batches: Iterator[pa.RecordBatch], weights: np.ndarray, classes: Classes, rate: float, epochs: int) -> Iterator[pa.RecordBatch]:
    own, squares, met = weights.copy(), np.zeros_like(weights), np.zeros(FEATURES)
    any_rows = False
    for first, history, c in _learnt(batches, classes):
        any_rows = True
        _descend(own, squares, met, history, c, np.random.default_rng(first & 0x7FFFFFFF), rate, epochs)
        del history, c
    if any_rows:
        blocks = [b for b in range(FEATURES // BLOCK) if met[b * BLOCK : (b + 1) * BLOCK].any()]
        at = [slice(b * BLOCK, (b + 1) * BLOCK) for b in blocks]
        moved = (own - weights).astype(np.float16)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([moved[s].tobytes() for s in at], pa.binary()), pa.array([met[s].tobytes() for s in at], pa.binary())], names=["block", "moved", "met"])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean move of each weight, by how often its feature was met. Rows come by block, and are added up as they come."""
    block, moved, met = None, None, None

    def row() -> pa.RecordBatch:
        mean = (moved / np.maximum(met, 1)[:, None]).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mean.tobytes()], pa.binary())], names=["block", "mean"])

    for batch in batches:
        for b, m, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if b != block:
                if block is not None:
                    yield row()
                block, moved, met = b, np.zeros((BLOCK, CLASSES)), np.zeros(BLOCK)
            n = np.frombuffer(n, np.float64)
            moved += np.frombuffer(m, np.float16).reshape(BLOCK, CLASSES) * n[:, None]
            met += n
    if block is not None:
        yield row()


def _class_scores(weights: np.ndarray, history: np.ndarray, c: np.ndarray, block: int = 8192) -> np.ndarray:
    """log10 P(class | history) of each token: each different pair once, in blocks of histories."""
    pair, which = np.unique(history << 6 | c, return_inverse=True)
    starts = _cuts(pair >> 6)
    rows, found = (pair >> 6)[starts[:-1]], np.empty(len(pair), np.float32)
    for at in range(0, len(rows), block):
        some = rows[at : at + block]
        own = _cuts(some >> 20)
        z = _logits(weights, _features(some[own[:-1]] >> 20))[np.repeat(np.arange(len(own) - 1), np.diff(own))]
        _with_words(weights, z, some)
        z -= z.max(1, keepdims=True)
        places = slice(starts[at], starts[min(at + block, len(rows))])
        row = np.repeat(np.arange(len(some)), np.diff(starts[at : at + block + 1]))
        found[places] = z[row, pair[places] & 63] - np.log(np.exp(z).sum(1))[row]
    return (found / np.log(10))[which]


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray, classes: Classes, pairs: Pairs, n: int, v: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _chunk_scores(batch, i, weights, classes, pairs, n, v, buckets)


def _chunk_scores(batch: pa.RecordBatch, i: int, weights: np.ndarray, classes: Classes, pairs: Pairs, n: int, v: int, buckets: int) -> pa.RecordBatch:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    sizes, trains, ids, vocab, endings = _opened(batch, i)
    sums = batch.column("sums")[i].as_py()
    count = np.empty(len(vocab), np.int64)
    count[np.argsort(_bucket(vocab, buckets), kind="stable")] = np.frombuffer(b"".join(s["data"] for s in sorted(sums, key=lambda s: s["bucket"])), np.int64)
    del sums
    start = np.cumsum(sizes) - sizes
    add = lambda x: np.add.reduceat(x, start)
    known, base = add((count > 0).astype(np.int64)[ids]), add(np.log10((count + 0.1) / (n + 0.1 * (v + 1)))[ids])
    symbols = classes.symbols(vocab)
    own = classes.of(symbols, endings)
    score = add(np.where(own < TOP, 0.0, np.log10((count + 0.1) / (classes.n[own] + 0.1 * (classes.v[own] + 1))))[ids])
    history, c, last = _histories(ids, sizes, own, symbols)
    score += add(((pairs.weights[last, symbols[ids]] - pairs.sums[last, c]) / np.log(10)).astype(np.float64))
    score += add(_class_scores(weights, history, c).astype(np.float64))
    made = [batch.column("doc_ids")[i].values.cast(pa.int64()), pa.array(~trains), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(sizes), n), pa.int64()), pa.array(base), pa.array(score)]
    return pa.RecordBatch.from_arrays(made, names=names)


def lm_scores(docs: DataFrame, train: Column, id_column: str = "doc_id", text: str = "text", rounds: int = 2, epochs: int = 2, rate: float = 0.15) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row's whole text.

    train says which rows the counts and the model learn from; null counts as no. Tokens are runs of other than ASCII
    white space with A-Z in lower case, and one end for each text; a null or empty text is its end alone. base_score is
    the smoothed unigram log10 probability, score the model's; a token that training never met has a share of its
    class. Every row is scored, repeated ones too; if nothing is trained on, all scores are of the empty model. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    source = docs.select(docs[id_column].cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), docs[text].cast("string").alias("text"))
    chunks = written(source.mapInArrow(_chunks, CHUNK_SCHEMA), "lm-chunks", **CHUNK_FILES)
    dealt = chunks.select("chunk", "vocab", "counts", "endings").mapInArrow(lambda b: _deal(b, parts), "bucket int, chunk long, vocab binary, counts binary, endings binary")
    sums = written(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_sum_up, "bucket int, chunk long, data binary, top array<struct<token: long, n: long, ending: int>>, totals array<long>"), "lm-counts")

    summaries = sums.where("chunk is null")
    top = summaries.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("n"), "token").limit(WORDS).collect()
    totals = [0] * (2 * ENDINGS)
    for r in summaries.select(F.posexplode("totals").alias("place", "n")).groupBy("place").agg(F.sum("n").alias("n")).collect():
        totals[r["place"]] = r["n"]
    by_n, by_v = np.array(totals[:ENDINGS], np.float64), np.array(totals[ENDINGS:], np.float64)
    n, v = int(by_n.sum()), int(by_v.sum())
    for t in top[:TOP]:
        by_n[t["ending"]] -= t["n"]
        by_v[t["ending"]] -= 1
    empty = np.zeros(TOP)
    classes = Classes(np.array([t["token"] for t in top], np.int64).view(np.uint64), np.concatenate([empty, by_n]), np.concatenate([empty, by_v]))
    columns = ["chunk", "sizes", "trains", "ids", "wide", "vocab", "endings"]

    side = len(top) + 1
    of = np.concatenate([[0], classes.of(np.arange(1, side), np.array([t["ending"] for t in top], np.uint8))])
    share = np.concatenate([[0.0], np.array([t["n"] + 0.1 for t in top])]) / (classes.n[of] + 0.1 * (classes.v[of] + 1))
    share[of < TOP] = 0
    shared = spark.sparkContext.broadcast(classes)
    counted = chunks.select(*columns).mapInArrow(lambda b: _pair_counts(b, shared.value), "block int, pairs binary, sums binary")
    blocks = min(parts, -(-side // WORD_BLOCK))
    fitted = counted.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(lambda b: _fit_pairs(b, share, of), "block int, weights binary, sums binary")
    pairs = Pairs(np.zeros((side, side), np.float32), np.zeros((side, CLASSES), np.float32))
    for r in fitted.collect():
        at = slice(r["block"] * WORD_BLOCK, (r["block"] + 1) * WORD_BLOCK)
        pairs.weights[at] = np.frombuffer(bytes(r["weights"]), np.float32).reshape(-1, side)
        pairs.sums[at] = np.frombuffer(bytes(r["sums"]), np.float32).reshape(-1, CLASSES)

    weights = np.zeros((FEATURES, CLASSES), np.float32)
    for step in range(rounds):
        now = spark.sparkContext.broadcast((weights, classes))
        moves = chunks.select(*columns).mapInArrow(lambda b, now=now, step=step: _train(b, *now.value, rate / (step + 1), epochs), "block int, moved binary, met binary")
        means = moves.repartition(min(parts, FEATURES // BLOCK), "block").sortWithinPartitions("block").mapInArrow(_average, "block int, mean binary")
        weights = weights.copy()
        for r in means.collect():
            weights[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(bytes(r["mean"]), np.float32).reshape(BLOCK, CLASSES)

    final = spark.sparkContext.broadcast((weights, classes, pairs))
    own = sums.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "data")).alias("sums"))
    joined = chunks.repartition(parts, "chunk").join(own, "chunk").select("doc_ids", *columns[1:], "sums")  # a row has several MB: parts are not put together
    return joined.mapInArrow(lambda b: _score(b, *final.value, n, v, parts), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
