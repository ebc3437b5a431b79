"""Phrases whose words belong together: Rabin-Karp fingerprints of n-grams, counted by a shuffle and verified by text.

Texts become one line of words with single blanks between them. Prefix polynomials over its bytes (modulo 2^64, whose odd
base has an inverse) give the fingerprint of any n-gram with two look-ups, so that longer phrases cost no more than short
ones. The shuffle adds up, for each fingerprint, its occurrences, a second fingerprint (20 bits, another base) of each of
them, and keeps the smallest doc_id as a pointer to an occurrence; a task does the same before.

Only phrases with least occurrences are wanted, and a phrase has no more of them than its parts. So words are counted
first, then pairs of frequent words, then phrases of three and four whose pairs are all frequent. What is frequent goes
to the tasks as a bitmap of fingerprints of a fixed size (filter_bits): a collision lets a rare phrase through to the next
count, and never loses one. A bitmap that fills up at very large inputs shuffles more and changes no result.

Only where a fingerprint's pointer points, the phrase is cut out of the text. It is verified by its text: the sum of the
second fingerprints has to be that of the text times the occurrences. Where it is not, different phrases share the
fingerprint, and all occurrences of those are compared byte by byte and counted by their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import binary_list, mix, written

LONGEST = 4
#: Blocks of text have about so many bytes; a task holds so many fingerprints before it sends their counts, so many at a time.
PIECE, HELD, SENT = 1 << 20, 1 << 19, 1 << 16
#: Rows of texts that are taken out of Arrow together.
ROWS = 2000
_BASE, _SECOND = 0x9E3779B97F4A7C15, 0xA0761D6478BD642F
#: The pointer of a null doc_id.
_NONE = -(1 << 63)
_BORDER, _BLANK = 2, 1
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = _BLANK
_KIND[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 10, 11, 12, 13]] = _BORDER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
_BORDERS = [bytes([b]) for b in range(256) if _KIND[b] == _BORDER]


class Powers:
    """The powers of a base and of its inverse, as far as they were needed."""

    def __init__(self, base: int = _BASE) -> None:
        self.bases = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in self.bases)
        return self.up[:n], self.down[:n]


class Block:
    """Some texts as one line of words: starts and ends of words in it, prefix polynomials, and where n-grams may stand."""

    def __init__(self, data: bytes, carried: int, seed: int, powers: Powers, second: Powers | None = None, key_bits: int = 64):
        raw = _LOWER[np.frombuffer(data + b"\n", np.uint8)]
        kind = _KIND[raw]
        word = kind == 0
        before = np.concatenate([np.zeros(1, bool), word[:-1]])
        begins, behind = np.flatnonzero(word & ~before), np.flatnonzero(before & ~word)
        self.line = np.where(word, raw, np.uint8(32))[word | (before & ~word)]
        self.raw_starts = begins
        self.ends = np.cumsum(behind - begins + 1) - 1
        self.starts = self.ends - (behind - begins)
        self.piece = np.cumsum(kind == _BORDER, dtype=np.int32)[begins]
        self.carried, self.seed = carried, np.uint64(seed)
        self.mask = np.uint64((1 << 64) - (1 << (64 - key_bits)))
        self.prefix, self.down = self._prefix(powers)
        self.other = self._prefix(second) if second else None

    def _prefix(self, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        up, down = powers.of(len(self.line) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.line * up[:-1], dtype=np.uint64)]), down

    def words(self) -> int:
        return len(self.starts) - self.carried

    def stands(self, n: int) -> np.ndarray:
        """Whether n words from each word on are of one piece, and not all of them were counted before."""
        count = max(0, len(self.starts) - n + 1)
        whole = self.piece[:count] == self.piece[n - 1 :] if count else np.zeros(0, bool)
        whole[: max(0, self.carried - n + 1)] = False
        return whole

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        """The fingerprints of the n words from each of the words at on."""
        begin = self.starts[at]
        return mix((self.prefix[self.ends[at + n - 1]] - self.prefix[begin]) * self.down[begin] + self.seed) & self.mask

    def checks(self, at: np.ndarray, n: int) -> np.ndarray:
        """Their second fingerprints, of 20 bits, so that sums of 10^12 of them are exact."""
        (prefix, down), begin = self.other, self.starts[at]
        return (mix((prefix[self.ends[at + n - 1]] - prefix[begin]) * down[begin]) >> np.uint64(44)).astype(np.int64)


def _tail(text: bytes, begin: int, end: int) -> tuple[int, int]:
    """(where they begin, how many) of the last words between begin and end, up to one less than the longest phrase, with no border behind them."""
    begin = max(begin, *(text.rfind(b, begin, end) + 1 for b in _BORDERS))
    at = end
    for words in range(LONGEST):
        stop = begin + len(text[begin:at].rstrip(b" \t"))
        if words == LONGEST - 1 or stop == begin:
            return at, words
        at = max(begin, text.rfind(b" ", begin, stop) + 1, text.rfind(b"\t", begin, stop) + 1)
    return at, words


def chunks(text: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(bytes, words carried over, place) of a text in parts of about PIECE bytes: n-grams across a cut are found once, in the later part."""
    begin = at = carried = 0
    while at < len(text):
        cut = _BREAK.search(text, at + PIECE) if len(text) - at > PIECE else None
        at = cut.end() if cut else len(text)
        yield text[begin:at], carried, begin
        begin, carried = _tail(text, begin, at)


def blocks(texts: list[bytes]) -> Iterator[tuple[bytes, int, list[tuple[int, int, int]]]]:
    """(bytes, words carried over, (place in the block, text, place in the text) of each part) of all texts."""
    held, parts, size, first = [], [], 0, 0
    for i, text in enumerate(texts):
        for data, carried, at in chunks(text):
            if held and (carried or size + len(data) > PIECE):
                yield b"\n".join(held), first, parts
                held, parts, size = [], [], 0
            first = first if held else carried
            parts.append((size, i, at))
            held.append(data)
            size += len(data) + 1
    if held:
        yield b"\n".join(held), first, parts


def _has(bits: np.ndarray, keys: np.ndarray, filter_bits: int) -> np.ndarray:
    place = keys >> np.uint64(64 - filter_bits)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def wanted(block: Block, step: int, filters: list[np.ndarray], filter_bits: int) -> list[tuple[np.ndarray, int]]:
    """(first words, words) of the n-grams that step counts: words, then pairs of frequent words, then three and four words with frequent pairs."""
    if step == 1:
        return [(np.flatnonzero(block.stands(1)), 1)]
    singles = np.arange(len(block.starts))
    if not len(singles):
        return []
    frequent = _has(filters[0], block.keys(singles, 1), filter_bits)
    if step == 2:
        return [(np.flatnonzero(block.stands(2) & frequent[:-1] & frequent[1:]), 2)]
    pair = np.zeros(len(singles), bool)
    at = np.flatnonzero((block.piece[:-1] == block.piece[1:]) & frequent[:-1] & frequent[1:])
    pair[at] = _has(filters[1], block.keys(at, 2), filter_bits)
    out = []
    for n in range(3, LONGEST + 1):
        ok = block.stands(n)
        for i in range(n - 1):
            ok &= pair[i : i + len(ok)]
        out.append((np.flatnonzero(ok), n))
    return out


def differs(line: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether length bytes of line from a on differ from those from b on, eight at a time."""
    padded = np.concatenate([line, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(line) + 1,), "<u8", padded, strides=(1,))
    out, left = np.zeros(len(a), bool), np.arange(len(a))
    a, b, length = a.copy(), b.copy(), length.copy()
    while len(left):
        n = np.minimum(length, 8)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - n).astype(np.uint64))
        out[left] |= (eight[a] & mask) != (eight[b] & mask)
        more = length > 8
        left, a, b, length = left[more], a[more] + 8, b[more] + 8, length[more] - 8
    return out


def phrases(block: Block, bits: np.ndarray, filter_bits: int) -> Iterator[tuple[int, int, bytes, int, int]]:
    """(words, fingerprint, phrase, occurrences, first word of the first one) of a block's phrases whose fingerprint is in the bitmap."""
    text = block.line.tobytes()
    for n in range(1, LONGEST + 1):
        at = np.flatnonzero(block.stands(n))
        keys = block.keys(at, n)
        known = _has(bits, keys, filter_bits)
        at, keys = at[known], keys[known]
        while len(at):  # those that equal the first one of their fingerprint; then what is left
            order = np.argsort(keys, kind="stable")
            at, keys = at[order], keys[order]
            new = np.concatenate([np.ones(1, bool), keys[1:] != keys[:-1]])
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            begin, length = block.starts[at], block.ends[at + n - 1] - block.starts[at]
            model = first[group]
            other = (length != length[model]) | differs(block.line, begin, begin[model], np.minimum(length, length[model]))
            for i, count in zip(first.tolist(), np.bincount(group[~other], minlength=len(first)).tolist()):
                yield n, int(keys[i].view(np.int64)), text[begin[i] : begin[i] + length[i]], count, int(at[i])
            at, keys = at[other], keys[other]


def _seed(lang: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(lang.encode())


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """(language, pointers, texts) of a batch (lang, text, pointer), in the order of pointers."""
    langs, texts, ids = batch.column(0).to_pylist(), binary_list(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
    rows: dict[str, list[int]] = {}
    for i in np.argsort(ids, kind="stable").tolist():
        rows.setdefault(langs[i], []).append(i)
    for lang, own in rows.items():
        yield lang, ids[own], [texts[i] for i in own]


def _text_blocks(batches: Iterator[pa.RecordBatch], key_bits: int) -> Iterator[tuple[str, Block, np.ndarray, np.ndarray]]:
    """(language, block, pointers of its words' documents, places of its words in those documents)"""
    powers, second = Powers(), Powers(_SECOND)
    for part in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
        for lang, ids, texts in _by_lang(part):
            for data, carried, parts in blocks(texts):
                block = Block(data, carried, _seed(lang), powers, second, key_bits)
                begins, owner, offset = (np.array(x, np.int64) for x in zip(*parts))
                own = np.searchsorted(begins, block.raw_starts, "right") - 1
                yield lang, block, ids[owner[own]], block.raw_starts - begins[own] + offset[own]


def _summed(columns: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(key, n, sum of checks, least pointer) of each key."""
    key, n, check, doc = (np.concatenate(c) for c in zip(*columns))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([np.ones(1, bool), key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(first):
        return key, n, check, doc
    return key[first], np.add.reduceat(n[order], first), np.add.reduceat(check[order], first), np.minimum.reduceat(doc[order], first)


def _sent(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows[0]), SENT):
        columns = [c[at : at + SENT] for c in (rows[0].view(np.int64), *rows[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "n", "check", "doc"])


def _counted(source: DataFrame, step: int, filters: list, least: int, filter_bits: int, key_bits: int) -> DataFrame:
    """(key, n, check, doc) of the fingerprints that step counts and that occur least times or more in a language: a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        found: list[tuple[np.ndarray, ...]] = []
        size = 0

        for _, block, docs, _ in _text_blocks(batches, key_bits):
            for at, n in wanted(block, step, known, filter_bits):
                found.append(_summed([(block.keys(at, n), np.ones(len(at), np.int64), block.checks(at, n), docs[at])]))
                size += len(found[-1][0])
            if size > HELD:
                found = [_summed(found)]
                size = len(found[0][0])
                if size > HELD // 2:
                    yield from _sent(found[0])
                    found, size = [], 0
        if size:
            yield from _sent(_summed(found))

    each = source.mapInArrow(run, "key long, n long, check long, doc long")
    return written(each.groupBy("key").agg(F.sum("n").alias("n"), F.sum("check").alias("check"), F.min("doc").alias("doc")).where(F.col("n") >= least), "fingerprints")


def _bitmap(keys: DataFrame, filter_bits: int) -> np.ndarray:
    """A bit for each key, by its first filter_bits bits: 2^filter_bits bits at most come to the driver."""
    place = F.shiftrightunsigned("key", 64 - filter_bits)
    rows = keys.select(place.alias("place")).groupBy(F.expr("place div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("bits"))
    out = np.zeros(max(4096, (1 << filter_bits) // 8), np.uint8)
    for r in rows.toLocalIterator():
        out[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _pair(key: Column, doc: Column) -> Column:
    return key.bitwiseXOR(F.shiftleft(doc.bitwiseXOR(F.shiftright(doc, 27)), 37))


def _pairs(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The same in a task: a key whose first bits depend on the document too."""
    return keys ^ ((docs ^ (docs >> 27)) << 37).view(np.uint64)


def _pointed(source: DataFrame, counted: DataFrame, filter_bits: int, key_bits: int) -> DataFrame:
    """(key, lang, words, phrase, one, doc, at): the phrases where the pointers of counted point, with their second fingerprint.

    The tasks get a bitmap of keys with their documents; what it lets through besides is for the caller to drop, and a
    phrase may come out several times. A row with words 0 has a block's number of words as one.
    """
    context = source.sparkSession.sparkContext
    every = context.broadcast(_bitmap(counted, filter_bits))
    pairs = context.broadcast(_bitmap(counted.select(_pair(F.col("key"), F.col("doc")).alias("key")), filter_bits))
    schema = "key long, lang string, words int, phrase string, one long, doc long, at long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block, docs, places in _text_blocks(batches, key_bits):
            text, found = block.line.tobytes(), []
            for n in range(1, LONGEST + 1):
                at = np.flatnonzero(block.stands(n))
                keys = block.keys(at, n)
                known = _has(every.value, keys, filter_bits)
                at, keys = at[known], keys[known]
                own = _has(pairs.value, _pairs(keys, docs[at]), filter_bits)
                at, keys = at[own], keys[own]
                order = np.argsort(keys, kind="stable")  # a key's occurrences stay in the order of documents and places
                at, keys = at[order], keys[order]
                new = np.concatenate([np.ones(1, bool), (keys[1:] != keys[:-1]) | (docs[at[1:]] != docs[at[:-1]])])[: len(at)]
                at, keys = at[new], keys[new]
                cut = [text[a:b] for a, b in zip(block.starts[at].tolist(), block.ends[at + n - 1].tolist())]
                found.append((keys.view(np.int64), np.full(len(at), n, np.int32), cut, block.checks(at, n), docs[at], places[at]))
            found.append((np.zeros(1, np.int64), np.zeros(1, np.int32), [b""], np.array([block.words()]), np.zeros(1, np.int64), np.zeros(1, np.int64)))
            key, words, cut, one, doc, place = zip(*found)
            cut = pa.array([c for part in cut for c in part], pa.binary()).cast(pa.string())
            columns = [pa.array(np.concatenate(key)), pa.array([lang] * len(cut), pa.string()), pa.array(np.concatenate(words)), cut, *(pa.array(np.concatenate(c)) for c in (one, doc, place))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "lang", "words", "phrase", "one", "doc", "at"])

    return source.mapInArrow(run, schema)


def _by_text(source: DataFrame, keys: DataFrame, filter_bits: int, key_bits: int) -> DataFrame:
    """(lang, words, phrase, f, doc, at) of all phrases whose fingerprint is one of keys, counted by their text."""
    shared = source.sparkSession.sparkContext.broadcast(_bitmap(keys, filter_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block, docs, places in _text_blocks(batches, key_bits):
            rows = [(key, lang, n, text.decode(), count, int(docs[at]), int(places[at])) for n, key, text, count, at in phrases(block, shared.value, filter_bits)]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["key", "lang", "words", "phrase", "f", "doc", "at"])

    found = source.mapInArrow(run, "key long, lang string, words int, phrase string, f long, doc long, at long").join(keys.select("key"), "key", "left_semi")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"), F.min(F.struct("doc", "at")).alias("first")).select("lang", "words", "phrase", "f", "first.doc", "first.at")


def counted_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id", least: int = 30, filter_bits: int = 27, key_bits: int = 64) -> DataFrame:
    """(lang, words, phrase, f, doc_id, at) of all phrases of 1 to 4 words that occur least times or more in a language.

    f counts all contiguous occurrences within pieces, overlaps included. doc_id and at point to the first one (the smallest
    id, nulls first, then byte in the text). One more row a language has words 0 and all its words as f. A null language
    is `und`, a null text is empty. Whole texts are read; repeated rows count each. The result is a written table.
    key_bits is less than 64 in tests only, where fingerprints have to collide.
    """
    context = docs.sparkSession.sparkContext
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(id_column).cast("long"), F.lit(_NONE)).alias("doc"))
    counted, filters = [], []
    for step in (1, 2, 3):
        counted.append(_counted(source, step, list(filters), least, filter_bits, key_bits))
        if step < 3:
            filters.append(context.broadcast(_bitmap(counted[-1], filter_bits)))
    frequent = counted[0].unionByName(counted[1]).unionByName(counted[2])
    pointed = written(_pointed(source, frequent, filter_bits, key_bits), "pointed")
    own = pointed.where("words > 0").groupBy("key", "lang", "words", "phrase", "one", "doc").agg(F.min("at").alias("at"))
    found = written(own.join(frequent, ["key", "doc"]), "phrases")
    shared = found.groupBy("key").agg(F.count("*").alias("_n"), F.bool_or(F.col("one") * F.col("n") != F.col("check")).alias("_differs")).where("_n > 1 or _differs").select("key")
    counted_once = lambda rows: rows.select("lang", "words", "phrase", F.col("n").alias("f"), "doc", "at")
    counts = counted_once(found)
    if not shared.isEmpty():
        shared = written(shared, "collisions")
        counts = counted_once(found.join(shared, "key", "left_anti")).unionByName(_by_text(source, shared, filter_bits, key_bits).where(F.col("f") >= least))
    totals = pointed.where("words = 0").groupBy("lang").agg(F.sum("one").alias("f")).select("lang", F.lit(0).alias("words"), F.lit("").alias("phrase"), "f", F.lit(_NONE).alias("doc"), F.lit(None).cast("long").alias("at"))
    return written(counts.unionByName(totals).select("lang", "words", "phrase", "f", F.when(F.col("doc") != _NONE, F.col("doc")).alias("doc_id"), "at"), "phrases")


def scored(counts: DataFrame) -> DataFrame:
    """counts of counted_phrases() -> its phrases of two words and more with a, l, r and score by the lowest-scoring cut, and n.

    A cut after k words gives l = f(first part), r = f(rest) and score floor(2000000 * a / (l + r)), in exact decimals; of
    equal scores the smallest k counts.
    """
    word = F.split("phrase", " ")
    part = lambda first, n: F.array_join(F.slice(word, first, n), " ")
    candidates = counts.where("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"), "doc_id", "at")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select("*", part(F.lit(1), F.col("k")).alias("_l"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("_r"))
    f = lambda name, as_: counts.where("words between 1 and 3").select("lang", F.col("phrase").alias(name), F.col("f").alias(as_))
    both = cuts.join(f("_l", "l"), ["lang", "_l"]).join(f("_r", "r"), ["lang", "_r"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000BD) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = both.groupBy("lang", "words", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("doc_id").alias("doc_id"), F.first("at").alias("at"))
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "words", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", "doc_id", "at")


def without_parts(found: DataFrame, percent: int = 80) -> DataFrame:
    """found of scored() without the phrases that stand inside a longer one (of found) with 100 * a(longer) >= percent * a."""
    word = F.split("phrase", " ")
    sizes = F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("n")
    inner = found.where("words > 2").select("lang", "words", "phrase", "a", sizes).select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1)).alias("i"))
    longer = inner.select("lang", F.array_join(F.slice(word, F.col("i"), F.col("n")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    big = lambda c: F.col(c).cast("decimal(20, 0)")
    joined = found.join(longer, ["lang", "phrase"], "left")
    return joined.where(F.col("_longer").isNull() | (big("_longer") * 100 < big("a") * percent)).drop("_longer")


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, filter_bits: int = 27, text: str = "text", lang: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """Each language's first top phrases by score and a from the largest, and phrase: (lang, rank, phrase, a, l, r, n, score, words, doc_id, at).

    Empty tables, texts without words and languages without phrases give no rows. See counted_phrases() for nulls.
    """
    kept = without_parts(scored(counted_phrases(docs, text, lang, id_column, least, filter_bits)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank).where(F.col("rank") <= top)  # limited before the shuffle
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "words", "doc_id", "at")


def collocations_sql(top: int = 2000, least: int = 30, percent: int = 80) -> str:
    """DuckDB SQL of the query's columns."""
    return rf"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
        w as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as w from p),
        g as (select lang, k, w[i:i + k - 1] as s from (select lang, w, unnest(generate_series(1, len(w))) as i from w), (values (1), (2), (3), (4)) t(k) where i + k - 1 <= len(w)),
        f as (select lang, k, array_to_string(s, ' ') as phrase, any_value(s) as s, count(*) as f from g group by lang, k, array_to_string(s, ' ') having count(*) >= {least}),
        n as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
        cuts as (select c.lang, c.k, c.phrase, c.s, c.f as a, j, l.f as l, r.f as r, (c.f::hugeint * 2000000) // (l.f::hugeint + r.f) as score from (select *, unnest(generate_series(1, k - 1)) as j from f where k >= 2) c
            join f l on l.lang = c.lang and l.phrase = array_to_string(c.s[1:j], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.s[j + 1:], ' ')),
        best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
        longer as (select lang, array_to_string(s[i:i + m - 1], ' ') as phrase, max(a) as most from (select *, unnest(generate_series(1, k - m + 1)) as i from (select *, unnest(generate_series(2, k - 1)) as m from best where k > 2)) group by 1, 2),
        kept as (select b.* from best b left join longer x on x.lang = b.lang and x.phrase = b.phrase where x.most is null or x.most::hugeint * 100 < a::hugeint * {percent})
        select k.lang, row_number() over (partition by k.lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, cast(score as bigint) as score from kept k join n on n.lang = k.lang
        qualify row_number() over (partition by k.lang order by score desc, a desc, encode(phrase)) <= {top}"""
