"""Token ids in shards that are compressed by a grammar of repeated pairs (Re-Pair), with random access.

A shard holds the ids of consecutive documents. In each round all pairs of neighbouring symbols are counted;
of pairs that overlap, the more frequent one wins; each pair that is then used often enough becomes a
nonterminal, everywhere at once. Rounds go on until no pair is worth a rule. Kept are the rules, the expanded
length of every rule, what is left of the sequence, and where each document ends.

The file format is a Parquet table with one row a shard:
part, shard       place in the order of documents; part numbers ascend with doc_id
offset            ids before the shard within its part
n_ids             ids in the shard
doc_ids, ends     the documents, and the end of each in ids from the shard's start
base              symbols below it are ids, others are rules
generations       how many rules each round made (a rule only names symbols of earlier rounds)
rules, lengths    little-endian uint32: two symbols a rule; the ids that each expands to
sequence          little-endian uint32 symbols
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import byte_symbols
from plumbline.llm.common import binary_list, partitions, run_keys, written

SHARD_SCHEMA = "part int, shard int, offset long, n_ids long, doc_ids array<long>, ends array<long>, base int, generations array<int>, rules binary, lengths binary, sequence binary"


def among(values: np.ndarray, known: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the values that are in known, number in known of each). Both are of one unsigned type; known is sorted and has no repeats.

    A table of slots has one number each, of those that want it the last in order. The few others mark it, and are searched for.
    """
    width = 8 * known.dtype.itemsize
    bits = min(width, len(known).bit_length() + 3)
    factor, shift = known.dtype.type(0x9E3779B97F4A7C15 >> (64 - width) | 1), known.dtype.type(width - bits)
    slot, number = ((known * factor) >> shift).astype(np.int64), np.arange(len(known), dtype=np.int32)
    table = np.zeros(1 << bits, np.int32)
    table[slot.take(order)] = order
    others = np.flatnonzero(table[slot] != number)
    table[slot[others]] |= np.int32(-1 << 31)
    found = table.take(((values * factor) >> shift).astype(np.int64))
    again = np.flatnonzero(found < 0)
    found &= np.int32((1 << 31) - 1)
    hit = known.take(found) == values
    again = again[~hit[again]]
    if len(again):
        found[again] = others[np.minimum(np.searchsorted(known[others], values[again]), len(others) - 1)]
        hit[again] = known[found[again]] == values[again]
    at = np.flatnonzero(hit)
    return at, found.take(at)


def compress(ids: np.ndarray, least_use: int = 4, least_gain: float = 0.0) -> tuple[int, list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(base, rules of each round, rules, lengths, sequence). A round that shortens the sequence by less than least_gain is the last.

    Counts are exact, and of x x x only every second pair counts. The pair with the highest count wins wherever it
    stands, so each round makes a rule until no pair is left with least_use places. A pair that is too rare stays so, as
    replacing makes pairs of new symbols only: each round looks at the frequent places and those beside new symbols.
    Symbols are moved together only when there are many gaps, and linked else, so late rounds cost what they look at.
    """
    base = int(ids.max()) + 1 if len(ids) else 1
    sequence, following, held = ids.astype(np.uint32), base, len(ids)
    after = before = None  # the links, where there are gaps
    there, live = np.ones(held, bool), np.ones(held + 1, bool)  # live: places whose pair may be frequent; the one beyond the end never is
    rules, generations = [], []
    while held > 1:
        live[[-1, -2 if before is None else before[-1]]] = False
        place = np.flatnonzero(live)
        beside = place + 1 if after is None else after.take(place)
        left, right = sequence.take(place), sequence.take(beside)
        kind_type = np.uint32 if following <= 1 << 16 else np.uint64
        pair = left.astype(kind_type)
        pair *= kind_type(following)
        pair += right
        ordered, second = pair.copy(), np.empty(0, np.int64)  # second: the places of x x x that do not count
        if len(at := np.flatnonzero(left == right)):
            begins = np.concatenate([[True], place[at[1:]] != beside[at[:-1]]])
            second = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))) % 2 == 1]
            ordered[second] = np.iinfo(kind_type).max  # to the end, where they are cut off
        ordered.sort()
        ordered = ordered[: len(ordered) - len(second)]
        starts = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
        n = np.diff(starts, append=len(ordered))
        often = np.flatnonzero(n >= least_use)
        if not len(often):
            break
        kinds, n = ordered.take(starts.take(often)), n.take(often)
        order = np.argsort(n, kind="stable")
        frequent, kind = among(pair, kinds, order)
        here, next_to = place.take(frequent), beside.take(frequent)
        rank = np.empty(len(n), np.int32)
        rank[order] = np.arange(len(n))
        strength = rank.take(kind)
        if len(second):
            at = np.minimum(np.searchsorted(frequent, second), len(frequent) - 1)
            strength[at[frequent[at] == second]] = -1  # below the one before it
        apart = here[1:] != next_to[:-1]
        best = np.ones(len(here), bool)
        best[1:] &= apart | (strength[1:] > strength[:-1])
        best[:-1] &= apart | (strength[:-1] > strength[1:])
        own = np.flatnonzero(best)
        used = np.bincount(kind.take(own), minlength=len(n)) >= least_use
        own = own.take(np.flatnonzero(used.take(kind.take(own))))
        if len(own) < max(1, least_gain * held):
            break
        at, gone, made_of = here.take(own), next_to.take(own), np.flatnonzero(used)
        number = np.empty(len(n), np.uint32)
        number[made_of] = np.arange(following, following + len(made_of))
        made = np.stack(np.divmod(kinds[made_of].astype(np.int64), following), 1)
        sequence[at] = number.take(kind.take(own))
        live[:] = False
        live[here] = True
        live[at] = live[at - 1 if before is None else before[at]] = True
        live[gone] = there[gone] = False
        held -= len(at)
        if held < 0.9 * len(sequence):
            keep = np.flatnonzero(there)
            sequence, live = sequence.take(keep), np.append(live.take(keep), False)
            after, before, there = None, None, np.ones(held, bool)
        else:
            if after is None:
                after, before = np.arange(1, len(sequence) + 1), np.arange(-1, len(sequence))
            after[at] = after[gone]
            before[after[at]] = at
        rules.append(made)
        generations.append(len(made_of))
        following += len(made_of)
    lengths, at = np.ones(following, np.int64), base
    for made in rules:
        lengths[at : at + len(made)] = lengths[made].sum(1)
        at += len(made)
    made = np.concatenate(rules) if rules else np.empty((0, 2), np.int64)
    return base, generations, made.astype("<u4"), lengths[base:].astype("<u4"), sequence[there].astype("<u4")


class Grammar:
    """Reads a shard: all of its ids, or those of a range without expanding the rest."""

    def __init__(self, base: int, generations: list[int], rules: bytes, lengths: bytes, sequence: bytes):
        self.sequence = np.frombuffer(sequence, "<u4").astype(np.int64)
        self.lengths = np.concatenate([np.ones(base, np.int64), np.frombuffer(lengths, "<u4").astype(np.int64)])
        self.ends = np.cumsum(self.lengths[self.sequence])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.empty(int(self.lengths.sum()), np.uint32)
        self.flat[:base] = np.arange(base)
        made, at = np.frombuffer(rules, "<u4").astype(np.int64).reshape(-1, 2), 0
        for n in generations:
            ids = self.expand(made[at : at + n].ravel())
            self.flat[self.starts[base + at] : self.starts[base + at] + len(ids)] = ids
            at += n

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[symbols] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        end = int(self.ends[-1]) if end is None and len(self.ends) else end or 0
        if end <= start:
            return np.empty(0, np.uint32)
        a, b = np.searchsorted(self.ends, [start, end - 1], "right")
        before = int(self.ends[a - 1]) if a else 0
        return self.expand(self.sequence[a : b + 1])[start - before : end - before]


class RunTable:
    """64-bit keys -> stretches of ids: open addressing in numpy, so that a batch of runs is looked up at once.

    Beyond limit entries, cut keeps those that were met again since the last cut.
    """

    def __init__(self, bits: int = 21, limit: int = 600_000):
        self.least_bits, self.limit = bits, limit
        self.clear()

    def clear(self) -> None:
        self._slots(self.least_bits)
        self.start, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self.met = np.zeros(1024, bool)
        self.entries = self.used = 0

    def _slots(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)  # 0 is a free place
        self.entry = np.zeros(1 << bits, np.int32)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        out, place, left = np.full(len(keys), -1, np.int64), self._places(keys), np.arange(len(keys))
        while len(left):
            there = self.keys[place[left]]
            hit = there == keys[left]
            out[left[hit]] = self.entry[place[left[hit]]]
            left = left[~hit & (there != 0)]
            place[left] = (place[left] + 1) & (len(self.keys) - 1)
        return out

    def add(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        """Different keys that are not there yet, how many ids each has, and all their ids."""
        grown = lambda a, n: a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a) // 2), a.dtype)])
        first, self.entries = self.entries, self.entries + len(keys)
        if 2 * self.entries > len(self.keys):
            there = np.flatnonzero(self.keys)
            old, number = self.keys[there], self.entry[there]
            self._slots((2 * self.entries).bit_length())
            self._put(old, number)
        self.start, self.size, self.ids = grown(self.start, self.entries), grown(self.size, self.entries), grown(self.ids, self.used + len(flat))
        self.met = grown(self.met, self.entries)
        self.start[first : self.entries], self.size[first : self.entries] = self.used + np.cumsum(size) - size, size
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self._put(keys, np.arange(first, self.entries))

    def _put(self, keys: np.ndarray, number: np.ndarray) -> None:
        place, left = self._places(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[place[left]] == 0]
            self.keys[place[free]] = keys[free]  # of those that want one place, the last gets it
            got = free[self.keys[place[free]] == keys[free]]
            self.entry[place[got]] = number[got]
            left = left[self.keys[place[left]] != keys[left]]
            place[left] = (place[left] + 1) & (len(self.keys) - 1)

    def cut(self) -> None:
        """Keeps what was met again, where that is at most half of the limit."""
        there = np.flatnonzero(self.keys)
        there = there[self.met[self.entry[there]]]
        keys, entries = self.keys[there], self.entry[there]
        size, flat = self.size[entries], self.gather(entries)
        self.clear()
        if 2 * len(keys) <= self.limit:
            self.add(keys, size, flat)

    def gather(self, entries: np.ndarray) -> np.ndarray:
        """All ids of the entries, one after the other."""
        size = self.size[entries]
        ends = np.cumsum(size, dtype=np.int64)
        return self.ids[np.repeat(self.start[entries] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class LibraryRuns:
    """Encodes texts with the tokenizers library, once for each different run of non-space bytes (remembered up to a bound).

    White space is a border of the file's pieces, and neither normalising nor merging reaches over it, so a text's ids
    are those of its runs. Letters count in lower case, and the marks after letters are a piece of their own. Runs are told
    apart by 64-bit keys.
    """

    LIMIT = 100_000  # different marks
    #: The symbol of each byte; runs are joined by line breaks, which stay.
    SYMBOLS = "".join("\n" if b == 10 else c for b, c in enumerate(byte_symbols()))
    #: Of each line of symbols: a word of letters up to U+00FF, which NFC leaves as they are, and ASCII marks; else nothing.
    #: C3 and the bytes after it are symbols of their own, but in UTF-8 they only come as the pairs of those letters.
    WORD = re.compile(rf"^(?:([a-z{SYMBOLS[0xC3]}{SYMBOLS[0x9F:0xB7]}{SYMBOLS[0xB8:0xC0]}]+)([!-/:-@\[-`{{-~]*)$)?", re.MULTILINE)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.table, self.marks = RunTable(), {}

    def encode(self, runs: list[bytes]) -> list[bytes]:
        """The ids of each run. Words and marks are single pieces, and go straight to the library's model as symbols."""
        if len(self.marks) > self.LIMIT:
            self.marks.clear()
        tokenize, known, out, other = self.tokenize, self.marks, [], []
        lower = b"\n".join(runs).decode().lower().encode()
        for i, (word, marks) in enumerate(self.WORD.findall(codecs.charmap_decode(lower, "strict", self.SYMBOLS)[0])):
            if not word:
                other.append(i)
                out.append(b"")
                continue
            ids = [t.id for t in tokenize(word)]
            if marks:
                if (last := known.get(marks)) is None:
                    last = known[marks] = [t.id for t in tokenize(marks)]
                ids += last
            out.append(array("I", ids).tobytes())
        for i, found in zip(other, self.tokenizer.encode_batch_fast([runs[i].decode() for i in other], add_special_tokens=False)):
            out[i] = array("I", found.ids).tobytes()
        return out

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after the other, how many each text has)."""
        data = b"\n".join(texts)
        starts, ends, keys = run_keys(data)
        if self.table.entries > self.table.limit:
            self.table.cut()
        found = self.table.find(keys)
        new = np.flatnonzero(found < 0)
        self.table.met[found[np.flatnonzero(found >= 0)]] = True
        if len(new):
            unique, first = np.unique(keys[new], return_index=True)
            at = new[first]
            ids = self.encode([data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            self.table.add(unique, np.array([len(x) // 4 for x in ids], np.int32), np.frombuffer(b"".join(ids), "<u4"))
            found[new] = self.table.find(keys[new])
        borders = np.cumsum([len(t) + 1 for t in texts])
        of = np.searchsorted(borders, starts, "right")
        return self.table.gather(found), np.bincount(of, self.table.size[found], minlength=len(texts)).astype(np.int64)


_libraries: dict[str, LibraryRuns] = {}


def write_shards(docs: DataFrame, vocabulary: str, end_id: int | None = None, id_column: str = "doc_id", text: str = "text", shard_ids: int = 1_000_000) -> DataFrame:
    """Encode every whole text with the tokenizers library and write the ids in ascending order of the documents.

    Returns the written table (see the module's text for its format). A null text counts as empty; end_id, where
    given, follows each document. Documents with equal ids stand next to each other, ordered by text; a null id comes
    first. A shard ends with the document that fills shard_ids; a longer document is a shard of its own. Other columns
    of docs are not read. An empty table gives a table without shards.
    """
    source = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    ordered = source.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, offset = TaskContext.get().partitionId(), 0, 0
        if vocabulary not in _libraries:
            _libraries[vocabulary] = LibraryRuns(vocabulary)
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        held = 0

        def row() -> pa.RecordBatch:
            nonlocal shard, offset, held
            flat = np.frombuffer(b"".join(ids), "<u4")
            base, generations, rules, lengths, sequence = compress(flat)
            ends = np.cumsum([len(x) // 4 for x in ids])
            made = [part, shard, offset, len(flat), doc_ids[:], ends, base, generations, rules.tobytes(), lengths.tobytes(), sequence.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
            names = [x.split()[0] for x in SHARD_SCHEMA.split(", ")]
            shard, offset, held = shard + 1, offset + len(flat), 0
            ids.clear()
            doc_ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(made, kinds)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = [t or b"" for t in binary_list(some.column(1))]
                flat, sizes = _libraries[vocabulary].texts(texts)
                raws, borders = flat.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(sizes)])).tolist()
                for doc, a, b in zip(some.column(0).to_pylist(), borders, borders[1:]):
                    raw = raws[a:b] + end
                    if held and held + len(raw) // 4 > shard_ids:
                        yield row()
                    ids.append(raw)
                    doc_ids.append(doc)
                    held += len(raw) // 4
        if doc_ids:
            yield row()

    return written(ordered.mapInArrow(run, SHARD_SCHEMA), "id-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the written shards.

    start counts the ids of all documents before it. Only the totals of the parts are summed up in one place, and a
    part is a shuffle partition of the writer: their number is bounded, and so they may be broadcast.
    """
    totals = shards.groupBy("part").agg(F.max(F.col("offset") + F.col("n_ids")).alias("total"))
    starts = totals.select("part", F.expr("coalesce(sum(total) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("part_start"))
    placed = shards.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("offset")).alias("start"), "doc_ids", "ends", "base", "generations", "rules", "lengths", "sequence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, doc_ids, ends, *grammar = (batch.column(k)[i].as_py() for k in range(batch.num_columns))
                raw, ends = Grammar(*grammar).ids().astype("<u4").tobytes(), np.array(ends, np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begins + start), pa.array(ends - begins), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
