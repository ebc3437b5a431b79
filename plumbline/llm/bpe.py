"""Byte-pair encoding and decoding with a public vocabulary file (no training).

Each piece of text is a doubly linked list of symbols. A heap holds (rank, position) of the merges that are
possible; the lowest is taken, and entries that no longer describe the list are skipped. A run of bytes
between white space encodes and decodes alike wherever it stands, so each task remembers the runs it has met (bounded in
bytes, and gone with the task), and the heap works once for each different run. Runs that were met lately are kept when the
bound is reached.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from tokenizers import Tokenizer

from plumbline.llm.common import binary_list, fresh


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class BpeModel:
    """A vocabulary file's model: normaliser (NFC, lower case), splitting pattern, merges, vocabulary, special strings."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings: dict[int, str] = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.ranks: dict[int, int] = {}  # left id << 32 | right id -> rank
        self.made: list[int] = []  # by rank
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.vocab[left] << 32 | self.vocab[right]] = rank
            self.made.append(self.vocab[left + right])
        symbols = byte_symbols()
        self.inner = [self.vocab.get(s) for s in symbols]
        self.last = [self.vocab.get(s + self.suffix) for s in symbols]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.byte_of = {s: b for b, s in enumerate(symbols)}
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    @classmethod
    def load(cls, path: str) -> BpeModel:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: lowest rank first, of equal ranks the leftmost."""
        ids = [self.inner[b] for b in piece[:-1]] + [self.last[piece[-1]]]
        ids = [i for i in ids if i is not None]
        n = len(ids)
        if n < 2:
            return ids
        before, after, rank_of, made = list(range(-1, n - 1)), [*range(1, n), -1], self.ranks.get, self.made
        ranks = [rank_of(left << 32 | right, -1) for left, right in zip(ids, ids[1:])] + [-1]  # of the pair that begins at each symbol
        heap = [rank << 32 | i for i, rank in enumerate(ranks) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            if ranks[i] != rank:
                continue  # stale: a neighbour was merged since
            j = after[i]
            new = ids[i] = made[rank]
            ids[j] = ranks[j] = ranks[i] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (found := rank_of(new << 32 | ids[k], -1)) >= 0:
                    ranks[i] = found
                    heapq.heappush(heap, found << 32 | i)
            h = before[i]
            if h >= 0:
                found = ranks[h] = rank_of(ids[h] << 32 | new, -1)
                if found >= 0:
                    heapq.heappush(heap, found << 32 | h)
        return [i for i in ids if i >= 0]

    def normalise(self, text: str) -> str:
        """NFC, then each character in lower case by itself (a final sigma stays as any other)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[bytes]:
        """Split as the file says. Beyond the common scripts the library splits, as Unicode versions differ in what is a letter."""
        if max(text, default="") > "\u024f":
            split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes([self.byte_of[c] for c in p]) for p, _ in split]
        return [p.encode() for p in self.pattern.findall(self.normalise(text))]

    def encode(self, text: str) -> list[int]:
        """All ids of a text. Special strings are found before anything else."""
        out: list[int] = []
        start = 0
        for found in self.special_pattern.finditer(text) if self.special_pattern else ():
            for piece in self.pieces(text[start : found.start()]):
                out += self.merge(piece)
            out.append(self.special[found.group()])
            start = found.end()
        for piece in self.pieces(text[start:]):
            out += self.merge(piece)
        return out

    def decode(self, ids) -> str:
        """The vocabulary strings, one space between them; unknown ids are left out."""
        strings = self.strings
        return " ".join([strings[i] for i in ids if i in strings])


#: A word of letters up to U+00FF, and a mark.
WORD = re.compile(r"([a-zß-öø-ÿ]+)([.,;:!?]?)")


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class RunEncoder(dict):
    """run of non-space bytes -> (its ids as little-endian unsigned 32-bit integers, what they decode to).

    Runs and pieces are kept up to a bound of bytes. Half of it is for those met since the last cut; then these become the older
    half, of which what is met again moves on, and the rest is forgotten at the next cut.
    """

    #: What an entry takes beside its bytes.
    ENTRY = 300

    def __init__(self, model: BpeModel, limit: int = 160 << 20):
        super().__init__()
        self.model, self.limit, self.held = model, limit, 0
        self.older: dict[bytes, tuple[bytes, bytes]] = {}
        self.pieces: dict[bytes, tuple[bytes, bytes]] = {}
        self.older_pieces: dict[bytes, tuple[bytes, bytes]] = {}

    def _room(self, key: bytes, size: int) -> bool:
        """Makes room for an entry; long ones are not kept."""
        if len(key) >= 256:
            return False
        self.held += len(key) + size + self.ENTRY
        if self.held > self.limit // 2:
            self.older, self.older_pieces = dict(self), self.pieces
            self.clear()
            self.pieces = {}
            self.held = len(key) + size + self.ENTRY
        return True

    def __missing__(self, run: bytes) -> tuple[bytes, bytes]:
        if (value := self.older.get(run)) is None:
            value = self.made(run)
        if self._room(run, len(value[0]) + len(value[1])):
            self[run] = value
        return value

    def made(self, run: bytes) -> tuple[bytes, bytes]:
        model, text = self.model, run.decode()
        if found := WORD.fullmatch(text.lower()):  # a word and a mark are single pieces, and NFC leaves them as they are
            word, mark = found.groups()
            if not mark:
                return self.piece(word.encode())
            pieces = [self.piece(word.encode()), self.piece(mark.encode())]
        elif model.special_pattern and model.special_pattern.search(text):
            pieces = [self._packed(model.encode(text))]
        else:
            pieces = list(map(self.piece, model.pieces(text)))
        return b"".join([ids for ids, _ in pieces]), b" ".join([decoded for ids, decoded in pieces if ids])

    def _packed(self, ids: list[int]) -> tuple[bytes, bytes]:
        return packed(ids), self.model.decode(ids).encode()

    def piece(self, piece: bytes) -> tuple[bytes, bytes]:
        """The ids of one piece, and what they decode to."""
        if (value := self.pieces.get(piece)) is None:
            if (value := self.older_pieces.get(piece)) is None:
                value = self._packed(self.model.merge(piece))
            if self._room(piece, len(value[0]) + len(value[1])):
                self.pieces[piece] = value
        return value

    def text(self, data: bytes) -> bytes:
        return b"".join([ids for ids, _ in map(self.__getitem__, data.split())])

    def both(self, data: bytes) -> tuple[bytes, bytes]:
        """(ids, what they decode to): a run's strings stand with one space between them, as those of a text do."""
        found = list(map(self.__getitem__, data.split()))
        return b"".join([ids for ids, _ in found]), b" ".join([decoded for ids, decoded in found if ids])


_models: dict[str, BpeModel] = {}


def encoder(path: str) -> RunEncoder:
    """A task's encoder for a vocabulary file. The worker keeps the model; what is remembered goes with the task."""
    if path not in _models:
        _models[path] = BpeModel.load(path)
    return RunEncoder(_models[path])


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add to each row its ids and the text that they decode to.

    vocabulary is the path of the public vocabulary file, which every worker has. Returns the columns keep (all
    by default) and bpe_ids array<int>, bpe_decoded string. One row out for each row in, repeated rows included.
    A null text counts as empty: no ids, an empty decoded text. Very long texts are encoded whole. A text column of
    another type is read as a string. Existing columns bpe_ids and bpe_decoded are replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("bpe_ids", "bpe_decoded")]
    helper = fresh("_text", names)
    source = docs.select(*[docs[c] for c in names], docs[text].cast("string").alias(helper))
    schema = source.drop(helper).schema.add("bpe_ids", ArrayType(IntegerType())).add("bpe_decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # the ids of long texts are several times their bytes
                part = batch.slice(at, 500)
                raw, decoded = zip(*(coder.both(t or b"") for t in binary_list(part.column(part.num_columns - 1))))
                ends = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype=np.int64)
                ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], listed, pa.array(decoded, pa.binary()).cast(pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's whole text; see encode_decode for odd input.

    The same encoder and decoder as encode_decode, but ids and decoded text are digested where they are made.
    """
    source = docs.select(docs[id_column].alias("doc_id"), docs[text].cast("string").alias("text"))
    schema = source.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for data in binary_list(batch.column(1)):
                ids, decoded = coder.both(data or b"")
                counts.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(text_hex)], names=schema.names)

    return source.mapInArrow(run, schema)
