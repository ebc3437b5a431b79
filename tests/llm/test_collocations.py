"""Collocations against counting in plain Python; cuts of long texts, equal fingerprints, odd input."""

import random
import re
from collections import Counter

import numpy as np

from plumbline.llm import collocations as C


def brute(rows, top, least, percent=80):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for n in range(1, 5):
                counts.update((lang or "und", tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
            found[lang, p] = (a, *min(cuts))
    longer = Counter()
    for (lang, p), (a, *_) in found.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                longer[lang, p[i : i + n]] = max(longer[lang, p[i : i + n]], a)
    out = []
    for lang in totals:
        kept = [(-s, -a, " ".join(p).encode(), l, r) for (x, p), (a, s, _, l, r) in found.items() if x == lang and not longer[lang, p] * 100 >= a * percent]
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def made(spark, rows, **how):
    df = spark.createDataFrame([(t, x, i, "clash") for i, (t, x) in enumerate(rows)], "text string, lang string, doc_id long, phrase string").repartition(3)
    return sorted(tuple(r)[:8] for r in C.collocations(df, **how).collect())


def test_equals_brute_force(spark):
    r = random.Random(1)
    vocabulary = ["New", "york", "the", "of", "é", "Ünï", "a" * 9, "bb", "c-d", "#", "x\x0by", "1"]
    rows = [("".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(r.randrange(90))), r.choice(["en", "fr", None])) for _ in range(150)]
    rows += [("new york city hall is big", "en")] * 12 + [("copy of a copy of a copy", None)] * 20 + [(None, "en"), ("", "fr"), (" \t.,", "de"), ("only words here", "es"), ("only words here", "und")]
    for how in ({"top": 2000, "least": 5}, {"top": 3, "least": 9}, {"top": 50, "least": 1}):
        assert made(spark, rows, **how) == brute(rows, **how)
    assert made(spark, rows, top=2000, least=5, filter_bits=15) == brute(rows, 2000, 5)  # a bitmap that lets much through
    df = spark.createDataFrame([(t, x, i % 7) for i, (t, x) in enumerate(rows)], "text string, lang string, doc_id long")
    plain = C.counted_phrases(df, least=5).sort("lang", "phrase").collect()
    for bits in (3, 9):  # fingerprints that are shared by many phrases
        assert C.counted_phrases(df, least=5, key_bits=bits, filter_bits=15).sort("lang", "phrase").collect() == plain
    assert made(spark, [], top=5) == []


def test_pointers(spark):
    rows = [(5, "b a b"), (2, "x, a b"), (None, "a a  B")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'l' as lang")
    got = {r["phrase"]: (r["f"], r["doc_id"], r["at"]) for r in C.counted_phrases(df, least=1).collect()}
    assert got["a b"] == (3, None, 2) and got["b a"] == (1, 5, 0) and got["x"] == (1, 2, 0) and got[""] == (9, None, None)


def test_long_texts_are_cut_without_loss(monkeypatch):
    r = random.Random(2)
    powers = C.Powers()
    for piece in (7, 20, 64):
        monkeypatch.setattr(C, "PIECE", piece)
        texts = ["".join(r.choice("aab  \t.") for _ in range(r.randrange(300))).encode() for _ in range(40)]
        counts, words = Counter(), 0
        for data, carried, _ in C.blocks(texts):
            block = C.Block(data, carried, 1, powers)
            words += block.words()
            for n in range(1, 5):
                line = block.line.tobytes()
                counts.update((n, line[block.starts[i] : block.ends[i + n - 1]]) for i in np.flatnonzero(block.stands(n)))
        expected = Counter()
        for text in texts:
            for p in re.split(rb"[.]", text):
                w = p.split()
                for n in range(1, 5):
                    expected.update((n, b" ".join(w[i : i + n])) for i in range(len(w) - n + 1))
        assert counts == expected and words == sum(c for (n, _), c in expected.items() if n == 1)


def test_equal_fingerprints_are_told_apart_by_text():
    full, data = np.full(4096, 255, np.uint8), b"aa bb aa cc longer-than-eight-bytes-x longer-than-eight-bytes-y aa bb"
    block = C.Block(data, 0, 1, C.Powers(), key_bits=1)
    counts = Counter()
    for _, _, phrase, c, _ in C.phrases(block, full, 15):
        counts[phrase] += c
    w = data.split()
    assert counts == Counter(b" ".join(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))


def test_fingerprints_are_those_of_the_bytes():
    powers = C.Powers()
    one, two = C.Block(b"x Foo  bar baz", 0, 9, powers), C.Block(b"foo\tBAR q", 0, 9, powers)
    assert one.keys(np.array([1]), 2) == two.keys(np.array([0]), 2)
    assert one.keys(np.array([1]), 1) == two.keys(np.array([0]), 1) != two.keys(np.array([1]), 1)


def test_counts_travel_in_small_batches():
    """What a task holds at once is bounded by rows: of texts that come in one batch, and of counts that it sends."""
    import pyarrow as pa

    n = 2 * C.ROWS + 1
    batch = pa.RecordBatch.from_pydict({"lang": ["x"] * n, "text": ["one two"] * n, "doc": list(range(n))})
    found = list(C._text_blocks(iter([batch]), 64))
    assert [block.words() for _, block, _, _ in found] == [2 * C.ROWS, 2 * C.ROWS, 2]
    rows = tuple(np.arange(2 * C.SENT + 1).astype(t) for t in (np.uint64, np.int64, np.int64, np.int64))
    assert [b.num_rows for b in C._sent(rows)] == [C.SENT, C.SENT, 1] and C.HELD <= 1 << 19
