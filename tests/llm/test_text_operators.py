"""BPE, token shards, near duplicates, decontamination, language, scores: brute force, odd input, clashing names."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import bpe, decontam, grammar_ids, jaccard, langid, maxent
from plumbline.llm.common import connected_components, shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
ODD = [(1, "Hello, the WORLD's 12 cats!"), (2, None), (3, ""), (4, " \t\n"), (5, "naïve Ünï <|endoftext|>x ΑΣ ½ 漢字 \x1c\x85 e\u0301"), (6, "ab " * 3000), (6, "ab " * 3000), (None, "no id"), (7, "x" * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "c", 1) for i, t in ODD], "doc_id long, text string, bpe_ids string, n long")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_bpe_equals_the_library(spark, odd, library):
    got = bpe.encode_decode(odd, PATH).select("text", "bpe_ids", "bpe_decoded", "n").collect()
    assert len(got) == len(ODD)
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["bpe_ids"] == ids and r["bpe_decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.digests(odd.limit(0), PATH).count() == 0


def test_bpe_on_random_text(library):
    coder, r = bpe.RunEncoder(bpe.BpeModel.load(PATH), limit=50), random.Random(5)
    alphabet = "abAB 's'll 12\t\x0b\x1c\x85\u3000ΣσςİéÉ½中ß\U0001f600\u0300<|endoftext|>-_.,!?"
    for _ in range(2000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        assert np.frombuffer(coder.text(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_id_shards_round_trip(spark, odd, library):
    shards = grammar_ids.write_shards(odd, PATH, end_id=2, shard_ids=4000)
    assert shards.count() >= 3
    got = grammar_ids.read_documents(shards).orderBy("start").collect()
    order = sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    at = 0
    assert [r["doc_id"] for r in got] == [i for i, _ in order]
    for r, (_, text) in zip(got, order):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert grammar_ids.read_documents(grammar_ids.write_shards(odd.limit(0), PATH)).count() == 0


@pytest.mark.parametrize("kinds", [1, 2, 9])
def test_grammar_random_access(kinds):
    rng = np.random.default_rng(kinds)
    ids = np.concatenate([rng.integers(0, kinds, 3000), np.tile(rng.integers(0, kinds, 17), 90)]).astype("<u4")
    base, generations, rules, lengths, sequence = grammar_ids.compress(ids, 2, 0)
    shard = grammar_ids.Grammar(base, generations, rules.tobytes(), lengths.tobytes(), sequence.tobytes())
    assert (shard.ids() == ids).all() and len(sequence) < len(ids)
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert (shard.ids(a, b) == ids[a:b]).all()


@pytest.mark.parametrize("seed", range(3))
def test_grammar_leaves_no_pair_that_is_worth_a_rule(seed):
    """Also where pairs are more than any table's slots, and where a round gains little."""
    rng = np.random.default_rng(seed)
    rare = rng.integers(0, 40000, 300_000)
    words = rng.integers(0, 40000, (9000, 2))[rng.integers(0, 9000, 60_000)].ravel()
    ids = np.concatenate([rare, words, np.full(2001, 7), np.tile([1, 1, 2], 50)]).astype("<u4")
    base, generations, rules, lengths, sequence = grammar_ids.compress(ids)
    shard = grammar_ids.Grammar(base, generations, rules.tobytes(), lengths.tobytes(), sequence.tobytes())
    assert (shard.ids() == ids).all()
    uses, i, s = Counter(), 0, sequence.tolist()
    last = {}
    for i, p in enumerate(zip(s, s[1:])):
        if p[0] != p[1] or last.get(p) != i - 1:  # of x x x one pair
            uses[p] += 1
            last[p] = i
    assert max(uses.values()) < 4


def test_late_rounds_of_a_grammar_cost_what_they_look_at():
    """A phrase that grows by one symbol a round takes 60 rounds beside a million rare ids, which no round looks at twice."""
    rare = np.random.default_rng(4).permutation(1_000_000)
    chain = np.concatenate([np.arange(n) for n in range(2, 62) for _ in range(4)])

    def seconds(ids):
        found = []
        for _ in range(3):
            start = time.process_time()
            made = grammar_ids.compress(ids.astype("<u4"))
            found.append(time.process_time() - start)
        return min(found), made

    alone, _ = seconds(rare)
    both, (base, generations, rules, lengths, sequence) = seconds(np.concatenate([chain, rare]))
    assert len(generations) >= 50 and both < 2.5 * alone
    assert (grammar_ids.Grammar(base, generations, rules.tobytes(), lengths.tobytes(), sequence.tobytes()).ids() == np.concatenate([chain, rare])).all()


@pytest.mark.parametrize("dtype, high", [("<u4", 1 << 32), ("<u8", 1 << 63)])
def test_values_among_known_ones(dtype, high):
    """Also where known values want one slot, where nearly all are known, and the type's ends."""
    rng = np.random.default_rng(8)
    for n in (1, 2, 50, 20_000):
        known = np.unique(np.concatenate([rng.integers(0, high, n, "u8"), [0] * (n > 1)])).astype(dtype)
        values = np.concatenate([rng.permutation(known), known[:7], rng.integers(0, high, 5000, "u8").astype(dtype), np.array([0, np.iinfo(dtype).max], dtype)])
        at, number = grammar_ids.among(values, known, rng.permutation(len(known)))
        assert at.tolist() == np.flatnonzero(np.isin(values, known)).tolist() and (known[number] == values[at]).all()


def sets_of(text, k):
    words = (text or "").encode().lower().split()
    return set() if not words else {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def near(spark):
    """Near copies around the limits, short texts, exact copies, and a passage that many share."""
    r, texts = random.Random(3), []
    passage = [f"p{i}" for i in range(30)]
    for _ in range(25):
        words = [f"w{r.randrange(4000)}" for _ in range(r.choice([4, 30, 80, 200]))] + (passage if r.random() < 0.5 else [])
        texts += [" ".join(words), " ".join(words).upper()] + [edited(r, words, n) for n in (0, 1, 2, 3, 5, 9)]
    texts += [None, "", " ", "a", "A", "a b", "b a", "a b c d"]
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_equals_brute_force(spark, near, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_DOCS", 4)  # so that components are cut into tiles
    sets = {i: sets_of(t, k) for i, t in near}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    expected = components(pairs, sets)
    docs = spark.createDataFrame(near, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, k, percent).collect()}
    assert got == {i: (len(sets[i]), expected[i]) for i in sets}


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_similar_sets_have_a_common_key(percent):
    """Pairs that are just similar enough, of all sizes, and with the larger one first or second."""
    rng = np.random.default_rng(percent)
    for n in [*range(1, 40), 64, 100, 333, 1000]:
        for _ in range(12):
            m = int(rng.integers(n, 100 * n // percent + 1))
            common = -(-percent * (n + m) // (100 + percent))
            if common > n:
                continue
            h = rng.integers(0, 2**64, n + m - common, np.uint64)
            x, y = np.unique(h[:n]), np.unique(np.concatenate([h[:common], h[n:]]))
            assert len(x) == n and len(y) == m and 100 * common >= percent * (n + m - common)
            keys, owner = jaccard._keys([x, y], percent)
            assert np.array_equal(x, y) or set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist()), (n, m, common)


def test_jaccard_with_hot_keys(spark, monkeypatch):
    """Keys that many documents of a chunk have, in one chunk and in several."""
    monkeypatch.setattr(jaccard, "HOT", 2)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join([*words, *[f"x{i}"] * (i % 4)])) for i in range(1, 60)] + [(i, " ".join(words[:30] + [f"y{i}"] * 9)) for i in range(60, 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: sets_of(t, 3) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, 3, 90).collect()}
    assert got == components(pairs, sets)


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    from plumbline.llm import common

    texts = [b"", b"a b", b"word " * 400 + b"x" * 300, b" ", b"y" * 70 + b" z"]
    whole, counts = common.hashed_words(texts)
    monkeypatch.setattr(common, "PIECE", 100)
    again, same = common.hashed_words(texts)
    assert (whole == again).all() and (counts == same).all() and counts.tolist() == [0, 2, 401, 0, 2] and len(set(whole.tolist())) == 6


def test_jaccard_with_null_ids_first(spark):
    """A row without an id takes nothing from equal rows that have one, in its chunk or in others."""
    words = [f"w{i}" for i in range(60)]
    text = " ".join(words)
    rows = [(None, text), (5, text), (9, text), (12, text + " x"), (None, text + " x"), (20, "alone " + " ".join(words[::-1])), (None, "alone " + " ".join(words[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    other = spark.createDataFrame([(3, text + " y"), (None, text)], "doc_id long, text string").coalesce(1)
    components = lambda d: sorted((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(d).where("doc_id is not null").collect())
    assert components(docs) == [(5, 5), (9, 5), (12, 5), (20, 20)]
    both = docs.union(other)
    assert components(both) == [(3, 3), (5, 3), (9, 3), (12, 3), (20, 20)]
    assert jaccard.jaccard_components(both).where("doc_id is null and component_id is null").count() == 4
    assert sorted(r["doc_id"] for r in jaccard.keep_one(both).where("doc_id is not null").collect()) == [3, 20]


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "a"), (2, text + " x", "b"), (2, text + " x", "b"), (3, "other", "c"), (3, "other", "c"), (None, "n", "d"), (None, text, "e"), (5, None, "f"), (3, "an id again with a text of its own", "g"), (3, text + " y", "h"), (None, "no id " + text[::-1], "i"), (None, "no id " + text[::-1], "i"), (None, None, "j"), (None, "", "k"), (None, "", "k")], "doc_id long, text string, component string")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["component"]) for r in kept.collect()) == [(0, "d"), (0, "i"), (0, "j"), (0, "k"), (0, "k"), (1, "a"), (3, "c"), (3, "g"), (5, "f")]
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}


def similarity(a, b):
    a, b = Counter(a), Counter(b)
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_decontamination_equals_all_windows(spark, broadcast_bytes):
    r = random.Random(11)
    items = {i: [f"v{r.randrange(300)}" for _ in range(n)] for i, n in enumerate([3, 8, 20, 40, 60, 40])}
    items[5] = items[3]
    docs = {}
    for d in range(60):
        words = [f"v{r.randrange(300)}" for _ in range(r.choice([2, 10, 90]))]
        item = list(items[r.randrange(6)])
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            item[r.randrange(len(item))] = "zz"
        at = r.randrange(len(words) + 1)
        docs[d] = words[:at] + (item if r.random() < 0.7 else []) + words[at:]
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
    expected = {}
    for d, words in docs.items():
        for i, item in items.items():
            s, t = shingles(words), shingles(item)
            best = max(similarity(s[a : a + len(t)], t) for a in range(max(1, len(s) - len(t) + 1)))
            if best >= 0.8:
                expected[d, i] = best
    rows = [(d, (", " if d % 2 else "\n").join(w).upper(), 1) for d, w in docs.items()] + [(900, None, 1), (901, "", 1)]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string, item_id long"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(77, None), (78, "")], "item_id long, text string"), broadcast_bytes=broadcast_bytes)
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in got.collect()}
    assert set(found) == set(expected) and len(expected) > 20
    assert all(abs(found[k] - expected[k]) < 1e-12 for k in found)


def test_decontamination_of_very_long_items(spark):
    """More shingles than a lane of the SimHash counts, repeated ones too."""
    item = [f"v{i}" for i in range(99_000)] + ["again"] * 1000
    docs = spark.createDataFrame([(1, "x y z " + " ".join(item) + " end"), (2, " ".join(item[:-3])), (3, " ".join(item[:50_000])), (4, "again " * 500)], "doc_id long, text string")
    got = {r["doc_id"]: (r["similarity"], r["word_start"]) for r in decontam.contaminated(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert set(got) == {1, 2} and got[1] == (1.0, 3) and abs(got[2][0] - 99_993 / 99_996) < 1e-9


def test_decontaminate_judges_each_row_by_its_text(spark):
    passage = " ".join(f"b{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage), (1, "clean text"), (None, passage), (None, "also clean")], "doc_id long, text string")
    kept = decontam.decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert sorted(r["text"] for r in kept.collect()) == ["also clean", "clean text"]


def test_decontaminate_keeps_clean_rows(spark):
    passage = " ".join(f"b{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x " + passage + " y", "l"), (2, "clean text", "l"), (None, "n", "l"), (3, None, "l")], "doc_id long, text string, _gone string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    with pytest.raises(Exception):
        decontam.decontaminate(docs.drop("text"), bench)
    kept = decontam.decontaminate(docs.withColumnRenamed("_gone", "lang"), bench)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3]
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0
    assert decontam.contaminated(docs.limit(0), bench).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.held_out(F.col("doc_id"), 5)
    model = langid.train(docs.where(~held), sample_rows=500)
    found = langid.predict(docs.where(held), model).collect()
    assert len(found) == docs.where(held).count()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97
    assert sum(r["rejected"] for r in found) <= 2
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "漢字 漢字 漢字"), (5, "the and of the")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i]["rejected"] for i in (1, 2, 3, 4))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.train(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}


def test_language_rejects_what_is_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(-i, f"zuxq{i} wuxqa zuxqo quxza", "rare") for i in range(3)], "doc_id long, text string, lang string")
    held = langid.held_out(F.col("doc_id"), 5)
    model = langid.train(docs.where(~held).unionByName(rare), sample_rows=400, calibration_rows=300)
    few = langid.train(rare)
    assert few.labels == ["rare"] and not few.threshold and not few.familiar
    assert "rare" in model.labels and len(model.labels) == 5
    kept = langid.predict(docs.where(held), model).select("lang", "rejected").collect()
    assert sum(r["rejected"] for r in kept) <= 2
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są oni obdarzeni rozumem i sumieniem",
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja omatunto",
        "minden emberi lény szabadon születik és egyenlő méltósága és joga van, az emberek ésszel és lelkiismerettel bírnak",
        "все люди рождаются свободными и равными",
    ]
    got = langid.predict(spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string"), model).collect()
    assert all(r["rejected"] and r["lang_pred"] in model.labels for r in got)


def test_language_quotas():
    assert langid._quotas({"a": 1000, "b": 1000, "c": 5}, 105) == {"a": 50, "b": 50, "c": 5}
    assert langid._quotas({"a": 3, "b": 2}, 100) == {"a": 3, "b": 2} and min(langid._quotas({"a": 9, "b": 9}, 1).values()) == 1


def test_lm_scores(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9002, ""), (None, "Unseen-word the")], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = maxent.lm_scores(docs.withColumn("score", F.lit("clash")), train=~langid.held_out(F.col("doc_id"), 10)).collect()
    assert len(got) == docs.count()
    tokens = {d: (t or "").encode().lower().split() + [b" "] for d, t in texts.items()}
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    counts = Counter(w for r in got for w in tokens[r["doc_id"]] if not held(r["doc_id"]))
    n, v = sum(counts.values()), len(counts)
    for r in got:
        own = tokens[r["doc_id"]]
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(own), sum(counts[w] > 0 for w in own), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert maxent.lm_scores(docs.limit(0), train=F.lit(True)).count() == 0


def test_lm_model_is_a_distribution():
    rng = np.random.default_rng(0)
    table = maxent._log_softmax(rng.standard_normal((maxent.FEATURES, maxent.CLASSES)).astype(np.float32), maxent._features(np.arange(500)))
    assert np.allclose(np.exp(table).sum(1), 1, atol=1e-4)


def test_digest_of_an_empty_text(spark):
    r = bpe.digests(spark.createDataFrame([(1, None)], "doc_id long, text string"), PATH).first()
    assert tuple(r) == (1, 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())


def test_clashing_helper_columns(spark):
    """Callers' columns may have the names of any helper column."""
    from plumbline.llm import sharding

    extra = ["_gone", "_place", "_text", "_bits", "_depth", "_prefix", "shard", "prefix", "score", "component_id", "a", "b"]
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, None)], "doc_id long, text string").select("*", *[F.lit(n).alias(n) for n in extra])
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect()) == [1, 3]
    assert [r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()] == [3]
    assert bpe.encode_decode(docs, PATH).count() == 3 and langid.predict(docs, None).count() == 3
    assert {r["_prefix"] for r in sharding.assign(docs, 100).collect()} == {"_prefix"}


def test_run_encoder_on_random_text(library):
    coder, r = grammar_ids.LibraryRuns(PATH), random.Random(6)
    alphabet = "abAB 's'll 12\t\x0b\x1c\x85　ΣσςİéÉÀßẞKÅ½ªºµ÷×中\U0001f600̀<|endoftext|>-_.,!?"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["", " ", "x" * 3000]
    ids, sizes = coder.texts([t.encode() for t in texts])
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids] and sizes.sum() == len(ids)


def test_run_table_grows_and_keeps_what_was_met(library):
    """One batch may have more runs than places; a cut forgets what was not met again."""
    table, rng = grammar_ids.RunTable(bits=4, limit=4000), np.random.default_rng(2)
    keys = np.unique(rng.integers(1, 1 << 63, 5000, "u8"))
    size = rng.integers(0, 5, len(keys)).astype(np.int32)
    flat = rng.integers(0, 99, size.sum()).astype("<u4")
    table.add(keys, size, flat)
    assert table.find(keys).tolist() == list(range(len(keys))) and (table.gather(table.find(keys)) == flat).all()
    table.met[table.find(keys[::3])] = True
    kept = table.gather(table.find(keys[::3]))
    table.cut()
    assert (table.find(keys) >= 0).tolist() == [i % 3 == 0 for i in range(len(keys))]
    assert (table.gather(table.find(keys[::3])) == kept).all()
    table.cut()
    assert table.entries == 0
    coder, r = grammar_ids.LibraryRuns(PATH), random.Random(9)
    coder.table = grammar_ids.RunTable(bits=4, limit=60)
    for _ in range(40):
        texts = [" ".join(r.choice(["the", "a", "be"]) if r.random() < 0.6 else f"w{r.randrange(10**6)}!" for _ in range(20)) for _ in range(3)]
        ids, _ = coder.texts([t.encode() for t in texts])
        assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


def test_words_with_marks_go_straight_to_the_model(library):
    """Words and any marks after them need no normalising and splitting; other runs do."""
    coder, split = grammar_ids.LibraryRuns(PATH), []

    class Recorded:
        def encode_batch_fast(self, texts, **options):
            split.extend(texts)
            return library.encode_batch_fast(texts, **options)

    coder.tokenizer = Recorded()
    texts = ["Word*** ÉTÉ!! naïve.&&& don't", "x'' (y) Straße,### o\u0301.. a÷b 1.5%", "\u212aelvin!? ' <|endoftext|>"]
    ids, _ = coder.texts([t.encode() for t in texts])
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
    assert sorted(split) == sorted(["don't", "(y)", "o\u0301..", "a÷b", "1.5%", "'", "<|endoftext|>"])


def test_texts_of_a_language_left_out_are_rejected(spark):
    """A language that training never saw is rejected though it shares its letters; learned ones stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.held_out(F.col("doc_id"), 3)
    for left in ("de", "fr"):
        model = langid.train(docs.where(~held & (F.col("lang") != left)), sample_rows=400, calibration_rows=400)
        assert model.weak > 0 and left not in model.labels
        counts = {r["other"]: (r["rejected"], r["n"]) for r in langid.predict(docs.where(held), model).groupBy((F.col("lang") == left).alias("other")).agg(F.count_if("rejected").alias("rejected"), F.count("*").alias("n")).collect()}
        assert counts[True][0] >= 0.8 * counts[True][1] and counts[False][0] <= 0.02 * counts[False][1]
    two = langid.train(docs.where("lang in ('en', 'es')"), sample_rows=200, calibration_rows=100)
    assert two.labels == ["en", "es"] and two.weak == -float("inf")


def test_lm_histories_tell_words_apart():
    """Two words of one class give different histories, and another token of one class another share of it."""
    ids, sizes = np.array([0, 2, 1, 2], np.uint32), np.array([2, 2])
    symbols = np.array([maxent.TOP + 1, maxent.TOP + 2, 0], np.int32)
    history, c, last = maxent._histories(ids, sizes, np.full(3, maxent.TOP, np.int32), symbols)
    assert history[0] == history[2] and history[1] != history[3] and last.tolist() == [0, maxent.TOP + 1, 0, maxent.TOP + 2]
    rng = np.random.default_rng(1)
    weights, squares, met = np.zeros((maxent.FEATURES, maxent.CLASSES), np.float32), np.zeros((maxent.FEATURES, maxent.CLASSES), np.float32), np.zeros(maxent.FEATURES)
    long, kinds = np.tile(history[[1, 3]], 500), np.tile(np.array([3, 4], np.int32), 500)  # the word before decides, the classes are equal
    for _ in range(20):
        maxent._descend(weights, squares, met, long, kinds, rng, 0.15, 2)
    assert (maxent._class_scores(weights, long[:2], kinds[:2]) > np.log10(0.9)).all()


def test_lm_pairs_are_a_distribution_and_learn():
    import pyarrow as pa

    side, of = 4, np.array([0, maxent.TOP, maxent.TOP, maxent.TOP])
    share = np.array([0, 0.2, 0.3, 0.1])  # 0.4 of the class is other tokens
    n, sums = np.zeros((side, side), np.int64), np.zeros((side, maxent.CLASSES), np.int64)
    n[1], sums[1, maxent.TOP] = (0, 5000, 100, 0), 10_000
    batch = pa.RecordBatch.from_pydict({"block": pa.array([0], pa.int32()), "pairs": [n.tobytes()], "sums": [sums.tobytes()]})
    got = next(maxent._fit_pairs(iter([batch]), share, of))
    weights = np.frombuffer(got.column(1)[0].as_py(), np.float32).reshape(side, side)
    z = np.exp(np.frombuffer(got.column(2)[0].as_py(), np.float32).reshape(side, -1)[1, maxent.TOP])
    p = share * np.exp(weights[1])
    assert abs((p[1:].sum() + 0.4) / z - 1) < 1e-4 and abs(p[1] / z - 0.5) < 0.01 and p[2] / z < 0.02 and (weights[0] == 0).all()


def test_lm_words_help(spark):
    """A text whose words follow each other as in training scores better than the same words in another order."""
    rows = [(i, " ".join(["alpha1 beta1", "gamma1 delta1", *(f"w{i % 97}x{k}" for k in range(40))][:: 1 if i % 2 else -1]), True) for i in range(400)]
    rows += [(1000, "alpha1 beta1 gamma1 delta1", False), (1001, "beta1 delta1 alpha1 gamma1", False)]
    got = {r["doc_id"]: r for r in maxent.lm_scores(spark.createDataFrame(rows, "doc_id long, text string, t boolean"), train=F.col("t")).collect()}
    assert abs(got[1000]["base_score"] - got[1001]["base_score"]) < 1e-9 and got[1000]["score"] > got[1001]["score"] + 1


def test_bpe_keeps_what_was_met_lately():
    """At the bound a run that comes again and again is encoded once, and ids and decoded text stay those of the whole text."""
    coder = bpe.RunEncoder(bpe.BpeModel.load(PATH), limit=20_000)
    merged = []
    merge = coder.model.merge
    coder.model.merge = lambda piece: merged.append(piece) or merge(piece)
    text = b" ".join(b"common %s, x\xc3\xa9%d" % (bytes([97 + i % 26, 97 + i // 26 % 26, 97 + i // 676]), i) for i in range(500))
    parts = [coder.both(part) for part in (text[:3000], text[3000:].strip(), b"", b" \t")]
    assert merged.count(b"common") == 1 and len(merged) > 400
    for data, (ids, decoded) in zip((text[:3000], text[3000:].strip(), b"", b" \t"), parts):
        assert coder.text(data) == ids and coder.model.decode(np.frombuffer(ids, "<u4").tolist()).encode() == decoded


def test_lm_chunks_are_small_and_read_one_by_one(spark):
    """A file of several chunks has a row group for each, of a few MB; tokens beyond 16 bits of a chunk's numbers stay what they are."""
    import glob

    import pyarrow.parquet as pq

    rng, known = np.random.default_rng(3), set(glob.glob(f"{shared_dir(spark)}/plumbline-lm-chunks-*"))
    words = rng.integers(0, 150_000, (23, 100_000))
    docs = spark.createDataFrame([(i, " ".join(map(str, w))) for i, w in enumerate(words.tolist())], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in maxent.lm_scores(docs, train=F.col("doc_id") < 20).collect()}
    counts = np.bincount(words[:20].ravel(), minlength=150_000)
    n, v = counts.sum() + 20, (counts > 0).sum() + 1
    log = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    for i, w in enumerate(words):
        base = log(counts[w]).sum() + log(20)
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (100_001, (counts[w] > 0).sum() + 1) and abs(got[i]["base_score"] - base) < 1e-6 * abs(base)
    path = (set(glob.glob(f"{shared_dir(spark)}/plumbline-lm-chunks-*")) - known).pop()
    groups = [f.row_group(k) for p in glob.glob(f"{path}/*.parquet") for f in [pq.ParquetFile(p).metadata] for k in range(f.num_row_groups)]
    assert len(groups) == 3 and all(g.num_rows == 1 and g.total_byte_size < 8 << 20 for g in groups)


def test_lm_training_tokens_of_chunks_come_together(monkeypatch):
    """All training tokens come once, two chunks at a time here; a chunk without any gives none."""
    import pyarrow as pa

    monkeypatch.setattr(maxent, "STEP_TOKENS", 8)
    classes = maxent.Classes(np.arange(3, dtype=np.uint64), np.zeros(maxent.CLASSES), np.zeros(maxent.CLASSES))
    sizes, endings, expected, rows = np.array([3, 2, 4]), np.zeros(70_000, np.uint8), [], []
    for chunk, trains in enumerate([[True, False, True], [False] * 3, [False, True, True], [True, True, False]]):
        vocab, ids = np.arange(70_000, dtype=np.uint64), np.array([0, 1, 65_534, 65_535, 2, 65_536, 69_999, 0, 1], np.uint32) if chunk % 2 else np.array([2, 1, 0, 5, 0, 1, 1, 65_535, 2], np.uint32)
        low, wide = maxent._packed(ids)
        assert maxent._unpacked(low, wide).tolist() == ids.tolist() and len(low) == 18
        symbols = classes.symbols(vocab)
        history, c, _ = maxent._histories(ids, sizes, classes.of(symbols, endings), symbols)
        keep = np.repeat(trains, sizes)
        expected.append((history[keep].tolist(), c[keep].tolist()))
        rows.append({"chunk": chunk, "sizes": sizes.tolist(), "trains": trains, "ids": low, "wide": wide, "vocab": vocab.tobytes(), "endings": endings.tobytes()})
    got = [(k, h.tolist(), c.tolist()) for k, h, c in maxent._learnt(iter(pa.Table.from_pylist(rows).to_batches(max_chunksize=3)), classes)]
    both = [expected[0][x] + expected[1][x] + expected[2][x] for x in (0, 1)]
    assert got == [(0, *both), (3, *expected[3])]
