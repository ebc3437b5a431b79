"""The Merkle manifest against a recursion over lists."""

import hashlib
import random

from pyspark.sql import functions as F

from plumbline.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """(root, the proof of each leaf) by whole levels."""
    proofs, at, level = [""] * len(leaves), list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, a in enumerate(at):
            first = a // 16 * 16
            proofs[i] += "".join(level[first:a] + level[a + 1 : first + 16])
        level, at = [h("".join(level[i : i + 16])) for i in range(0, len(level), 16)], [a // 16 for a in at]
    return level[0], proofs


def expected(rows):
    """rows (id, group, leaf) -> {(group, id, leaf): (subroot, root, proof)}"""
    groups = sorted({g for _, g, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    members = {g: sorted(((i, d) for i, x, d in rows if x == g), key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for g in groups}
    trees = {g: tree([d for _, d in members[g]]) for g in groups}
    root, upper = tree([trees[g][0] for g in groups])
    return sorted((str(g), str(i), d, trees[g][0], root, p + u) for g, u in zip(groups, upper) for (i, d), p in zip(members[g], trees[g][1]))


def got(out):
    return sorted((str(r["g"]), str(r["id"]), r["leaf"], r["subroot"], r["root"], r["proof"]) for r in out.collect())


def test_manifest_equals_the_recursion(spark):
    r = random.Random(3)
    rows = [(i, "big", h(f"b{i}")) for i in range(700)] + [(r.randrange(50), r.choice(["a", "é", "Z", "z", None, ""]), h(f"s{i}")) for i in range(300)]
    rows += [(None, "a", h("null id")), (7, "a", h("same")), (7, "a", h("same")), (5, "alone", h("one"))] + [(1, f"g{i}", h(f"g{i}")) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, g string, leaf string").withColumn("proof", F.lit("mine")).withColumn("n", F.lit(1))
    for levels in (1, 3):  # of 16 and of 4,096 leaves a block
        out = merkle.manifest(df, "g", ["id"], levels=levels)
        assert got(out) == expected(rows)
        assert out.columns == ["id", "g", "leaf", "n", *merkle.MADE]
    checked = merkle.folded(out, F.col("leaf")).collect()
    assert len(checked) == len(rows) and all(x["folded_root"] == x["root"] for x in checked)
    false = merkle.folded(out, F.lit(h("other")), "other").collect()
    assert all(x["other"] != x["root"] for x in false)
    assert merkle.folded(out.limit(1), F.lit(None).cast("string")).first()["folded_root"] is None


def test_empty_one_row_and_equal_rows(spark):
    kind = "id long, g string, leaf string"
    assert merkle.manifest(spark.createDataFrame([], kind), "g", ["id"]).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, None, h("x"))], kind), "g", ["id"]).first()
    assert (one["subroot"], one["root"], one["proof"], one["size"], one["groups"]) == (h("x"), h("x"), "", 1, 1)
    rows = [(4, "s", h("copy"))] * 50
    assert got(merkle.manifest(spark.createDataFrame(rows, kind), "g", ["id"], levels=1)) == expected(rows)


def test_leaf(spark):
    df = spark.createDataFrame([(1, "né", None), (None, "", "x" * 100_000)], "id long, a string, b string")
    assert [r[0] for r in df.select(merkle.leaf(F.col("id"), F.col("a"), F.col("b"))).collect()] == [h("1:13:né-"), h("-0:100000:" + "x" * 100_000)]
