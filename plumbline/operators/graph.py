"""Module graphs: coupling, first lines, cycles, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import glob_regex
from plumbline.operators.tables import counted, shared_values, written


def edges_of(imports: DataFrame) -> DataFrame:
    """imports (src, dst, line, ord) -> one row (src, dst, line) an edge; line is that of the first import seen."""
    return imports.where("dst is not null").groupBy("src", "dst").agg(F.min_by("line", "ord").alias("line"))


def fan_metrics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, fan_out, fan_in): distinct targets and distinct sources; nodes without edges have 0."""
    one = edges.select("src", "dst").distinct()
    ends = one.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(one.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    all_nodes = ends.unionByName(nodes.select("node", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return all_nodes.groupBy("node").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in")).join(nodes.select("node").distinct(), "node", "left_semi")


def _spread(links: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (node, label): each node gets the smallest label from which links (a -> b) lead to it."""
    while True:
        moved = links.join(labels, links["a"] == labels["node"]).select(F.col("b").alias("node"), "label")
        new = written(labels.unionByName(moved).groupBy("node").agg(F.min("label").alias("label")), "labels")
        changed = new.join(labels, "node").where(new["label"] < labels["label"]).limit(1).count()
        labels = new
        if not changed:
            return labels


def _trimmed(left: DataFrame) -> tuple[DataFrame, int]:
    """Links whose ends both have links in and out, and how many."""
    starts, stops = left.select(F.col("b").alias("a")).distinct(), left.select(F.col("a").alias("b")).distinct()
    return counted(left.join(starts, "a", "left_semi").join(stops, "b", "left_semi"), "edges")


def _contracted(left: DataFrame) -> tuple[DataFrame, int, DataFrame, DataFrame] | None:
    """(links, their number, lines, rings) with nodes that have one link in and one out taken out, or None if there are none.

    A line has (node, u, w): the nearest other nodes before and behind it; the node is in a cycle if u and w are in one, and
    a link u -> w stands for the line. A ring, which has no other nodes, is a component itself: (node, label). Pointers
    to both sides jump twice as far each round, so a line of n nodes takes log2(n) rounds.
    """
    ends = left.select(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(left.select(F.col("b").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    single = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o = 1 and i = 1").select("node")
    state = single.join(left.select(F.col("a").alias("node"), F.col("b").alias("w")), "node").join(left.select(F.col("b").alias("node"), F.col("a").alias("u")), "node")
    state, now = counted(state.select("node", "u", "w", F.col("node").alias("low"), F.lit(True).alias("open")), "lines")
    if not now:
        return None
    single, was, reach = state.select("node"), None, 1
    while True:
        ahead = state.select(F.col("node").alias("w"), F.col("w").alias("_w"), F.col("low").alias("_low"))
        back = state.select(F.col("node").alias("u"), F.col("u").alias("_u"))
        far = state.join(ahead, "w", "left").join(back, "u", "left")
        state = written(far.select("node", F.coalesce("_u", "u").alias("u"), F.coalesce("_w", "w").alias("w"), F.least("low", "_low").alias("low"), F.col("_w").isNotNull().alias("open")), "lines")
        now, reach = state.where("open").count(), 2 * reach
        if not now or (now == was and reach >= now):  # what still has a pointer to its like is a ring
            break
        was = now
    lines = state.where("not open").select("node", "u", "w")
    rest = left.join(single.withColumnRenamed("node", "a"), "a", "left_anti").join(single.withColumnRenamed("node", "b"), "b", "left_anti")
    links = rest.select("a", "b").unionByName(lines.where("u <> w").select(F.col("u").alias("a"), F.col("w").alias("b"))).distinct()
    return *counted(links, "edges"), lines, state.where("open").select("node", F.col("low").alias("label"))


def _core(left: DataFrame) -> DataFrame:
    """(node, label) of some components of a graph by colouring.

    The smallest label spreads forwards; what reaches a label's own node backwards within its colour is that node's
    component. Each label finds one component, so many come out at once.
    """
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    colour = _spread(left, nodes.withColumn("label", F.col("node")))
    a, b = colour.select(F.col("node").alias("a"), F.col("label").alias("ca")), colour.select(F.col("node").alias("b"), F.col("label").alias("cb"))
    inside = written(left.join(a, "a").join(b, "b").where("ca = cb").select("a", "b", "ca"), "edges")
    back = inside.select(F.col("b").alias("a"), F.col("a").alias("b"))
    reach, size = counted(colour.where("node = label"), "reach")
    while True:
        more = back.join(reach.select(F.col("node").alias("a"), "label"), "a").select(F.col("b").alias("node"), "label")
        reach, now = counted(reach.unionByName(more).distinct(), "reach")
        if now == size:
            return reach
        size = now


#: Trimming, and then contraction, go on while a round takes away such a part of the links.
WORTH = 0.1


def _reduced(left: DataFrame, size: int) -> tuple[DataFrame, int, list[DataFrame], list[DataFrame]]:
    """(links, their number, lines, rings): trimmed and contracted as long as that is worth it."""
    lines, rings = [], []
    while size:
        begun = size
        while size:
            was = size
            left, size = _trimmed(left)
            if size > was * (1 - WORTH):
                break
        shorter = _contracted(left) if size else None
        if shorter is None:
            break
        left, size, line, ring = shorter
        lines.append(line)
        rings.append(ring)
        if size > begun * (1 - WORTH):
            break
    return left, size, lines, rings


def components(edges: DataFrame) -> DataFrame:
    """(component, member) of each strongly connected component of two nodes or more; component is the smallest member.

    Nodes without a link in or out are trimmed, and lines and rings of nodes with one link each way are contracted, in
    turn while that takes away a good part of the links; so long chains and rings of n nodes take log2(n) rounds and not
    n. What is left is coloured. Every round is a written table. A null end or a link to itself counts for nothing.
    """
    left, size = counted(edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "edges")
    found, taken = left.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0), []
    while size:
        left, size, lines, rings = _reduced(left, size)
        taken += lines
        for ring in rings:
            found = found.unionByName(ring)
        if not size:
            break
        reach = _core(left)
        found = written(found.unionByName(reach), "components")
        out = reach.select("node")
        left, size = counted(left.join(out.withColumnRenamed("node", "a"), "a", "left_anti").join(out.withColumnRenamed("node", "b"), "b", "left_anti"), "edges")
    # a node that is alone in its colour has no cycle there; a line that begins and ends at it gives it one
    found = written(found.join(found.groupBy("label").count().where("count > 1").select("label"), "label", "left_semi").select("node", "label"), "components")
    for lines in reversed(taken):
        label = lambda name: found.select(F.col("node").alias(name), F.col("label").alias(f"_{name}"))  # noqa: E731, B023
        both = lines.join(label("u"), "u", "left").join(label("w"), "w", "left")
        own = F.when(F.col("u") == F.col("w"), F.coalesce("_u", "u")).when(F.col("_u") == F.col("_w"), F.col("_u"))
        new = written(both.select("node", "u", F.col("_u").isNull().alias("alone"), own.alias("label")).where("label is not null"), "components")
        found = written(found.unionByName(new.select("node", "label")).unionByName(new.where("alone").select(F.col("u").alias("node"), "label").distinct()), "components")
    smallest = found.groupBy("label").agg(F.min("node").alias("component"))
    return found.join(smallest, "label").select("component", F.col("node").alias("member"))


def cycle_keys(found: DataFrame) -> DataFrame:
    """found of components() -> (component, cycle_key, members), a row for each. A cycle's key names all its members."""
    named = found.groupBy("component").agg(F.sort_array(F.collect_set(F.col("member").cast("string"))).alias("m"))
    return named.select("component", F.array_join("m", "|").alias("cycle_key"), F.size("m").cast("long").alias("members"))


#: A large cycle's members are dealt in so many pieces, each of which takes the key along.
PIECES = 48


def cycles(edges: DataFrame) -> DataFrame:
    """(cycle_key, members, member) of each strongly connected component of two or more nodes, a row for each member.

    All rows of a cycle have its key, so n members take n times the key, which the result has to be written as: the rows
    are made in many tasks from few copies of the key, and Parquet keeps it once a file.
    """
    spark = edges.sparkSession
    named = written(components(edges).groupBy("component").agg(F.sort_array(F.collect_set(F.col("member").cast("string"))).alias("m")), "cycles")
    key = F.array_join("m", "|")
    shared_values(spark, named.agg(F.sum(F.octet_length(key) + 4)).first()[0] or 0, "cycle_key")
    step = F.greatest(F.lit(64), F.ceil(F.size("m") / PIECES)).cast("int")
    firsts = F.sequence(F.lit(1), F.size("m"), step)
    keys = named.select("component", F.explode(firsts).alias("first"), key.alias("cycle_key"), F.size("m").cast("long").alias("members"))
    parts = named.select("component", F.explode(F.transform(firsts, lambda at: F.struct(at.alias("first"), F.slice("m", at, step).alias("part")))).alias("p"))
    parts = parts.select("component", "p.first", F.explode("p.part").alias("member"))
    # a merge join makes one wide row at a time, where a generator would hold those of a piece, and keeps to the parts it is given
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    on = ["component", "first"]
    return parts.repartition(n, *on).join(keys.repartition(n, *on).hint("merge"), on).select("cycle_key", "members", "member")


def external_diagnostic(imports: DataFrame) -> DataFrame:
    """imports (resolution) -> one row (code, severity, message) if any is external, else none."""
    count = imports.agg(F.count_if(F.col("resolution") == "external").alias("n")).where("n > 0")
    return count.select(F.lit("dependency.external_not_analyzed").alias("code"), F.lit("info").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" imports are external")).alias("message"))


def owner(path: Column, layers: list[tuple[str, list[str]]]) -> Column:
    """The first layer, in the order of declaration, with a pattern that matches the path; null without one."""
    out = F.lit(None).cast("string")
    for name, patterns in reversed(layers):
        out = F.when(path.rlike("|".join(glob_regex(p) for p in patterns)), F.lit(name)).otherwise(out)
    return out


def layer_violations(edges: DataFrame, owners: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """edges (src, dst, ...) whose layers may not depend on each other; a layer lists itself to use itself.

    owners is (node, layer); edges with an end that no layer owns are skipped.
    """
    listed = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*[F.lit(d) for d in v]).cast("array<string>"))]) if allowed else F.create_map().cast("map<string,array<string>>")
    own = lambda end: owners.select(F.col("node").alias(end), F.col("layer").alias(f"{end}_layer")).where(F.col("layer").isNotNull())
    return edges.join(own("src"), "src").join(own("dst"), "dst").where(~F.coalesce(F.array_contains(listed[F.col("src_layer")], F.col("dst_layer")), F.lit(False)))
