"""Scopes in files: symbols, runs, spans, parents, nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.tables import written


def carried(rows: DataFrame, by: str, no: str, last: dict[str, Column], counts: dict[str, Column], ahead: dict[str, Column], size: int = 1 << 16) -> DataFrame:
    """rows with what is carried along each key's order of no (a whole number), however many rows a key has.

    last: the last value up to a row that is not null; counts: how often a condition held up to a row; ahead: the first
    value behind a row that is not null. A segmented scan: blocks of size places are scanned apart, and each gets the
    state of the blocks before (or behind) it, one row for each block; so one huge key is many tasks. A null key is one.
    """
    values = [*last.values(), *counts.values(), *ahead.values()]
    cols = [f"_v{i}" for i in range(len(values))]
    kinds = ["last"] * len(last) + ["count"] * len(counts) + ["ahead"] * len(ahead)
    marked = rows.select("*", F.expr(f"`{no}` div {size}").alias("_block"), *[v.alias(c) for v, c in zip(values, cols)])
    place = lambda c: F.when(F.col(c).isNotNull(), F.col(no))
    ends = {"last": lambda c: F.max_by(c, place(c)), "count": lambda c: F.count_if(F.col(c)), "ahead": lambda c: F.min_by(c, place(c))}
    blocks = marked.groupBy(F.col(by).alias("_by"), F.col("_block").alias("_at")).agg(*[ends[k](c).alias(c) for k, c in zip(kinds, cols)])
    order = Window.partitionBy("_by").orderBy("_at")
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    outer = {"last": lambda c: F.last(c, ignorenulls=True).over(before), "count": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)), "ahead": lambda c: F.first(c, ignorenulls=True).over(behind)}
    states = blocks.select("_by", "_at", *[outer[k](c).alias(f"{c}s") for k, c in zip(kinds, cols)])
    own = Window.partitionBy(by, "_block").orderBy(no)
    upto, after = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(1, Window.unboundedFollowing)
    inner = {"last": lambda c: F.last(c, ignorenulls=True).over(upto), "count": lambda c: F.count_if(F.col(c)).over(upto), "ahead": lambda c: F.first(c, ignorenulls=True).over(after)}
    local = marked.select("*", *[inner[k](c).alias(f"{c}l") for k, c in zip(kinds, cols)])
    joined = local.join(states, F.col(by).eqNullSafe(F.col("_by")) & F.col("_block").eqNullSafe(F.col("_at")))
    found = [(F.col(f"{c}l") + F.col(f"{c}s") if k == "count" else F.coalesce(f"{c}l", f"{c}s")).alias(n) for n, k, c in zip([*last, *counts, *ahead], kinds, cols)]
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *found)


def symbol_ordinals(functions: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """Adds symbol: the name, with #n from its second occurrence on."""
    n = F.row_number().over(Window.partitionBy(*by, name).orderBy(*order))
    return functions.withColumn("symbol", F.when(n > 1, F.concat(F.col(name), F.lit("#"), n.cast("string"))).otherwise(F.col(name)))


def sequence_changes(rows: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """(by, changes): how often value differs from the one before it."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(*order))
    return rows.select(by, (F.col(value) != before).alias("c")).groupBy(by).agg(F.count_if(F.coalesce("c", F.lit(False))).alias("changes"))


def runs_between(rows: DataFrame, by: str, is_border: Column, order: list[str]) -> DataFrame:
    """(by, run, rows) of the stretches between border rows, which belong to none."""
    run = F.sum(F.col("_border").cast("long")).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.select(by, *[c for c in order if c != by], is_border.alias("_border")).withColumn("run", run)
    return marked.where(~F.col("_border")).groupBy(by, "run").agg(F.count("*").alias("rows"))


def _position(df: DataFrame, name: str) -> Column:
    """A place as a long: integers as they are, dates and timestamps in microseconds."""
    kind = df.schema[name].dataType.typeName()
    return F.unix_micros(F.col(name).cast("timestamp")) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(name).cast("long")


def _covered_blocks(spans: DataFrame, by: str, rank: Column) -> tuple[DataFrame, Column]:
    """((_by, _level, _block, _rank), levels): the aligned blocks of 2^level places that make up spans, each with its least rank, a written table, and the levels there are."""
    level = F.col("_level").cast("int")
    ends = spans.select("*", F.col(by).alias("_by"), _position(spans, "start").alias("_lo"), (_position(spans, "stop") + 1).alias("_hi")).where("_lo < _hi and _by is not null")
    cut = ends.select("*", F.explode(F.expr("sequence(0, cast(ceil(log2(_hi - _lo)) as int))")).alias("_level"))
    # the bounds in blocks of this level, and the blocks at the bounds that no block of a higher level takes in
    first = F.call_function("shiftright", F.col("_lo") + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
    cut = cut.select("*", first.alias("_first"), F.call_function("shiftright", F.col("_hi"), level).alias("_end")).where("_first < _end")
    blocks = F.expr("filter(array(if(_first & 1 = 1, _first, null), if(_end & 1 = 1, _end - 1, null)), b -> b is not null)")
    covered = cut.select("_by", "_level", F.explode(blocks).alias("_block"), rank.alias("_rank")).groupBy("_by", "_level", "_block").agg(F.min("_rank").alias("_rank"))
    covered = written(covered, "blocks")
    levels = [r["_level"] for r in covered.select("_level").distinct().collect()]  # at most 64
    return covered, F.array(*[F.lit(n) for n in levels] or [F.lit(0)])


def enclosing_span(points: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """points (by, point_id, at) with the innermost span (by, span_id, start, stop) around each: of equal extents the smallest id.

    Places are integers, dates or timestamps; both ends belong to a span. Points in no span are left out, and so is
    what has a null key, id or place, or a stop before its start; repeated rows count once.
    A span is cut into the aligned blocks of 2^level places that make it up (at most two a level), and of all spans with
    the same block only the innermost is kept; a point looks up its block of each level. So a key with any number of
    spans and points is an equi-join of many blocks, not of all its pairs.
    """
    rank = F.struct((F.col("_hi") - F.col("_lo")).alias("extent"), F.col("span_id").alias("id"))
    covered, levels = _covered_blocks(spans.where("span_id is not null"), by, rank)
    level = F.col("_level").cast("int")
    own = points.select(F.col(by).alias("_by"), "point_id", _position(points, "at").alias("_at"), F.explode(levels).alias("_level"))
    own = own.select("_by", "point_id", "_level", F.call_function("shiftright", F.col("_at"), level).alias("_block"))
    found = own.join(covered, ["_by", "_level", "_block"]).where("point_id is not null")
    return found.groupBy(F.col("_by").alias(by), "point_id").agg(F.min("_rank")["id"].alias("span_id"))


def prefix_parent(symbols: DataFrame) -> DataFrame:
    """(symbol, parent): the longest proper dotted prefix that is a symbol too, or null."""
    own = symbols.select("symbol").distinct()
    parts = F.split("symbol", r"\.")
    prefixes = own.select("symbol", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("prefix")).where(F.size(parts) > 1)
    found = prefixes.join(own.withColumnRenamed("symbol", "prefix"), "prefix").groupBy("symbol").agg(F.max_by("prefix", F.length("prefix")).alias("parent"))
    return own.join(found, "symbol", "left")


def nesting_depth(opened: Column) -> Column:
    """The most that are open at once; opened is an array of booleans (opens or closes)."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, is_open):
        now = F.when(is_open, acc["now"] + 1).otherwise(acc["now"] - 1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(opened, zero, step)["most"]


def outside_spans(points: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """points (by, at, ...) that lie in none of the spans (by, start, stop), whose ends belong to them.

    Points with a null key or place stay, spans with a null are in no one's way; repeated points stay as often as they come.
    Whole numbers, dates and times are looked up in aligned blocks of places, so a key with any number of points and spans
    is many rows of an equi-join. Other places are swept in one sort of each key's points and spans.
    """
    exact = {"byte", "short", "integer", "long", "date", "timestamp", "timestamp_ntz"}
    if all(df.schema[c].dataType.typeName() in exact for df, c in ((points, "at"), (spans, "start"), (spans, "stop"))):
        covered, levels = _covered_blocks(spans, by, F.lit(0))
        places = points.select(F.col(by).alias("_by"), F.col("at").alias("_place"), _position(points, "at").alias("_at")).where("_by is not null and _at is not null").distinct()
        own = places.select("*", F.explode(levels).alias("_level")).withColumn("_block", F.call_function("shiftright", F.col("_at"), F.col("_level").cast("int")))
        inside = own.join(covered, ["_by", "_level", "_block"], "left_semi").select("_by", "_place").distinct()
        return points.join(inside, (points[by] == inside["_by"]) & (points["at"] == inside["_place"]), "left_anti")
    kind = points.schema["at"].dataType
    row = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    events = points.select(F.col(by).alias("_by"), F.col("at").alias("_at"), F.lit(1).alias("_is_point"), F.lit(None).cast(spans.schema["stop"].dataType).alias("_stop"), row.alias("_row"))
    known = spans.where(F.col(by).isNotNull() & F.col("start").isNotNull() & F.col("stop").isNotNull())
    begun = known.select(F.col(by).alias("_by"), F.col("start").cast(kind).alias("_at"), F.lit(0).alias("_is_point"), F.col("stop").alias("_stop"), F.lit(None).cast(events.schema["_row"].dataType).alias("_row"))
    upto = Window.partitionBy("_by").orderBy("_at", "_is_point").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.unionByName(begun).withColumn("_open", F.max("_stop").over(upto))
    return swept.where((F.col("_is_point") == 1) & ~F.coalesce(F.col("_open") >= F.col("_at"), F.lit(False))).select("_row.*")


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, place) in the order in which the values come first, from 0; a null value is one of them.

    Ranges of the order are numbered apart, and each is moved by the number of values before it; only these numbers,
    one for each range, meet in one task.
    """
    ranges = rows.groupBy(value).agg(F.min(order).alias("_first")).repartitionByRange("_first", value)
    dealt = written(ranges.withColumn("_range", F.spark_partition_id()), "first-seen")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_first", value))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").select(value, (F.col("_own") - 1 + F.col("_before")).cast("int").alias("place"))
