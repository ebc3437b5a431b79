"""The engine's operators over the given tables, and DuckDB SQL for each.

documents are source files (path: source/lang/doc_id), conversations files with functions, lineitem rows imports,
nations modules and regions their layers, events runs and logs, orders before and after a date two snapshots.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import clones, compare, coverage, files, graph, policy, resolve, scopes, worklist
from plumbline.operators.tables import shared_dir, spread
from plumbline.plans import report
from plumbline.plans.check import FUNCTION_METRICS, function_measurements, python_facts
from plumbline.sources import baseline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("code"), "lang", "doc_id")


DOCS = "(select concat_ws('/', source, lang, cast(doc_id as varchar)) as path, text as code, lang, doc_id from documents)"
TOKENS = r"list_filter(regexp_split_to_array(code, '[ \t\n\x0B\f\r]+'), lambda t: t <> '')"
NONBLANK = r"cast(len(list_filter(string_split(code, chr(10)), lambda l: regexp_matches(l, '[^ \t\x0B\f\r]'))) as bigint)"


@query("select coalesce(lower(lang), 'Unknown') as language, count(*) as files from documents group by 1")
def q_language_scope(spark, d):
    return files.language_histogram(documents(spark, d), "lang")


@query(f"select path, {NONBLANK} as lines from {DOCS}")
def q_nonblank_lines(spark, d):
    return documents(spark, d).select("path", S.nonblank_lines(F.col("code")).alias("lines"))


@query(f"with t as (select path, cast(len({TOKENS}) as bigint) as n from {DOCS}) select 'file' as scope, path as key, n as tokens from t union all select 'repository', 'repository', cast(coalesce(sum(n), 0) as bigint) from t")
def q_file_tokens_total(spark, d):
    return files.token_totals(documents(spark, d))


@query(f"""with f as (select path, sha256(code) as hash, doc_id from {DOCS}), cur as (select hash, min(path) as path from f where doc_id % 2 = 1 group by hash having count(*) = 1)
    select p.path as previous_path, cur.path as path from f p join cur using (hash) where p.doc_id % 2 = 0""")
def q_file_hash_renames(spark, d):
    hashed = documents(spark, d).select("path", F.sha2("code", 256).alias("hash"), "doc_id")
    return compare.infer_renames(hashed.where("doc_id % 2 = 1"), hashed.where("doc_id % 2 = 0"))


@query("""select conv_id, turn, case when n > 1 then role || '#' || n else role end as symbol from
    (select conv_id, turn, role, row_number() over (partition by conv_id, role order by turn) as n from conversations)""")
def q_symbol_ordinals(spark, d):
    return scopes.symbol_ordinals(table(spark, d, "conversations"), ["conv_id"], "role", ["turn"]).select("conv_id", "turn", "symbol")


@query("""select user_id, count(*) filter (where event_type <> before) as changes from
    (select user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) group by user_id""")
def q_symbol_sequence_changes(spark, d):
    return scopes.sequence_changes(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


#: metric, enabled, threshold, severity, blocking
POLICIES = [("orders.count", True, 12.0, "error", True), ("orders.cents", True, 250_000_000.0, "warning", False), ("orders.urgent", True, 4.0, "error", True), ("orders.open", False, 1.0, "warning", False)]


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "metric string, enabled boolean, threshold double, severity string, blocking boolean")


def order_measurements(orders: DataFrame) -> DataFrame:
    sums = orders.groupBy("o_custkey").agg(
        F.count("*").cast("double").alias("orders.count"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("orders.cents"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("orders.urgent"),
        F.count_if(F.col("o_orderstatus") == "O").cast("double").alias("orders.open"),
    )
    names = ["orders.count", "orders.cents", "orders.urgent", "orders.open"]
    return sums.unpivot(["o_custkey"], [f"`{n}`" for n in names], "metric", "value").select(F.col("metric"), F.concat(F.lit("customer::"), F.col("o_custkey").cast("string")).alias("key"), "value")


_POLICY_ROWS = ", ".join(f"('{m}', {str(e).lower()}, {t!r}, '{s}', {str(b).lower()})" for m, e, t, s, b in POLICIES)


def _measures_sql(orders: str) -> str:
    return f"""select metric, 'customer::' || o_custkey as key, value from (unpivot (select o_custkey, cast(count(*) as double) as "orders.count", cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) as "orders.cents",
        cast(count(*) filter (where o_orderpriority = '1-URGENT') as double) as "orders.urgent", cast(count(*) filter (where o_orderstatus = 'O') as double) as "orders.open" from {orders} group by o_custkey)
        on "orders.count", "orders.cents", "orders.urgent", "orders.open" into name metric value value)"""


def _findings_sql(orders: str = "orders") -> str:
    return f"""select substr(sha256(m.metric || chr(0) || m.key), 1, 20) as finding_id, m.metric as rule, m.key, m.value as current, p.threshold, p.severity, p.blocking,
        m.metric || ' is ' || cast(m.value as bigint) || '; the limit is ' || cast(p.threshold as bigint) as message
        from ({_measures_sql(orders)}) m join (values {_POLICY_ROWS}) p(metric, enabled, threshold, severity, blocking) on m.metric = p.metric and p.enabled and m.value > p.threshold"""


@query(_findings_sql())
def q_policy_findings(spark, d):
    return policy.threshold_findings(order_measurements(table(spark, d, "orders")), policies(spark))


@query(f"select case when count(*) filter (where blocking) > 0 then 'failed' else 'passed' end as status, count(*) filter (where blocking) as blocking, count(*) filter (where not blocking) as warnings from ({_findings_sql()})")
def q_gate(spark, d):
    return policy.gate(q_policy_findings(spark, d))


@query("""with e as (select user_id, event_type, ts < timestamp '2024-01-15' as old from events), c as (select user_id, event_type, count(*) as value from e where not old group by all), p as (select user_id, event_type, count(*) as baseline from e where old group by all)
    select user_id, event_type, value, baseline, value - baseline as delta, case when value > baseline then 'worsened' when value < baseline then 'improved' when value = baseline then 'existing' end as classification from c left join p using (user_id, event_type)""")
def q_compare_measurements(spark, d):
    old = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    counts = lambda rows: rows.groupBy("user_id", "event_type").agg(F.count("*").alias("value"), F.max("ts").alias("ord"))
    events = table(spark, d, "events")
    return compare.compare_measurements(counts(events.where(~old)).drop("ord"), counts(events.where(old)), ["user_id", "event_type"])


_SPLIT = "timestamp '1997-01-01'"


@query(f"""with c as ({_findings_sql(f"(select * from orders where o_orderdate >= {_SPLIT})")}), p as ({_findings_sql(f"(select * from orders where o_orderdate < {_SPLIT})")})
    select rule, key, c.current, p.current as baseline, case when c.rule is null then -p.current else c.current - p.current end as delta,
    case when c.rule is null then 'resolved' when p.rule is null then 'new' when c.current - p.current > 0 then 'worsened' else 'existing' end as classification from c full join p using (rule, key)""")
def q_compare_findings(spark, d):
    orders = table(spark, d, "orders")
    old = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    found = lambda rows: policy.threshold_findings(order_measurements(rows), policies(spark)).select("rule", "key", "current")
    return compare.compare_findings(found(orders.where(~old)), found(orders.where(old)), ["rule", "key"])


def supply(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers import parts; the order of the rows is that of the orders."""
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_linenumber").alias("line"), F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("ord"))


@query("""with e as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem), n as (select 's' || s_suppkey as node from supplier union all select 'p' || p_partkey from part)
    select node, (select count(*) from e where src = node) as fan_out, (select count(*) from e where dst = node) as fan_in from n""")
def q_fan_metrics(spark, d):
    nodes = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node")).union(table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))))
    return graph.fan_metrics(supply(spark, d), nodes)


@query("select 's' || l_suppkey as src, 'p' || l_partkey as dst, arg_min(l_linenumber, {'a': l_orderkey, 'b': l_linenumber, 'c': l_quantity, 'd': l_extendedprice}) as line from lineitem group by all")
def q_first_edge_line(spark, d):
    return graph.edges_of(supply(spark, d))


_STEPS = "select user_id as v, lag(user_id) over w as u, ts - lag(ts) over w as gap from events window w as (partition by event_type, date_trunc('hour', ts) order by ts, event_id)"


@query(f"""with recursive e as (select distinct u, v from ({_STEPS}) where u <> v and gap <= interval 25 second),
    r(a, b) as (select u, v from e union select r.a, e.v from r join e on r.b = e.u),
    c as (select x.a as node, list_sort(list(distinct cast(x.b as varchar))) as m from r x join r y on x.a = y.b and x.b = y.a group by x.a)
    select array_to_string(m, '|') as cycle_key, cast(len(m) as bigint) as members, cast(node as varchar) as member from c where len(m) > 1""")
def q_cycles(spark, d):
    """Users who follow each other within 25 seconds, in the same kind of event and hour."""
    w = "over (partition by event_type, date_trunc('hour', ts) order by ts, event_id)"
    steps = table(spark, d, "events").selectExpr("user_id as dst", f"lag(user_id) {w} as src", f"ts - lag(ts) {w} as gap")
    return graph.cycles(steps.where("src <> dst and gap <= interval '25' second").select("src", "dst"))


@query(f"""with recursive e as (select distinct u, v from ({_STEPS}) where u <> v and gap <= interval 40 second),
    r(a, b) as (select u, v from e union select r.a, e.v from r join e on r.b = e.u),
    c as (select x.a as member, x.b as other from r x join r y on x.a = y.b and x.b = y.a)
    select min(other) as component, member from c group by member having count(*) > 1""")
def q_cycle_components(spark, d):
    """Users who follow each other within 40 seconds."""
    w = "over (partition by event_type, date_trunc('hour', ts) order by ts, event_id)"
    steps = table(spark, d, "events").selectExpr("user_id as dst", f"lag(user_id) {w} as src", f"ts - lag(ts) {w} as gap")
    return graph.components(steps.where("src <> dst and gap <= interval '40' second").select("src", "dst"))


LAYERS = [("english", ["**/en/**"]), ("romance", ["**/{fr,es}/**", "*.example.org/**"]), ("numbered", ["*/*/[0-9]*"]), ("rest", ["*.example.com/**"])]


def page_path(url):
    return F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), "[?#].*$", "")


_PAGE = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
_OWNER = "case " + " ".join("when " + " or ".join(f"regexp_matches(path, '{S.glob_regex(p)}')" for p in ps) + f" then '{n}'" for n, ps in LAYERS) + " end"


@query(f"select page_id, path, {_OWNER} as layer from (select page_id, {_PAGE} as path from pages)")
def q_layer_owner(spark, d):
    return table(spark, d, "pages").select("page_id", page_path(F.col("url")).alias("path")).withColumn("layer", graph.owner(F.col("path"), LAYERS))


ALLOWED = {"AFRICA": ["AFRICA", "EUROPE"], "AMERICA": ["AMERICA", "ASIA", "EUROPE"], "ASIA": ["ASIA"], "EUROPE": ["AFRICA", "AMERICA", "ASIA"]}
_ALLOWED_ROWS = ", ".join(f"('{k}', '{v}')" for k, vs in ALLOWED.items() for v in vs)


@query(f"""with e as (select c.c_nationkey as src, s.s_nationkey as dst, count(*) as line from lineitem join orders on l_orderkey = o_orderkey join customer c on o_custkey = c_custkey join supplier s on l_suppkey = s_suppkey group by all),
    o as (select n_nationkey as node, r_name as layer from nation join region on n_regionkey = r_regionkey)
    select src, dst, line, a.layer as src_layer, b.layer as dst_layer from e join o a on src = a.node join o b on dst = b.node where (a.layer, b.layer) not in (values {_ALLOWED_ROWS})""")
def q_layer_violations(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = joined.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("line"))
    owners = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("node"), F.col("r_name").alias("layer"))
    return graph.layer_violations(edges, owners, ALLOWED).select("src", "dst", "line", "src_layer", "dst_layer")


@query(f"""with t as (select {TOKENS} as t from {DOCS}), w as (select sha256(array_to_string(t[i:i + 49], chr(0))) as fingerprint from (select t, unnest(generate_series(1, len(t) - 49)) as i from t where len(t) >= 50))
    select fingerprint, count(*) as occurrences from w group by 1 having count(*) > 1""")
def q_clone_windows(spark, d):
    return clones.repeated_windows(documents(spark, d), 50)


@query(f"""with lines as (select path, unnest(string_split(code, chr(10))) as code, generate_subscripts(string_split(code, chr(10)), 1) as no from {DOCS}),
    toks as (select path, no, unnest({TOKENS}) as t, generate_subscripts({TOKENS}, 1) as k from lines),
    per as (select path, list(t order by no, k) as t, list(no order by no, k) as n from toks group by path),
    wins as (select path, i as place, n[i] as line, n[i + 49] as end_line, sha256(array_to_string(t[i:i + 49], chr(0))) as h from (select *, unnest(generate_series(1, len(t) - 49)) as i from per where len(t) >= 50) where n[i + 49] - n[i] + 1 >= 5),
    own as (select h, path, list_reduce(list_prepend([]::bigint[], list_transform(list(place order by place), lambda x: [x])), lambda a, b: case when len(a) = 0 or b[1] - a[len(a)] >= 50 then list_append(a, b[1]) else a end) as kept from wins group by h, path),
    rep as (select h from own group by h having sum(len(kept)) > 1),
    cov as (select count(*) as c from (select distinct path, unnest(generate_series(line, end_line)) as line from wins join (select h, path, unnest(kept) as place from own where h in (select h from rep)) using (h, path, place))),
    tot as (select cast(sum({NONBLANK}) as bigint) as t from {DOCS})
    select c as duplicated_lines, t as total_lines, round(c / t * 100.0 * 100) / 100 as density from cov, tot""")
def q_clone_density(spark, d):
    return clones.clone_density(documents(spark, d))


_WINDOWS = f"""lines as (select path, unnest(string_split(code, chr(10))) as code, generate_subscripts(string_split(code, chr(10)), 1) as no from {DOCS}),
    toks as (select path, no, unnest({TOKENS}) as t, generate_subscripts({TOKENS}, 1) as k from lines),
    per as (select path, list(t order by no, k) as t, list(no order by no, k) as n from toks group by path),
    wins as (select path, i as place, sha256(array_to_string(t[i:i + 49], chr(0))) as h from (select *, unnest(generate_series(1, len(t) - 49)) as i from per where len(t) >= 50) where n[i + 49] - n[i] + 1 >= 5),
    own as (select h, path, list_reduce(list_prepend([]::bigint[], list_transform(list(place order by place), lambda x: [x])), lambda a, b: case when len(a) = 0 or b[1] - a[len(a)] >= 50 then list_append(a, b[1]) else a end) as kept from wins group by h, path),
    mem as (select path, place, h, count(*) over (partition by h) as copies from (select h, path, unnest(kept) as place from own) qualify count(*) over (partition by h) > 1)"""


@query(f"""with {_WINDOWS},
    prev as (select m.h, count(*) as n, count(p.h) as known, min(p.h) as low, max(p.h) as high, any_value(p.copies) as before from mem m left join mem p on p.path = m.path and p.place = m.place - 1 group by m.h),
    heads as (select * from mem where h not in (select h from prev where known = n and low = high and before = n)),
    one as (select h, arg_min(path, (path, place)) as path, arg_min(place, (path, place)) as place from heads group by h),
    grown as (select b.h, min(list_position(list_transform(list_zip(x.t[a.place:], y.t[b.place:]), lambda z: coalesce(z[1] = z[2], false)) || [false], false) - 1) as tokens
        from heads b join one a on a.h = b.h join per x on x.path = a.path join per y on y.path = b.path where (a.path, a.place) <> (b.path, b.place) group by b.h)
    select path, place as start, cast(tokens as bigint) as tokens, copies from heads join grown using (h)""")
def q_clone_repeats(spark, d):
    return clones.maximal_repeats(documents(spark, d))


@query()
def q_clone_groups(spark, d):
    """Tested against one long sweep in plain Python; SQL would have to take the windows one after the other."""
    found = clones.clone_groups(documents(spark, d))
    return found.select(F.col("clone.path").alias("first_path"), F.col("clone.place").alias("first_start"), "tokens", "path", "start", "stop", "line", "end_line")


@query(f"""with t as (select path, {TOKENS} as t from {DOCS}), w as (select path, i as place, sha256(array_to_string(t[i:i + 49], chr(0))) as h from (select path, t, unnest(generate_series(1, len(t) - 49)) as i from t where len(t) >= 50)),
    m as (select path, place, n as copies from (select *, count(*) over (partition by h) as n from w) where n > 1),
    r as (select *, sum(new) over (partition by path order by place) as run from (select *, case when place - lag(place) over o = 1 and copies = lag(copies) over o then 0 else 1 end as new from m window o as (partition by path order by place)))
    select path, min(place) as start, count(*) + 49 as tokens, min(copies) as copies from r group by path, run""")
def q_clone_regions(spark, d):
    return clones.clone_regions(documents(spark, d), 50).select("path", F.col("start").cast("long").alias("start"), "tokens", "copies")


@query("""select user_id, run, count(*) as rows from (select user_id, event_type, cast(sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as run from events)
    where event_type <> 'purchase' group by all""")
def q_import_runs(spark, d):
    return scopes.runs_between(table(spark, d, "events"), "user_id", F.col("event_type") == "purchase", ["ts", "event_id"])


@query("""with s as (select o_custkey, o_orderkey as span_id, o_orderdate as start, o_orderdate + to_days(cast(o_orderkey % 400 as integer)) as stop from orders),
    j as (select p.o_custkey, p.o_orderkey as point_id, s.span_id, s.stop - s.start as extent from orders p join s on p.o_custkey = s.o_custkey and p.o_orderdate between s.start and s.stop)
    select o_custkey, point_id, arg_min(span_id, {'a': extent, 'b': span_id}) as span_id from j group by all""")
def q_enclosing_span(spark, d):
    orders = table(spark, d, "orders")
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    points = orders.select("o_custkey", F.col("o_orderkey").alias("point_id"), day.alias("at"))
    spans = orders.select("o_custkey", F.col("o_orderkey").alias("span_id"), day.alias("start"), (day + F.col("o_orderkey") % 400).alias("stop"))
    return scopes.enclosing_span(points, spans, "o_custkey")


def lcov_report(item: DataFrame) -> DataFrame:
    """A report for each order (an order has few line items, a supplier any number), with a record for each line item: its part, line and branch."""
    line = F.col("l_linenumber").cast("string")
    entries = F.concat_ws("\n", F.concat(F.lit("SF:p"), F.col("l_partkey").cast("string")), F.concat(F.lit("DA:"), line, F.lit(","), (F.col("l_quantity") % 3).cast("int").cast("string")),
                          F.concat(F.lit("BRDA:"), line, F.lit(",0,"), (F.col("l_orderkey") % 4).cast("string"), F.lit(","), F.when(F.col("l_returnflag") == "N", "-").otherwise((F.col("l_orderkey") % 2).cast("string"))), F.lit("end_of_record"))
    texts = item.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", entries.alias("e")))), lambda x: x["e"]), "\n").alias("text"))
    return texts.select(F.col("l_orderkey").alias("report"), F.posexplode(F.split("text", "\n")).alias("no", "text"))


@query("""with i as (select l_suppkey as report, 'p' || l_partkey as source, l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem),
    e as (select report, source, 'line' as kind, l_quantity % 3 >= 1 as hit, true as known from i union all select report, source, 'branch', l_orderkey % 2 = 1, l_returnflag <> 'N' from i)
    select source, kind, count(*) filter (where hit and known) as covered, count(*) filter (where known) as total, case when count(*) filter (where known) > 0 then round(count(*) filter (where hit and known) / count(*) filter (where known) * 100.0 * 100) / 100 end as percent from e group by all""")
def q_lcov_coverage(spark, d):
    return coverage.covered(coverage.lcov_entries(lcov_report(table(spark, d, "lineitem"))), ["source"])


@query("""with i as (select 'p' || l_partkey as source, l_linenumber as line, l_quantity from lineitem), c as (select distinct 'p' || p_partkey as source, 1 + p_size % 7 as line from part)
    select source, 'line' as kind, count(*) filter (where l_quantity % 3 >= 1) as covered, count(*) as total, round(count(*) filter (where l_quantity % 3 >= 1) / count(*) * 100.0 * 100) / 100 as percent from i semi join c using (source, line) group by source""")
def q_changed_coverage(spark, d):
    changed = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source"), (1 + F.col("p_size") % 7).alias("line")).distinct()
    lines = coverage.lcov_entries(lcov_report(table(spark, d, "lineitem"))).where("kind = 'line'")
    return coverage.covered(coverage.on_changed_lines(lines, changed), ["source"])


@query("""select o_orderkey as diff, 'f' || p as file, cast(unnest(generate_series(start, start + n - 1)) as integer) as line from (select l_orderkey as o_orderkey, l_partkey as p, l_linenumber * 10 as start, cast(l_quantity as integer) % 5 as n from lineitem where l_returnflag <> 'R') where n > 0""")
def q_diff_hunks(spark, d):
    item = table(spark, d, "lineitem")
    n = F.col("l_quantity").cast("int") % 5
    name = F.when(F.col("l_returnflag") == "R", "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/f"), F.col("l_partkey").cast("string")))
    hunk = F.concat(F.lit("@@ -1,2 +"), (F.col("l_linenumber") * 10).cast("string"), F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string"))), F.lit(" @@ def f():"))
    lines = item.groupBy("l_orderkey").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", name.alias("a"), hunk.alias("b")))), lambda x: F.array(x["a"], x["b"], F.lit("+new")))).alias("l"))
    return coverage.added_lines(lines.select(F.col("l_orderkey").alias("diff"), F.posexplode("l").alias("no", "text")))


@query("""with t as (select page_id, regexp_extract_all(html, '</?div|</?p>') as tags from pages), u as (select page_id, unnest(tags) as tag, generate_subscripts(tags, 1) as i from t),
    s as (select page_id, sum(case when tag like '</%' then -1 else 1 end) over (partition by page_id order by i) as depth from u)
    select page_id, cast(len(tags) as integer) as tags, cast(greatest(0, coalesce((select max(depth) from s where s.page_id = t.page_id), 0)) as integer) as depth from t""")
def q_nesting_depth(spark, d):
    tags = F.regexp_extract_all("html", F.lit("</?div|</?p>"), F.lit(0))
    return table(spark, d, "pages").select("page_id", tags.alias("t")).select("page_id", F.size("t").alias("tags"), scopes.nesting_depth(F.transform("t", lambda x: ~x.startswith("</"))).alias("depth"))


_WORK = f"""select c_mktsegment as section, key, count(distinct rule) as rules, max(current / threshold) as excess from ({_findings_sql()}) f join customer on f.key = 'customer::' || c_custkey group by all"""


@query(f"""select section, cast(rank as integer) as rank, key, rules, excess, greatest(total - 20, 0) as omitted from (select *, row_number() over (partition by section order by rules desc, excess desc, key) as rank, count(*) over (partition by section) as total from ({_WORK})) where rank <= 20""")
def q_worklist_top(spark, d):
    segments = table(spark, d, "customer").select(F.concat(F.lit("customer::"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("section"))
    return worklist.top_places(worklist.places(q_policy_findings(spark, d).join(segments, "key")), 20)


_NESTED = """select 'c' || o_custkey as file, case o_orderkey // 8 % 4 when 0 then '' when 1 then a when 2 then a || b else a || b || c end as symbol, o_orderkey % 1000 as line, rule, excess from
    (select *, 'f' || o_orderkey % 2 as a, '.g' || o_orderkey // 2 % 2 as b, '.h' || o_orderkey // 4 % 3 as c, o_orderpriority as rule, o_totalprice / 100000.0 as excess from orders)"""


@query(f"""with f as ({_NESTED}), own as (select file, symbol, min(line) as line, max(excess) as excess from f group by all),
    pairs as (select c.file, c.symbol, p.symbol as above, p.line as above_line from own c join own p on p.file = c.file and p.symbol <> '' and starts_with(c.symbol, p.symbol || '.')),
    chain as (select file, symbol, arg_min(above, length(above)) as root, arg_max(above, length(above)) as parent, count(*) as depth, string_agg(above_line || ' ' || above, ' / ' order by length(above)) as up from pairs group by all),
    ruled as (select file, symbol, rule from f union select c.file, c.parent, f.rule from chain c join f using (file, symbol)),
    r as (select file, symbol, count(distinct rule) as rules from ruled group by all),
    x as (select file, symbol, max(excess) as excess from (select file, symbol, excess from own union all select p.file, p.above, o.excess from pairs p join own o using (file, symbol)) group by all)
    select file, symbol, o.line, parent, coalesce(root, symbol) as root, coalesce(depth, 0) as depth, coalesce(up || ' / ', '') || o.line || ' ' || symbol as trail, rules, x.excess
    from own o left join chain using (file, symbol) join r using (file, symbol) join x using (file, symbol)""")
def q_worklist_nested(spark, d):
    """Functions of customers, whose orders break rules, folded into the functions around them."""
    key = F.col("o_orderkey")
    part = lambda name, over, n: F.concat(F.lit(name), (F.floor(key / over) % n).cast("string"))
    a, b, c = part("f", 1, 2), part(".g", 2, 2), part(".h", 4, 3)
    depth = F.floor(key / 8) % 4
    symbol = F.when(depth == 0, "").when(depth == 1, a).when(depth == 2, F.concat(a, b)).otherwise(F.concat(a, b, c))
    found = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file"), symbol.alias("symbol"), (key % 1000).alias("line"), F.col("o_orderpriority").alias("rule"), F.col("o_totalprice").alias("current"), F.lit(100000.0).alias("threshold"))
    places = worklist.nested(found)
    trail = F.array_join(F.transform("trail", lambda x: F.concat_ws(" ", x["line"].cast("string"), x["symbol"])), " / ")
    return places.withColumn("trail", trail)


@query("""with h as (select distinct array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.')), '.') as s from pages), n as (select s as symbol from h union select regexp_replace(s, '[.][^.]*$', '') from h where length(s) % 2 = 0)
    select a.symbol, arg_max(b.symbol, length(b.symbol)) as parent from n a left join n b on starts_with(a.symbol, b.symbol || '.') group by a.symbol""")
def q_prefix_parent(spark, d):
    name = F.array_join(F.reverse(F.split(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), r"\.")), ".")
    hosts = table(spark, d, "pages").select(name.alias("symbol")).distinct()
    return scopes.prefix_parent(hosts.union(hosts.where(F.length("symbol") % 2 == 0).select(F.regexp_replace("symbol", "[.][^.]*$", ""))))


INCLUDE, EXCLUDE = ["**/en/**", "**/{de,fr}/*.html"], ["*.example.org/**", "**/*[05].html"]


def _globs(patterns: list[str]) -> str:
    return "(" + " or ".join(f"regexp_matches(path, '{S.glob_regex(p)}')" for p in patterns) + ")"


@query(f"select page_id, path, case when {_globs(EXCLUDE)} then 'excluded' when {_globs(INCLUDE)} then 'included' else 'unmatched' end as scope from (select page_id, {_PAGE} as path from pages)")
def q_glob_filter(spark, d):
    return files.scope_of(table(spark, d, "pages").select("page_id", page_path(F.col("url")).alias("path")), INCLUDE, EXCLUDE)


@query("""with r as (select *, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as era from events where event_type in ('error', 'purchase')),
    n as (select user_id, event_id, row_number() over (partition by user_id, era order by ts, event_id) as attempt from r where event_type = 'error') select *, attempt <= 2 as blocks from n""")
def q_hook_attempts(spark, d):
    return worklist.attempts(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type = 'error'", "event_type = 'purchase'").select("user_id", "event_id", "attempt", "blocks")


ADAPTERS = ["de", "en", "es", "fr", "it"]


@query(f"""select adapter, count(doc_id) as files, coalesce(bool_and(length(code) < 20000), true) as complete from (values {", ".join(f"('{a}')" for a in ADAPTERS)}) a(adapter) left join {DOCS} on lang = adapter group by adapter""")
def q_adapter_complete(spark, d):
    return files.adapter_summary(documents(spark, d).select(F.col("lang").alias("adapter"), (F.length("code") < 20000).alias("ok")), ADAPTERS)


@query("select cast(json_extract(props, '$.k') as bigint) as k, event_type, count(*) as n from events group by all")
def q_evidence_variant(spark, d):
    return files.evidence(table(spark, d, "events"), "props", {"k": "bigint"}).groupBy("k", "event_type").agg(F.count("*").alias("n"))


@query("select event_id, rtrim(rtrim(cast(cast(value as decimal(38, 12)) as varchar), '0'), '.') as shown, case when value > 0 then round(value / 50.0 * 100) / 100 end as share from events")
def q_number_formats(spark, d):
    return table(spark, d, "events").select("event_id", S.number_text(F.col("value")).alias("shown"), F.when(F.col("value") > 0, S.rounded(F.col("value") / 50.0)).alias("share"))


@query("""with e as (select 'c' || o_custkey || '/' || o_orderpriority as path, o_orderkey from orders), g as (select path, count(*) as n, min(o_orderkey) as k from e group by path)
    select substr(sha256(path || chr(0) || n), 1, 20) as id, path, n, 'clone:' || array_to_string(list_sort([path, 'c' || k]), '|') as key, path || ':' || k as location from g""")
def q_finding_ids(spark, d):
    grouped = table(spark, d, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderpriority")).alias("path")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("k"))
    return grouped.select(S.short_id(F.col("path"), F.col("n").cast("string")).alias("id"), "path", "n", S.clone_key(F.array("path", F.concat(F.lit("c"), F.col("k").cast("string")))).alias("key"), F.concat("path", F.lit(":"), F.col("k").cast("string")).alias("location"))


@query("""with s as (select user_id, ts as start, ts + interval 2 hour as stop from events where event_type = 'purchase')
    select event_id, e.user_id from events e where event_type <> 'purchase' and not exists (select 1 from s where s.user_id = e.user_id and e.ts between start and stop)""")
def q_outside_spans(spark, d):
    events = table(spark, d, "events")
    spans = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("start"), F.expr("ts + interval '2' hour").alias("stop"))
    points = events.where("event_type <> 'purchase'").select("event_id", "user_id", F.col("ts").alias("at"))
    return scopes.outside_spans(points, spans, "user_id").select("event_id", "user_id")


@query("select rule, cast(row_number() over (order by f, rule) - 1 as integer) as place from (select event_type || '/' || k as rule, min(event_id) as f from (select event_type, event_id, cast(json_extract(props, '$.k') as bigint) % 10 as k from events) group by 1)")
def q_rule_order(spark, d):
    seen = files.evidence(table(spark, d, "events"), "props", {"k": "bigint"}).select(F.concat_ws("/", "event_type", (F.col("k") % 10).cast("string")).alias("rule"), "event_id")
    return scopes.first_seen(seen, "rule", "event_id")


@query("""with f as (select 'lib/p' || p_partkey as path from part where p_partkey % 3 = 0 union all select 'p' || p_partkey from part where p_partkey % 3 <> 2), e as (select 'p' || l_partkey as source, l_orderkey, l_linenumber from lineitem)
    select e.*, coalesce(a.path, b.path) as path from e left join f a on a.path = 'lib/' || source left join f b on b.path = source where coalesce(a.path, b.path) is not null""")
def q_source_mapping(spark, d):
    part, name = table(spark, d, "part"), F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    paths = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("lib/"), name).alias("path")).union(part.where("p_partkey % 3 <> 2").select(name))
    entries = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), "l_orderkey", "l_linenumber")
    return coverage.map_sources(entries, paths, "lib")


_LANES = " || '-' || ".join(f"cast(sum(cast('0x' || substr(h, {1 + 8 * i}, 8) as bigint)) as varchar)" for i in range(8))


@query(f"select count(*) as files, sha256({_LANES}) as digest from (select sha256(path || chr(0) || sha256(code)) as h from {DOCS})")
def q_snapshot_digest(spark, d):
    return files.snapshot_digest(documents(spark, d))


def imports_of_suppliers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(imports, files): a nation is a package, its suppliers are modules, and line items import by absolute and relative names."""
    own = table(spark, d, "supplier").select(F.concat(F.lit("pkg"), F.col("s_nationkey").cast("string")).alias("pkg"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("m"), "s_suppkey")
    paths = own.select(F.concat("pkg", F.lit("/"), "m", F.lit(".py")).alias("path")).union(own.select(F.concat("pkg", F.lit("/__init__.py"))).distinct())
    name = F.concat(F.lit("s"), (F.col("l_partkey") % 40).cast("string"))
    spec = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("."), name)).otherwise(F.concat(F.lit("pkg"), (F.col("l_orderkey") % 40).cast("string"), F.lit("."), name))
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", spec.alias("specifier"))
    return lines.join(own, F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat("pkg", F.lit("/"), "m", F.lit(".py")).alias("path"), "specifier", "l_orderkey", "l_linenumber"), paths


_IMPORTS = """with own as (select 'pkg' || s_nationkey as pkg, 's' || s_suppkey as m, s_suppkey from supplier),
    f as (select pkg || '/' || m || '.py' as path from own union select pkg || '/__init__.py' from own),
    i as (select pkg, pkg || '/' || m || '.py' as path, case when l_linenumber % 2 = 0 then '.' || n else 'pkg' || (l_orderkey % 40) || '.' || n end as specifier, case when l_linenumber % 2 = 0 then pkg else 'pkg' || (l_orderkey % 40) end as place, n, l_orderkey, l_linenumber
        from (select *, 's' || (l_partkey % 40) as n from lineitem) join own on l_suppkey = s_suppkey),
    r as (select i.path, specifier, l_orderkey, l_linenumber, coalesce(case when specifier like '.%' or a.path <> i.path then a.path end, b.path) as target from i left join f a on a.path = place || '/' || n || '.py' left join f b on b.path = place || '/__init__.py')"""


@query(_IMPORTS + " select path, specifier, l_orderkey, l_linenumber, target, case when target is not null then 'internal' else 'external' end as resolution from r")
def q_python_imports(spark, d):
    imports, paths = imports_of_suppliers(spark, d)
    return resolve.resolve_python(imports, paths).select("path", "specifier", "l_orderkey", "l_linenumber", "target", "resolution")


@query(_IMPORTS + " select 'dependency.external_not_analyzed' as code, 'info' as severity, count(*) || ' imports are external' as message from r where target is null having count(*) > 0")
def q_external_imports(spark, d):
    return graph.external_diagnostic(resolve.resolve_python(*imports_of_suppliers(spark, d)))


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as files: a folder for each nation, one in it for each of seven modules, and at most fifty names."""
    text = lambda c: c.cast("string")
    path = F.concat(F.lit("r"), text(F.col("s_nationkey")), F.lit("/m"), text(F.col("s_suppkey") % 7), F.lit("/s"), text(F.col("s_suppkey") % 50), F.lit(".h"))
    return table(spark, d, "supplier").select("s_suppkey", path.alias("path"))


_FILES = "(select s_suppkey, 'r' || s_nationkey || '/m' || s_suppkey % 7 || '/s' || s_suppkey % 50 || '.h' as path from supplier)"


def spelled(spark: SparkSession, d: str, *forms: str) -> DataFrame:
    """(path, specifier) of each line item: its supplier's file, and one of the forms in turn, with x, y and n of the line item."""
    cases = " ".join(f"when {i} then {form}" for i, form in enumerate(forms))
    lines = table(spark, d, "lineitem").selectExpr("l_suppkey", "l_linenumber", "cast(l_partkey % 60 as string) as x", "cast(l_orderkey % 7 as string) as y", "cast(l_orderkey % 25 as string) as n")
    return lines.join(source_files(spark, d), F.col("l_suppkey") == F.col("s_suppkey")).select("path", F.expr(f"case l_linenumber % {len(forms)} {cases} end").alias("specifier"))


def _spelled_sql(*forms: str) -> str:
    cases = " ".join(f"when {i} then {form}" for i, form in enumerate(forms))
    return f"(select path, case l_linenumber % {len(forms)} {cases} end as specifier from (select l_suppkey, l_linenumber, l_partkey % 60 as x, l_orderkey % 7 as y, l_orderkey % 25 as n from lineitem) join {_FILES} on l_suppkey = s_suppkey)"


INCLUDES = ("'\"s' || x || '.h\"'", "'\"../m' || y || '/s' || x || '.h\"'", "'<m' || y || '/s' || x || '.h>'", "'\"r' || n || '/m' || y || '/s' || x || '.h\"'", "'<s' || x || '.h>'")


@query(f"""with f as (select distinct path from {_FILES}), i as (select path, specifier, count(*) as uses from {_spelled_sql(*INCLUDES)} group by all),
    n as (select *, specifier[1] = '"' as quoted, specifier[2:-2] as name, regexp_replace(path, '/[^/]*$', '') as folder from i),
    a as (select n.*, case when quoted then case when starts_with(name, '../') then regexp_replace(folder, '/[^/]*$', '') || name[3:] else folder || '/' || name end end as near from n),
    g as (select a.path, specifier, uses, quoted or contains(name, '/') as open, min(f.path) filter (where f.path = near) as beside, min(f.path) filter (where f.path = name) as root, count(f.path) filter (where f.path = name or ends_with(f.path, '/' || name)) as ends, min(f.path) filter (where f.path = name or ends_with(f.path, '/' || name)) as one
        from a left join f on f.path <> a.path and (f.path = near or f.path = name or ends_with(f.path, '/' || name)) group by a.path, specifier, uses, quoted, name)
    select path, specifier, uses, case when beside is not null then beside when not open then null when root is not null then root when ends = 1 then one end as target,
        case when beside is not null then 'internal' when not open then 'external' when root is not null or ends = 1 then 'internal' when ends > 1 then 'unresolved' else 'external' end as resolution from g""")
def q_includes(spark, d):
    found = resolve.resolve_includes(spelled(spark, d, *INCLUDES), source_files(spark, d))
    return found.groupBy("path", "specifier", "target", "resolution").agg(F.count("*").alias("uses"))


PACKAGES = ("'mod.org/r' || n || '/m' || y", "'deep.org/' || n", "'mod.org/r' || n || '/none'", "'fmt'", "'deep.org/' || n || '/more/' || x")


@query(f"""with m as (select 'r' || n_nationkey as folder, 'mod.org/r' || n_nationkey as module from nation where n_nationkey % 3 < 2 union all select 'r' || n_nationkey || '/m3', 'deep.org/' || n_nationkey from nation where n_nationkey % 2 = 0),
    f as (select path, folder, module, case when folder is null then null else module || regexp_replace(path, '/[^/]*$', '')[length(folder) + 1:] end as package
        from (select f.path, arg_max(m.folder, length(m.folder)) as folder, arg_max(m.module, length(m.folder)) as module from (select distinct path from {_FILES}) f left join m on starts_with(f.path, m.folder || '/') group by f.path)),
    p as (select package, min(path) as target from f where package is not null group by package), r as (select distinct module from f where module is not null),
    i as (select path, specifier, count(*) as uses from {_spelled_sql(*PACKAGES)} group by all)
    select path, specifier, uses, target, case when target is not null then 'internal' when exists (select 1 from r where specifier = module or starts_with(specifier, module || '/')) then 'unresolved' else 'external' end as resolution from i left join p on package = specifier""")
def q_module_packages(spark, d):
    nation = table(spark, d, "nation")
    key = F.col("n_nationkey").cast("string")
    tops = nation.where("n_nationkey % 3 < 2").select(F.concat(F.lit("r"), key).alias("folder"), F.concat(F.lit("mod.org/r"), key).alias("module"))
    deep = nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("r"), key, F.lit("/m3")).alias("folder"), F.concat(F.lit("deep.org/"), key).alias("module"))
    files_of = resolve.nearest_modules(source_files(spark, d).select("path").distinct(), tops.unionByName(deep))
    found = resolve.resolve_packages(spelled(spark, d, *PACKAGES), files_of)
    return found.groupBy("path", "specifier", "target", "resolution").agg(F.count("*").alias("uses"))


CLASSES = ("'pkg.m' || y || '.S' || x", "'pkg.m' || y || '.S' || x || '.Inner'", "'java.util.S' || x", "'pkg.m' || y || '.*'")


@query(f"""with s as (select path, regexp_replace(path, '/[^/]*$', '') as folder, 'pkg.' || split_part(path, '/', 2) as package, 'S' || regexp_extract(path, '/s([0-9]+)[.]', 1) as class from (select distinct path from {_FILES})),
    f as (select folder || '/' || class || '.java' as path, folder, package, class from s), i as (select regexp_replace(path, '/s([0-9]+)[.]h$', '/S\\1.java') as path, specifier, count(*) as uses from {_spelled_sql(*CLASSES)} group by all),
    q as (select path, specifier, k, array_to_string(string_split(specifier, '.')[1:k], '.') as package, string_split(specifier, '.')[k + 1] as class from (select *, unnest(generate_series(0, len(string_split(specifier, '.')) - 1)) as k from i where not ends_with(specifier, '.*'))),
    b as (select q.path, q.specifier, arg_min(f.path, (-k, f.folder)) as target from q join f on f.package = q.package and f.class = q.class and f.path <> q.path group by all)
    select path, specifier, uses, target, case when target is not null then 'internal' when not ends_with(specifier, '.*') and regexp_replace(specifier, '[.][^.]*$', '') in (select package from f) then 'unresolved' else 'external' end as resolution from i left join b using (path, specifier)""")
def q_class_imports(spark, d):
    as_class = lambda c: F.regexp_replace(c, r"/s(\d+)[.]h$", "/S$1.java")
    sources = source_files(spark, d).select(as_class(F.col("path")).alias("path"), F.concat(F.lit("pkg."), F.split("path", "/")[1]).alias("package")).distinct()
    imports = spelled(spark, d, *CLASSES).select(as_class(F.col("path")).alias("path"), "specifier", F.lit("static").alias("kind"), F.lit(0).alias("seq"))
    found = resolve.resolve_classes(imports, sources)
    return found.groupBy("path", "specifier", "target", "resolution").agg(F.count("*").alias("uses"))


def python_sources(spark: SparkSession, d: str) -> DataFrame:
    """A Python file of each order: imports, and a function with as many ifs inside each other as the key says; some cannot be parsed."""
    deep, names = F.col("o_orderkey") % 5, F.col("o_custkey") % 4
    ifs = F.array_join(F.transform(F.sequence(F.lit(0), deep), lambda i: F.concat(F.repeat(F.lit(" "), i + 1), F.when(i == deep, "pass").otherwise("if a:"))), "\n")
    head = F.concat(F.lit("from . import c"), F.col("o_custkey").cast("string"), F.lit("\n\ndef f("), F.array_join(F.transform(F.sequence(F.lit(0), names), lambda i: F.concat(F.lit("p"), i.cast("string"))), ", "), F.when(F.col("o_orderkey") % 32 == 7, ":\n").otherwise("):\n # a comment\n"))
    return table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".py")).alias("path"), F.concat(head, ifs, F.lit("\n")).alias("code"))


@query(f"""with o as (select 'o' || o_orderkey || '.py::f' as key, o_orderkey % 5 as n, o_custkey % 4 as k from orders where o_orderkey % 32 <> 7)
    select key, unnest(['complexity.cyclomatic', 'complexity.cognitive', 'complexity.nesting_depth', 'size.function_lines', 'size.parameter_count']) as metric, cast(unnest([n + 1, n * (n + 1) // 2, n, n + 2, k + 1]) as double) as value from o""")
def q_function_measures(spark, d):
    return function_measurements(python_facts(spread(python_sources(spark, d))))


@query("select 'o' || o_orderkey || '.py' as path, '.c' || o_custkey as specifier, 1 as line from orders where o_orderkey % 32 <> 7")
def q_import_facts(spark, d):
    return python_facts(spread(python_sources(spark, d))).select("path", F.explode("imports").alias("i")).select("path", "i.specifier", "i.line")


@query("select 'python.parse_failed' as code, 'o' || o_orderkey || '.py' as file from orders where o_orderkey % 32 = 7")
def q_parse_failures(spark, d):
    return python_facts(spread(python_sources(spark, d))).where("error is not null").select(F.lit("python.parse_failed").alias("code"), F.col("path").alias("file"))


@query("select p.path, o_orderkey from (select 'c' || o_custkey as path, o_orderkey from orders) p join (select 'c' || o_custkey as path from orders group by o_custkey having max(o_orderdate) <= timestamp '1998-01-01' + interval 1 millisecond) f using (path)")
def q_stale_sources(spark, d):
    name = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    orders = table(spark, d, "orders")
    modified = orders.groupBy(name.alias("path")).agg(F.max("o_orderdate").alias("modified"))
    return coverage.fresh_only(orders.select(name.alias("path"), "o_orderkey"), modified, F.lit("1998-01-01").cast("timestamp_ntz"))


@query("""with i as (select 'p' || l_partkey as key, l_linenumber as line, l_quantity, l_orderkey, l_returnflag from lineitem), c as (select distinct 'p' || p_partkey as key, 1 + p_size % 7 as line from part),
    e as (select key, line, 'line' as kind, l_quantity % 3 >= 1 as hit, true as known from i union all select key, line, 'branch', l_orderkey % 2 = 1, l_returnflag <> 'N' from i),
    everything as (select 'coverage.' || kind as metric, key, hit, known from e union all select 'coverage.changed_' || kind, key, hit, known from e semi join c using (key, line))
    select metric, key, case when count(*) filter (where known) > 0 then round(count(*) filter (where hit and known) / count(*) filter (where known) * 100.0 * 100) / 100 end as value from everything group by all""")
def q_coverage_measurements(spark, d):
    changed = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source"), (1 + F.col("p_size") % 7).alias("line")).distinct()
    return coverage.measurements(coverage.lcov_entries(lcov_report(table(spark, d, "lineitem"))), changed)


_COMPARED = ORACLE_SQL["q_compare_findings"]


@query(f"select rule, classification <> 'resolved' as active, count(*) as findings from ({_COMPARED}) group by all")
def q_active_findings(spark, d):
    found = q_compare_findings(spark, d)
    counts = lambda rows, is_active: rows.groupBy("rule").agg(F.count("*").alias("findings")).withColumn("active", F.lit(is_active))
    return counts(compare.active(found), True).unionByName(counts(compare.resolved(found), False)).select("rule", "active", "findings")


@query(f"select rule, key, current from ({_COMPARED})")
def q_stripped_findings(spark, d):
    return compare.stripped(q_compare_findings(spark, d))


@query(f"""select rule, key, classification in ('new', 'worsened') as regression, p.blocking and classification in ('new', 'worsened') as blocks from ({_COMPARED}) join (values {_POLICY_ROWS}) p(metric, enabled, threshold, severity, blocking) on rule = metric""")
def q_finding_predicates(spark, d):
    rules = policies(spark).select(F.col("metric").alias("rule"), "blocking")
    return q_compare_findings(spark, d).join(F.broadcast(rules), "rule").select("rule", "key", S.is_regression(F.col("classification")).alias("regression"), S.blocks_gate(F.col("blocking"), F.col("classification")).alias("blocks"))


@query(f"""with c as (select classification, p.blocking from ({_COMPARED}) join (values {_POLICY_ROWS}) p(metric, enabled, threshold, severity, blocking) on rule = metric),
    n as (select count(*) filter (where blocking and classification in ('new', 'worsened')) as blocking, count(*) filter (where not blocking and classification <> 'resolved') as warnings from c)
    select case when blocking > 0 then 'failed' else 'passed' end as status, blocking, warnings from n""")
def q_gate_against(spark, d):
    """The gate after a comparison: what was there before does not block."""
    rules = policies(spark).select(F.col("metric").alias("rule"), "blocking")
    return policy.gate(q_compare_findings(spark, d).join(F.broadcast(rules), "rule"))


@query(f"""with c as ({_findings_sql(f"(select * from orders where o_orderdate >= {_SPLIT})")}), p as ({_findings_sql(f"(select * from orders where o_orderdate < {_SPLIT})")}), m as (select metric as rule, key, value as measured from ({_measures_sql(f"(select * from orders where o_orderdate < {_SPLIT})")})),
    j as (select rule, key, c.current, p.current as before, c.rule is null as gone, p.rule is null as fresh, case when c.rule is null then p.current else coalesce(m.measured, p.current) end as baseline from c full join p using (rule, key) left join m using (rule, key))
    select rule, key, current, baseline, case when gone then -before else current - baseline end as delta, case when gone then 'resolved' when fresh then 'new' when current - baseline > 0 then 'worsened' else 'existing' end as classification from j""")
def q_findings_by_measurement(spark, d):
    orders = table(spark, d, "orders")
    old = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    found = lambda rows: policy.threshold_findings(order_measurements(rows), policies(spark)).select("rule", "key", "current")
    measured = order_measurements(orders.where(old)).select(F.col("metric").alias("rule"), "key", F.col("value").alias("baseline"))
    return compare.compare_findings(found(orders.where(~old)), found(orders.where(old)), ["rule", "key"], measured)


@query(f"select finding_id, rule, key from (select *, replace(key, '::', '/') || '.py' as file from ({_findings_sql()})) where rule in ('orders.count', 'orders.urgent') and regexp_matches(file, '{S.glob_regex("customer/*[02468].py")}')")
def q_worklist_filter(spark, d):
    files_of = F.array(F.concat(F.replace("key", F.lit("::"), F.lit("/")), F.lit(".py")))
    return worklist.kept(q_policy_findings(spark, d).withColumn("files", files_of), ["orders.count", "orders.urgent"], ["customer/*[02468].py"]).select("finding_id", "rule", "key")


_ENTRIES = f"""select case c_mktsegment when 'BUILDING' then 'structure' when 'MACHINERY' then 'clones' else 'hotspots' end as section, rule, key, current, 1 + length(key) % 3 as rules, current / threshold as excess, c_name as file, c_custkey % 9 as line from ({_findings_sql()}) f join customer on f.key = 'customer::' || c_custkey"""


@query(f"""select section, rule, key, cast(row_number() over (partition by section order by case when section = 'structure' then rule end, case when section = 'clones' then -current when section = 'hotspots' then -rules end, case when section = 'hotspots' then -excess end, case when section = 'hotspots' then file end, case when section = 'hotspots' then line end, key, rule) as integer) as rank from ({_ENTRIES.replace("rule, key, current, 1", "rule, key || '/' || rule as key, current, 1")})""")
def q_worklist_sections(spark, d):
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "structure").when(F.col("c_mktsegment") == "MACHINERY", "clones").otherwise("hotspots")
    who = table(spark, d, "customer").select(F.concat(F.lit("customer::"), F.col("c_custkey").cast("string")).alias("key"), segment.alias("section"), F.col("c_name").alias("file"), (F.col("c_custkey") % 9).alias("line"))
    entries = q_policy_findings(spark, d).join(who, "key").select("section", "rule", F.concat_ws("/", "key", "rule").alias("key"), "current", (1 + F.length("key") % 3).alias("rules"), S.excess(F.col("current"), F.col("threshold")).alias("excess"), "file", "line")
    return worklist.ordered_sections(entries).select("section", "rule", "key", "rank")


@query(f"select rule as \"ruleId\", cast(dense_rank() over (order by rule) - 1 as integer) as \"ruleIndex\", severity as level, message as text, regexp_extract(key, '^(.*?)(::|$)', 1) as uri, finding_id as fingerprint from ({_findings_sql()})")
def q_sarif_results(spark, d):
    return report.sarif_results(q_policy_findings(spark, d)).select("ruleId", "ruleIndex", "level", "message.text", F.col("locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("uri"), F.col("partialFingerprints.findingId").alias("fingerprint"))


_DIAGNOSTICS = "select event_type as code, 'u' || user_id as file, 'event ' || event_id as message, case when event_type = 'error' then 'error' when event_type = 'purchase' then 'warning' else 'info' end as severity from events"


def event_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    return table(spark, d, "events").select(F.col("event_type").alias("code"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"), severity.alias("severity"))


@query(f"select code, file, message, severity from ({_DIAGNOSTICS}) where severity <> 'info' order by code, file, message")
def q_ordered_diagnostics(spark, d):
    return report.ordered(report.visible(event_diagnostics(spark, d)), "diagnostics")


@query(f"select * from ({_findings_sql()}) order by rule, key, finding_id")
def q_ordered_findings(spark, d):
    return report.ordered(q_policy_findings(spark, d), "findings")


@query(f"select metric, key, value from ({_measures_sql('orders')}) order by metric, key")
def q_ordered_measurements(spark, d):
    return report.ordered(order_measurements(table(spark, d, "orders")), "measurements")


@query(f"select code as \"descriptorId\", severity as level, message as text, file as uri from ({_DIAGNOSTICS}) where severity <> 'info'")
def q_sarif_notifications(spark, d):
    return report.sarif_notifications(event_diagnostics(spark, d)).select("descriptorId", "level", "message.text", "uri")


@query(f"select case when bool_and(length(code) < 20000) then 'measured' else 'unavailable' end as status, case when bool_and(length(code) < 20000) then cast(sum(len({TOKENS})) as bigint) end as tokens from {DOCS}")
def q_total_tokens(spark, d):
    return files.total_tokens(documents(spark, d).select("code", (F.length("code") < 20000).alias("ok")))


@query(f"select lang, count(*) as files, count(*) filter (where length(code) < 5000) as parsed, count(*) filter (where length(code) >= 5000) as failed, cast(coalesce(sum(len(regexp_extract_all(code, '[A-Z][a-z]+'))) filter (where length(code) < 5000), 0) as bigint) as functions, cast(sum(strlen(code)) as bigint) as bytes from {DOCS} group by lang")
def q_corpus_report(spark, d):
    rows = documents(spark, d).select("lang", "code", (F.length("code") < 5000).alias("ok"), F.size(F.regexp_extract_all("code", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("functions"))
    return files.corpus_report(rows, ["lang"])


@query("""with c as (select l_orderkey as clone, 's' || l_suppkey as file, case when l_returnflag = 'R' then 'f' || l_linestatus else '' end as symbol, l_linenumber * 10 as start, l_linenumber * 10 + cast(l_quantity as integer) as stop from lineitem),
    g as (select clone, 'clone:' || array_to_string(list_sort(list(file || case when symbol <> '' then '::' || symbol else '' end)), '|') as base, count(*) as copies, cast(sum(stop - start + 1) as bigint) as lines from c group by clone)
    select case when n > 1 then base || '#' || n else base end as key, clone, copies, lines, 'The same 50-token block appears in ' || copies || ' locations, ' || lines || ' lines in all' as message from (select *, row_number() over (partition by base order by clone) as n from g)""")
def q_clone_findings(spark, d):
    start = F.col("l_linenumber") * 10
    copies = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("clone"), F.lit(50).alias("tokens"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("file"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("f"), "l_linestatus")).otherwise("").alias("symbol"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("stop"))
    return clones.clone_findings(copies)


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as at from events")
def q_utc_times(spark, d):
    return table(spark, d, "events").select("event_id", S.utc_millis(F.col("ts")).alias("at"))


@query(f"select page_id, regexp_replace(path, '/?[^/]*$', '') as folder, lower(regexp_extract(path, '([.][^./]*)$', 1)) as extension from (select page_id, {_PAGE} as path from pages)")
def q_path_parts(spark, d):
    paths = table(spark, d, "pages").select("page_id", page_path(F.col("url")).alias("path"))
    return paths.select("page_id", S.folder(F.col("path")).alias("folder"), S.extension(F.col("path")).alias("extension"))


@query("""with k as (select o_orderkey, 'c' || o_custkey || '.py' as file, case o_orderkey % 3 when 0 then 'c' || o_custkey || '.py' when 1 then 'c' || o_custkey || '.py::f' || o_orderkey else 'clone:c' || o_custkey end as key from orders)
    select o_orderkey, case when key = file then 'moved/' || file when starts_with(key, file || '::') then 'moved/' || key else key end as key from k""")
def q_moved_keys(spark, d):
    file = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".py"))
    key = F.when(F.col("o_orderkey") % 3 == 0, file).when(F.col("o_orderkey") % 3 == 1, F.concat(file, F.lit("::f"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("clone:c"), F.col("o_custkey").cast("string")))
    return table(spark, d, "orders").select("o_orderkey", S.with_file(key, file, F.concat(F.lit("moved/"), file)).alias("key"))


@query("""select conv_id, turn, case when turn % 3 = 0 then 'C.' else '' end || case when turn % 2 = 0 then 'outer.' else '' end || role as symbol from conversations""")
def q_symbol_names(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.symbol_name(F.when(F.col("turn") % 3 == 0, "C"), F.when(F.col("turn") % 2 == 0, "outer"), F.col("role")).alias("symbol"))


_NAMES = ", ".join(f"({i}, '{e}', '{n}')" for i, (e, n) in enumerate(files.EXTENSIONS.items()))


@query(f"""select coalesce(n, 'Unknown') as language, count(*) as files from (select doc_id % {len(files.EXTENSIONS) + 2} as i from documents) left join (values {_NAMES}) t(i, e, n) using (i) group by 1""")
def q_languages(spark, d):
    ends = F.array(*[F.lit("A/b" + e.upper()) for e in files.EXTENSIONS], F.lit("Makefile"), F.lit("x.unknown"))
    paths = table(spark, d, "documents").select(F.get(ends, (F.col("doc_id") % (len(files.EXTENSIONS) + 2)).cast("int")).alias("path"))
    return files.language_of(paths).groupBy("language").agg(F.count("*").alias("files"))


@query("select conv_id, turn, cast(max(line) as integer) as last, count(*) as lines from (select conv_id, turn, unnest(generate_series(1, len(string_split(text, chr(10))))) as line from conversations) group by all")
def q_untracked_lines(spark, d):
    texts = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("file"), "text")
    return coverage.all_lines(texts).groupBy("file.conv_id", "file.turn").agg(F.max("line").alias("last"), F.count("*").alias("lines"))


@query(f"select rule, key, current from ({_findings_sql()})")
def q_baseline_round_trip(spark, d):
    """Findings saved as a baseline and loaded again."""
    root = f"{shared_dir(spark)}/plumbline-baselines"
    baseline.save({"findings": compare.stripped(q_policy_findings(spark, d)).select("rule", "key", "current")}, root, "round-trip", replace=True)
    return baseline.load(spark, root, "round-trip", "findings")


@query(f"select finding_id, rule, key, current, threshold, severity, blocking, message from ({_findings_sql()})")
def q_json_report(spark, d):
    """Findings written as JSON lines and read again."""
    found, path = q_policy_findings(spark, d), f"{shared_dir(spark)}/plumbline-json-{uuid.uuid4().hex}"
    report.write_json(found, path)
    return spark.read.schema(found.schema).json(path)
