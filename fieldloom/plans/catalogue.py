"""Registered queries and their SQL.

The driver's tables stand for controller data: ``customer`` and ``part`` are
point tables, ``lineitem`` holds accesses (variable ``l_partkey``, block
``l_suppkey``, a write where ``l_returnflag`` is R), ``orders`` step results,
``events`` samples and packets in order of (ts, event_id), ``documents`` and
``pages`` a text corpus.  Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import names, values
from fieldloom.operators import corpus, graph, network, points, results, signals, xref
from fieldloom.plans.scratch import Queries, table

QUERIES: Queries = {}
ORACLE_SQL: dict[str, str] = {}
ORDER = ("ts", "event_id")


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def _writes():
    return F.col("l_returnflag") == "R"


CALLS_SQL = "SELECT DISTINCT l_suppkey AS src, l_partkey % 100 AS dst FROM lineitem"


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Every line as a call between suppliers."""
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst")).distinct()


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("n"), "s_acctbal")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_name LIMIT 20")
def point_filter_topk(spark, sf):
    found = points.top_points(table(spark, sf, "customer"), "c_name", 20, c_mktsegment="BUILDING", c_nationkey=None)
    return found.select("c_custkey", "c_name", "c_mktsegment")


@query(
    "SELECT 'category' AS dim, coalesce(c_mktsegment, 'Internal') AS k, count(*) AS n FROM customer GROUP BY 2 "
    "UNION ALL SELECT 'group', coalesce(CAST(c_nationkey AS VARCHAR), 'Unknown'), count(*) FROM customer GROUP BY 2"
)
def point_statistics(spark, sf):
    return points.statistics(
        table(spark, sf, "customer"), {"category": ("c_mktsegment", "Internal"), "group": ("c_nationkey", "Unknown")}
    )


@query(
    "WITH a AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0) SELECT count(*) FILTER (WHERE a.c_custkey IS NULL) AS added, "
    "count(*) FILTER (WHERE a.c_custkey IS NOT NULL) AS skipped FROM customer b LEFT JOIN a ON a.c_custkey = b.c_custkey"
)
def upsert_counts(spark, sf):
    c = table(spark, sf, "customer")
    return points.upsert_counts(c.where("c_acctbal > 0"), c, "c_custkey")


@query(
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'old' ELSE 'new' END AS origin FROM customer",
)
def upsert_merge(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    old = c.where("c_acctbal > 0").select("c_custkey", F.lit("old").alias("origin"))
    return points.upsert(old, c.select("c_custkey", F.lit("new").alias("origin")), "c_custkey")


DIFF_SQL = """
WITH s AS (SELECT c_custkey, c_mktsegment, round(c_acctbal) AS bal FROM customer WHERE c_acctbal > -500),
t AS (SELECT c_custkey, CASE WHEN c_nationkey < 9 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment,
        CASE WHEN c_nationkey = 7 THEN round(c_acctbal) + 1 ELSE round(c_acctbal) END AS bal FROM customer WHERE c_acctbal < 9000)
SELECT CASE WHEN t.c_custkey IS NULL THEN 'removed' WHEN s.c_custkey IS NULL THEN 'added'
  WHEN lower(s.c_mktsegment) <> lower(t.c_mktsegment) OR s.bal <> t.bal THEN 'modified' ELSE 'unchanged' END AS diff_type, count(*) AS n
FROM s FULL OUTER JOIN t ON s.c_custkey = t.c_custkey GROUP BY 1"""


@query(DIFF_SQL)
def table_diff(spark, sf):
    c = table(spark, sf, "customer")
    bal = F.round("c_acctbal")
    s = c.where("c_acctbal > -500").select("c_custkey", "c_mktsegment", bal.alias("bal"))
    t = c.where("c_acctbal < 9000").select(
        "c_custkey",
        F.when(F.col("c_nationkey") < 9, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(F.col("c_nationkey") == 7, bal + 1).otherwise(bal).alias("bal"),
    )
    return points.diff(s, t, "c_custkey", ["c_mktsegment", "bal"]).groupBy("diff_type").agg(F.count("*").alias("n"))


@query(
    "SELECT upper(p_name) AS addr, p_size, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS members "
    "FROM part GROUP BY 1, 2 HAVING count(*) > 1"
)
def duplicate_groups(spark, sf):
    return points.duplicates(table(spark, sf, "part"), [F.upper("p_name").alias("addr"), F.col("p_size")], "p_partkey")


@query(
    "SELECT 'only_in_customer' AS side, c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey "
    "AND o_totalprice > 300000) UNION ALL SELECT 'only_in_orders', o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) "
    "WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)"
)
def consistency_anti(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return points.only_in(c, o.where("o_totalprice > 300000"), "c_custkey", "o_custkey", "only_in_customer").union(
        points.only_in(o.select("o_custkey").distinct(), c.where("c_acctbal > 0"), "o_custkey", "c_custkey", "only_in_orders")
    )


@query(
    "SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal < 0) AS spares, count(*) AS total, "
    "round(100.0 * count(*) FILTER (WHERE c_acctbal < 0) / count(*), 4) AS pct FROM customer GROUP BY 1"
)
def spare_percentage(spark, sf):
    return points.spare_share(table(spark, sf, "customer"), "c_mktsegment", F.col("c_acctbal") < 0)


RW_SQL = (
    "SELECT l_partkey AS var, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'R') AS writers, "
    "count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag <> 'R') AS readers FROM lineitem GROUP BY 1"
)


@query(RW_SQL)
def xref_access_type(spark, sf):
    return xref.readers_writers(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey", _writes())


@query(
    f"WITH v AS ({RW_SQL}) SELECT 'GV001' AS rule, var FROM v WHERE writers > 1 UNION ALL "
    "SELECT 'GV003', var FROM v WHERE writers > 0 AND readers = 0 UNION ALL SELECT 'GV004', var FROM v WHERE readers > 0 AND writers = 0"
)
def audit_gv(spark, sf):
    return xref.audit(xref_access_type(spark, sf))


@query(
    "SELECT l_partkey AS var, l_suppkey AS block, count(*) AS writes FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2 HAVING count(*) > 1"
)
def audit_gv002_strict(spark, sf):
    return xref.repeated_writes(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey", _writes())


@query(
    "SELECT c_custkey, CASE WHEN bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus <> 'F') THEN 'used' WHEN bool_or(o_orderstatus <> 'F') "
    "THEN 'read-only' WHEN bool_or(o_orderstatus = 'F') THEN 'write-only' ELSE 'untouched' END AS verdict "
    "FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"
)
def tag_verdict(spark, sf):
    return xref.tag_verdicts(
        table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders"), "o_custkey", F.col("o_orderstatus") == "F"
    )


@query(
    "SELECT substr(c_name, 1, 17) AS prefix, count(*) AS members FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders "
    "WHERE o_totalprice > 495000) o ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) >= 3 AND count(o_custkey) = 0"
)
def silent_prefix(spark, sf):
    touched = table(spark, sf, "orders").where("o_totalprice > 495000").select("o_custkey")
    return xref.silent_prefixes(table(spark, sf, "customer"), "c_custkey", F.substring("c_name", 1, 17), touched)


@query(
    f"WITH edges AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 100 AS dst FROM lineitem), "
    "o AS (SELECT s_suppkey AS n, count(dst) AS outd FROM supplier LEFT JOIN edges ON src = s_suppkey GROUP BY 1), "
    "i AS (SELECT s_suppkey AS n, count(src) AS ind FROM supplier LEFT JOIN edges ON dst = s_suppkey GROUP BY 1) "
    "SELECT count(*) AS node_count, CAST(sum(outd) AS BIGINT) AS edge_count, count(*) FILTER (WHERE outd = 0 AND ind = 0) AS isolated, max(outd) AS max_out, "
    "max(ind) AS max_in, round(avg(outd), 2) AS avg_out FROM o JOIN i USING (n)"
)
def graph_degree_stats(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"))
    return graph.degree_statistics(blocks(spark, sf), lines)


@query(
    f"WITH RECURSIVE edges AS ({CALLS_SQL}), r AS (SELECT dst AS n, 1 AS d FROM edges WHERE src < 10 UNION "
    "SELECT e.dst, d + 1 FROM r JOIN edges e ON e.src = r.n WHERE d < 3) SELECT n, min(d) AS depth FROM r WHERE n >= 10 GROUP BY 1"
)
def graph_callees_depth3(spark, sf):
    edges = calls(spark, sf)
    start = edges.where("src < 10").select(F.col("src").alias("n")).union(edges.where("dst < 10").select("dst")).distinct()
    begin = edges.where("src < 10").select(F.col("src").alias("n")).distinct()
    found = graph.reachable(edges, begin, 3)
    return found.join(start, "n", "left_anti").where("n >= 10")


@query(
    f"WITH RECURSIVE edges AS ({CALLS_SQL}), u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), "
    "r AS (SELECT s_suppkey AS n, s_suppkey AS root FROM supplier UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.n) "
    "SELECT comp, count(*) AS size FROM (SELECT n, min(root) AS comp FROM r WHERE n IN (SELECT s_suppkey FROM supplier) GROUP BY 1) GROUP BY 1"
)
def graph_components(spark, sf):
    return graph.component_sizes(graph.components_with_isolated(blocks(spark, sf), calls(spark, sf)))


@query(
    f"WITH edges AS ({CALLS_SQL}) SELECT CASE WHEN a.s_acctbal > 5000 THEN 'F002' ELSE 'F001' END AS rule, src, dst FROM edges "
    "JOIN supplier a ON a.s_suppkey = src JOIN supplier b ON b.s_suppkey = dst WHERE (a.s_acctbal > 5000) <> (b.s_acctbal > 5000)"
)
def safety_boundary(spark, sf):
    return xref.boundary_edges(calls(spark, sf), blocks(spark, sf), "n", F.col("s_acctbal") > 5000)


URL_PARTS = "split_part(url, '/', 3) || '/' || split_part(split_part(url, '/', 4), '?', 1)"


@query(
    f"SELECT p.url AS parent, count(*) AS children FROM (SELECT DISTINCT {URL_PARTS} AS url FROM pages) p JOIN "
    f"(SELECT {URL_PARTS} || '/' || split_part(url, '/', 5) AS child FROM pages) c ON starts_with(child, p.url || '/') GROUP BY 1"
)
def path_prefix_propagation(spark, sf):
    pages = table(spark, sf, "pages")
    part = lambda i: F.split_part("url", F.lit("/"), F.lit(i))
    parent = F.concat(part(3), F.lit("/"), F.split_part(part(4), F.lit("?"), F.lit(1)))
    found = xref.children_of_prefixes(
        pages.select(parent.alias("parent")).distinct(), pages.select(F.concat(parent, F.lit("/"), part(5)).alias("child"))
    )
    return found.groupBy("parent").agg(F.count("*").alias("children"))


@query("SELECT regexp_replace(url, '[0-9]+', '*', 'g') AS norm, count(*) AS n FROM pages GROUP BY 1")
def path_index_wildcard(spark, sf):
    # numbers of a URL as indices of a path, whose key has a star for each
    key = F.replace(names.wildcard_path(F.regexp_replace("url", "([0-9]+)", "[$1]")), F.lit("[*]"), F.lit("*"))
    return table(spark, sf, "pages").groupBy(key.alias("norm")).agg(F.count("*").alias("n"))


@query(
    "WITH t AS (SELECT page_id, string_split(split_part(split_part(url, '://', 2), '?', 1), '/') AS a FROM pages), "
    "e AS (SELECT page_id, i AS cut, array_to_string(list_slice(a, i, len(a)), '/') AS suf FROM (SELECT page_id, a, unnest(range(1, len(a) + 1)) AS i FROM t)), "
    "dict AS (SELECT DISTINCT split_part(split_part(split_part(url, '://', 2), '?', 1), '/', 3) AS suf FROM pages) "
    "SELECT page_id, arg_min(suf, cut) AS hit FROM e JOIN dict USING (suf) WHERE suf <> '' GROUP BY 1"
)
def suffix_lookup(spark, sf):
    pages = table(spark, sf, "pages")
    path = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1))
    dictionary = pages.select(F.split_part(path, F.lit("/"), F.lit(3)).alias("suf"))
    return xref.longest_suffix(pages, "page_id", path, dictionary)


@query(
    "SELECT doc_id, len(string_split(text, chr(10))) AS total_lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS code_lines FROM documents"
)
def text_line_metrics(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *corpus.line_counts(F.col("text")))


@query(
    "SELECT page_id, len(regexp_extract_all(html, '<p[ >]')) AS opened, len(regexp_extract_all(html, '</p>')) AS closed FROM pages "
    "WHERE len(regexp_extract_all(html, '<p[ >]')) <> len(regexp_extract_all(html, '</p>'))"
)
def tag_balance_rule(spark, sf):
    return corpus.unbalanced(table(spark, sf, "pages"), "page_id", F.col("html"), "<p[ >]", "</p>")


@query(
    "SELECT CASE event_type WHEN 'click' THEN 'OPC-UA' WHEN 'view' THEN 'S7comm' WHEN 'error' THEN 'ICMP' ELSE 'Other' END AS proto, "
    "count(*) AS packets, round(sum(value), 2) AS bytes FROM events GROUP BY 1"
)
def protocol_stats(spark, sf):
    e = F.col("event_type")
    l4 = F.when(e == "error", "ICMP").otherwise("TCP")
    port = F.when(e == "click", 4840).when(e == "view", 102).otherwise(1)
    return network.protocol_totals(table(spark, sf, "events"), network.protocol(l4, F.lit(0), port), "value")


@query(
    "WITH p AS (SELECT user_id AS src, (user_id * 7 + 3) % 150 AS dst, value FROM events) SELECT host, round(sum(b), 2) AS bytes, count(*) AS packets "
    "FROM (SELECT src AS host, value AS b FROM p UNION ALL SELECT dst, value FROM p) GROUP BY 1 ORDER BY bytes DESC, host LIMIT 10"
)
def top_talkers(spark, sf):
    u = F.col("user_id")
    return network.top_hosts(network.host_totals(table(spark, sf, "events"), u, (u * 7 + 3) % 150, "value"))


@query(
    "SELECT user_id, count(*) AS retrans FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev "
    "FROM events) WHERE event_type = prev GROUP BY 1"
)
def retransmission(spark, sf):
    return network.retransmissions(table(spark, sf, "events"), "user_id", ORDER, "event_type")


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS destinations FROM events GROUP BY 1")
def connections(spark, sf):
    found = network.destinations(table(spark, sf, "events"), "user_id", "event_type")
    return found.select("user_id", F.array_join("destinations", ",").alias("destinations"))


@query(
    "SELECT date_trunc('day', ts) AS w, event_type, count(*) AS packets, round(count(*) / 86400.0, 8) AS rate FROM events GROUP BY 1, 2"
)
def interval_rate(spark, sf):
    return network.interval_rate(table(spark, sf, "events"), "ts", "event_type", "day", 86400.0).withColumn(
        "w", F.col("w").cast("timestamp_ntz")
    )


@query(
    "SELECT user_id, CAST(sum(CASE WHEN v AND NOT p THEN 1 ELSE 0 END) AS BIGINT) AS rising, CAST(sum(CASE WHEN NOT v AND p THEN 1 ELSE 0 END) AS BIGINT) AS falling FROM "
    "(SELECT user_id, value > 50 AS v, coalesce(lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS p FROM events) GROUP BY 1"
)
def edge_detect(spark, sf):
    found = signals.edges(table(spark, sf, "events"), "user_id", ORDER, F.col("value") > 50)
    return found.groupBy("user_id").agg(F.count_if("rising").alias("rising"), F.count_if("falling").alias("falling"))


RUNS_SQL = (
    "x AS (SELECT *, value > 20 AS v, lag(value > 20) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "y AS (SELECT *, sum(CASE WHEN pv IS NULL OR pv <> v THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x)"
)


@query(
    f"WITH {RUNS_SQL} SELECT event_id, v AND epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) >= 14400000000 AS q FROM y"
)
def ton_timer(spark, sf):
    return signals.on_delay(table(spark, sf, "events"), "user_id", ORDER, F.col("value") > 20, 14_400_000_000).select("event_id", "q")


@query(
    "WITH x AS (SELECT *, value > 20 AS v, coalesce(lag(value > 20) OVER w, false) AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "y AS (SELECT *, max(CASE WHEN NOT v AND pv THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS fell FROM x) "
    "SELECT event_id, v OR coalesce(epoch_us(ts) - fell < 14400000000, false) AS q FROM y"
)
def tof_timer(spark, sf):
    return signals.off_delay(table(spark, sf, "events"), "user_id", ORDER, F.col("value") > 20, 14_400_000_000).select("event_id", "q")


@query(
    "WITH x AS (SELECT *, event_type = 'error' AS r, value > 20 AS v, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS dt FROM events), "
    "g AS (SELECT *, sum(CASE WHEN r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM x) "
    "SELECT event_id, CAST(sum(CASE WHEN v AND NOT r THEN coalesce(dt, 0) ELSE 0 END) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS et_us FROM g"
)
def tonr_timer(spark, sf):
    e = table(spark, sf, "events")
    return signals.retentive_on_delay(e, "user_id", ORDER, F.col("value") > 20, F.col("event_type") == "error").select("event_id", "et_us")


@query()
def tp_timer(spark, sf):
    return signals.pulse(table(spark, sf, "events"), "user_id", ORDER, F.col("value") > 20, 14_400_000_000).select("event_id", "q", "et_us")


@query(
    f"WITH {RUNS_SQL}, s AS (SELECT user_id, run, bool_and(v) AS v, min(epoch_us(ts)) AS t0 FROM y GROUP BY 1, 2), "
    "d AS (SELECT *, lead(t0) OVER (PARTITION BY user_id ORDER BY run) - t0 AS dur FROM s) SELECT user_id, count(dur) AS transitions, "
    "CAST(sum(CASE WHEN v THEN dur END) AS BIGINT) AS on_us, CAST(sum(CASE WHEN NOT v THEN dur END) AS BIGINT) AS off_us FROM d GROUP BY 1"
)
def flash_intervals(spark, sf):
    return signals.flash_intervals(table(spark, sf, "events"), "user_id", ORDER, F.col("value") > 20)


@query(
    "SELECT user_id, min(ts) AS met_at FROM events WHERE event_type = 'purchase' AND value > 100 GROUP BY 1"
)
def wait_until(spark, sf):
    return signals.wait_until(table(spark, sf, "events"), "user_id", "ts", F.expr("event_type = 'purchase' AND value > 100"))


@query(
    "SELECT user_id, bool_and(value < 300) AS stable, min(CASE WHEN value >= 300 THEN ts END) AS first_dev FROM events GROUP BY 1"
)
def assert_stable(spark, sf):
    return signals.stable(table(spark, sf, "events"), "user_id", "ts", F.col("value") < 300)


@query(
    "SELECT e.event_id FROM events e LEFT JOIN (SELECT user_id, min(ts) AS m FROM events WHERE value > 450 GROUP BY 1) t "
    "ON e.user_id = t.user_id WHERE m IS NULL OR ts <= m"
)
def capture_until(spark, sf):
    return signals.capture_until(table(spark, sf, "events"), "user_id", "ts", F.col("value") > 450).select("event_id")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def snapshot_latest(spark, sf):
    return signals.latest(table(spark, sf, "events"), ["user_id", "event_type"], "value", "event_id")


@query(
    "WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cyc FROM events), "
    "s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cyc DESC) AS back FROM c WHERE (cyc - 1) % 3 = 0) "
    "SELECT user_id, cyc, cyc * CAST(0.01 AS DOUBLE) AS t_rel_s, value FROM s WHERE back <= 16"
)
def ring_trace(spark, sf):
    return signals.ring_trace(table(spark, sf, "events"), "user_id", ORDER, "value", 3, 16, 0.01)


@query(
    "SELECT o_orderkey, (o_orderkey >> 3) & 1 = 1 AS x3, o_orderkey & 255 AS b0, (o_orderkey >> 8) & 255 AS b1 FROM orders"
)
def bit_slices(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        values.bit_slice(k, "X", 3).alias("x3"),
        values.bit_slice(k, "B", 0).alias("b0"),
        values.bit_slice(k, "B", 1).alias("b1"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN (l_partkey * 37) & 65535 >= 32768 THEN ((l_partkey * 37) & 65535) - 65536 "
    "ELSE (l_partkey * 37) & 65535 END AS int16 FROM lineitem"
)
def register_decode(spark, sf):
    reg = values.decode_register(F.col("l_partkey") * 37, "int16")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", reg.alias("int16"))


@query(
    "SELECT event_id, (value - 200) - 7 * floor((value - 200) / 7) AS m, CAST(trunc(value) AS BIGINT) AS t FROM events"
)
def expression_builtins(spark, sf):
    m = values.modulo(F.col("value") - 200, F.lit(7))
    return table(spark, sf, "events").select("event_id", m.alias("m"), values.BUILTINS["REAL_TO_DINT"](F.col("value")).alias("t"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def nested_json(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.sum(values.nested(F.col("props"), "k").cast("long")).alias("k"))


@query(
    "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed, "
    "count(*) FILTER (WHERE o_orderstatus = 'P') AS skipped, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 4) AS pass_rate FROM orders GROUP BY 1"
)
def outcome_rollup(spark, sf):
    s = F.col("o_orderstatus")
    return results.rollup(table(spark, sf, "orders"), "o_orderpriority", s == "F", s == "O", s == "P")


@query(
    "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS last FROM orders GROUP BY 1) p "
    "ON o_custkey = c_custkey WHERE last IS NULL OR last IN ('P', 'O')"
)
def last_failed(spark, sf):
    return results.to_rerun(
        table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", ["P", "O"]
    )


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN coalesce(bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, "
    "l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'SKIPPED' WHEN l_returnflag = 'R' THEN 'FAILED' "
    "ELSE 'PASSED' END AS outcome FROM lineitem"
)
def skip_after_failure(spark, sf):
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    found = results.skip_after_failure(table(spark, sf, "lineitem"), "l_orderkey", order, _writes())
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "outcome")


@query(
    "SELECT lang, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS h FROM documents GROUP BY 1"
)
def fingerprint(spark, sf):
    return results.fingerprint(table(spark, sf, "documents"), "lang", F.col("doc_id"), "text", ":")


@query(
    "WITH u AS (SELECT user_id AS block, event_id AS line FROM events WHERE event_type = 'view'), "
    "a AS (SELECT user_id AS block, event_id AS line, value FROM events WHERE event_type = 'purchase') "
    "SELECT u.block, u.line, a.value AS resolved FROM u ASOF LEFT JOIN a ON u.block = a.block AND u.line > a.line"
)
def index_as_of(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("block"), F.lit("i").alias("var"), F.col("event_id").alias("line"), "value", "event_type")
    found = xref.resolve_as_of(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"))
    return found.select("block", "line", "resolved")


@query(
    "SELECT prefix, depth, count(*) AS leaves FROM (SELECT unnest([host, host || '/' || a]) AS prefix, unnest([0, 1]) AS depth FROM "
    "(SELECT split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS a FROM pages)) GROUP BY 1, 2"
)
def path_tree(spark, sf):
    part = lambda i: F.split_part("url", F.lit("/"), F.lit(i))
    leaf = table(spark, sf, "pages").select(F.concat_ws("/", part(3), part(4), F.lit("leaf")).alias("path"))
    return graph.path_tree(leaf, "/")


@query(
    "SELECT doc_id, 1 + len(regexp_extract_all(text, '(?i)\\b(if|elsif|for|while|repeat|and|or)\\b')) AS complexity FROM documents"
)
def keyword_complexity(spark, sf):
    return table(spark, sf, "documents").select("doc_id", corpus.keyword_complexity(F.col("text")).alias("complexity"))


@query("SELECT c_custkey, CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS number, lower(replace(c_mktsegment, ' ', '_')) AS slug FROM customer")
def name_functions(spark, sf):
    number = names.first_number(F.col("c_name"))
    return table(spark, sf, "customer").select(
        "c_custkey", number.alias("number"), F.lower(names.normalize_mnemonic(F.col("c_mktsegment"))).alias("slug")
    )


from fieldloom.plans import catalogue_facts, catalogue_files, catalogue_names  # noqa: E402  (their queries register here)

QUERIES |= catalogue_facts.QUERIES | catalogue_files.QUERIES | catalogue_names.QUERIES
ORACLE_SQL |= catalogue_facts.ORACLE_SQL | catalogue_files.ORACLE_SQL | catalogue_names.ORACLE_SQL
