"""Queries of tracing, rules, lists and look-ups, with their SQL.

``lineitem`` stands for accesses (block ``l_suppkey``, statement ``l_orderkey``,
path ``l_partkey``, a write where ``l_returnflag`` is R), ``part`` and
``customer`` for variables and tags, ``documents`` for sources, ``events`` for
samples.  Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import browse, rules, signals, traces, xref
from fieldloom.plans.scratch import Queries, table

QUERIES: Queries = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def accesses(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("block"), F.col("l_orderkey").alias("statement"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("path"), (F.col("l_returnflag") == "R").alias("is_write"),
    )


def flows(spark, sf) -> DataFrame:
    return traces.statement_flows(accesses(spark, sf), "statement")


FLOWS_SQL = (
    "flows AS (SELECT DISTINCT r.l_partkey AS src, w.l_partkey AS dst FROM lineitem r JOIN lineitem w ON w.l_orderkey = r.l_orderkey "
    "WHERE r.l_returnflag <> 'R' AND w.l_returnflag = 'R' AND r.l_partkey <> w.l_partkey)"
)


@query(
    f"WITH RECURSIVE {FLOWS_SQL}, stops AS (SELECT p_partkey AS field, CASE WHEN p_type = 'PROMO' THEN 'STATE_VAR' ELSE 'IO_TAG' END AS why FROM part WHERE p_type = 'PROMO' OR p_brand = 'Brand#11'), "
    "r AS (SELECT p_partkey AS root, p_partkey AS field, 0 AS depth FROM part WHERE p_brand = 'Brand#1' UNION "
    "SELECT r.root, f.dst, r.depth + 1 FROM r JOIN flows f ON f.src = r.field WHERE r.depth < 2 AND r.field NOT IN (SELECT field FROM stops)), "
    "m AS (SELECT root, field, min(depth) AS depth FROM r GROUP BY 1, 2) "
    "SELECT root, m.field, depth, CASE WHEN depth >= 2 THEN 'MAX_DEPTH' ELSE why END AS why FROM m LEFT JOIN stops ON stops.field = m.field"
)
def trace_forward_stops(spark, sf):
    p = table(spark, sf, "part")
    why = F.when(F.col("p_type") == "PROMO", "STATE_VAR").when(F.col("p_brand") == "Brand#11", "IO_TAG")
    stops = p.select(F.col("p_partkey").alias("field"), why.alias("why")).where("why is not null")
    starts = p.where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("root"), F.col("p_partkey").alias("field"))
    return traces.trace(flows(spark, sf), starts, 2, stops).select("root", "field", "depth", "why")


@query(
    f"WITH RECURSIVE {FLOWS_SQL}, r AS (SELECT p_partkey AS root, p_partkey AS field, 0 AS depth FROM part WHERE p_brand = 'Brand#2' UNION "
    "SELECT r.root, f.src, r.depth + 1 FROM r JOIN flows f ON f.dst = r.field WHERE r.depth < 2), "
    "m AS (SELECT root, field, min(depth) AS depth FROM r GROUP BY 1, 2) "
    "SELECT m.root, m.field, m.depth, min(p.field) AS parent FROM m LEFT JOIN (SELECT m.root, m.field, m.depth, f.src FROM m JOIN flows f ON f.dst = m.field) p "
    "ON p.root = m.root AND p.depth = m.depth - 1 AND p.src = m.field GROUP BY 1, 2, 3"
)
def trace_backward_parents(spark, sf):
    starts = table(spark, sf, "part").where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("root"), F.col("p_partkey").alias("field"))
    return traces.trace(flows(spark, sf), starts, 2, backward=True).select("root", "field", "depth", "parent")


CHAIN_SQL = (
    "best AS (SELECT l_partkey AS dst, min(l_orderkey) AS o FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), "
    "flows AS (SELECT DISTINCT l.l_partkey AS src, b.dst FROM best b JOIN lineitem l ON l.l_orderkey = b.o WHERE l.l_returnflag <> 'R' AND l.l_partkey <> b.dst)"
)


@query(
    f"WITH RECURSIVE {CHAIN_SQL}, r AS (SELECT p_partkey AS root, p_partkey AS field, 0 AS depth FROM part UNION "
    "SELECT r.root, f.src, r.depth + 1 FROM r JOIN flows f ON f.dst = r.field WHERE r.depth < 4) "
    "SELECT root, max(depth) AS depth, count(*) AS nodes FROM (SELECT root, field, min(depth) AS depth FROM r GROUP BY 1, 2) GROUP BY 1"
)
def dependency_chains(spark, sf):
    chains = traces.chain_flows(accesses(spark, sf), ["statement"], "statement", "block", "line")
    p = F.col("p_partkey")
    starts = table(spark, sf, "part").select(p.alias("root"), p.alias("field"))
    return traces.chain_depth(traces.trace(chains, starts, 4, backward=True))


@query(
    f"WITH RECURSIVE {CHAIN_SQL}, r AS (SELECT p_partkey AS root, p_partkey AS field, 0 AS depth FROM part UNION "
    "SELECT r.root, f.src, r.depth + 1 FROM r JOIN flows f ON f.dst = r.field WHERE r.depth < 3), "
    "m AS (SELECT root, field, min(depth) AS depth FROM r GROUP BY 1, 2), "
    "p AS (SELECT a.root, a.field, min(f.dst) AS parent FROM m a JOIN flows f ON f.src = a.field JOIN m b ON b.root = a.root AND b.field = f.dst AND b.depth = a.depth - 1 GROUP BY 1, 2) "
    "SELECT root, field, depth FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.root = m.root AND p.parent = m.field)"
)
def tree_leaves(spark, sf):
    chains = traces.chain_flows(accesses(spark, sf), ["statement"], "statement", "block", "line")
    p = F.col("p_partkey")
    starts = table(spark, sf, "part").select(p.alias("root"), p.alias("field"))
    return traces.leaves(traces.trace(chains, starts, 3, backward=True)).select("root", "field", "depth")


@query(
    "SELECT p_partkey AS field_id, l_suppkey AS block, l_orderkey AS statement, CASE WHEN bool_and(l_returnflag = 'R') THEN 'write' ELSE 'read' END AS access "
    "FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'ECONOMY' GROUP BY 1, 2, 3, l_linenumber"
)
def field_usages(spark, sf):
    path = lambda index, key: F.concat(F.lit('"db".arms['), F.col(index).cast("string"), F.lit("].p"), F.col(key).cast("string"))
    used = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("block"), F.col("l_orderkey").alias("statement"), F.col("l_linenumber").alias("line"),
        path("l_linenumber", "l_partkey").alias("path"), (F.col("l_returnflag") == "R").alias("is_write"),
    )
    fields = table(spark, sf, "part").where("p_type = 'ECONOMY'").select(path("p_size", "p_partkey").alias("field"))
    found = traces.usages(used, fields, exclude_writes=False)
    return found.select(F.regexp_extract("field", r"p(\d+)$", 1).cast("long").alias("field_id"), "block", "statement", "access")


@query(
    "SELECT DISTINCT a.s_nationkey AS page, l_suppkey AS src, l_partkey % 100 AS dst FROM lineitem JOIN supplier a ON a.s_suppkey = l_suppkey "
    "JOIN supplier b ON b.s_suppkey = l_partkey % 100 AND b.s_nationkey = a.s_nationkey"
)
def page_dependencies(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"))
    members = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("page"), F.col("s_suppkey").alias("n"))
    return traces.edges_inside(edges, members, "page")


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT p_brand AS src, p_type AS dst FROM part WHERE p_size > 25), t AS (SELECT DISTINCT p_brand AS t FROM part UNION SELECT DISTINCT p_type FROM part), "
    "u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT t AS n, t AS root FROM t UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.n), "
    "c AS (SELECT n, min(root) AS c FROM r GROUP BY 1), d AS (SELECT n, c, (SELECT count(*) FROM e WHERE e.src = n) AS o FROM c) "
    "SELECT (SELECT x.n FROM d x WHERE x.c = d.c ORDER BY x.o DESC, x.n LIMIT 1) AS name, count(*) AS size FROM d GROUP BY c"
)
def type_components(spark, sf):
    p = table(spark, sf, "part")
    known = p.select(F.col("p_brand").alias("type")).union(p.select("p_type")).distinct()
    members = p.where("p_size > 25").select(F.col("p_brand").alias("type"), F.concat(F.lit('Array[0..3] of "'), "p_type", F.lit('"')).alias("data_type"))
    return traces.type_components(known, traces.type_edges(members, known)).select("name", "size")


@query(
    "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'io_tag' WHEN 'MACHINERY' THEN 'state_var' WHEN 'HOUSEHOLD' THEN 'state_var' WHEN 'FURNITURE' THEN 'local' ELSE 'field' END AS kind FROM customer"
)
def variable_kinds(spark, sf):
    s = F.col("c_mktsegment")
    name = (
        F.when(s == "BUILDING", F.concat(F.lit('"SDO_'), "c_name", F.lit('"')))
        .when(s == "MACHINERY", F.concat(F.lit('"db" . unit [ # i ] . status . motionMode.'), "c_name"))
        .when(s == "HOUSEHOLD", F.lit("#activeState"))
        .when(s == "FURNITURE", F.concat(F.lit("#"), "c_name"))
        .otherwise(F.concat(F.lit('"db".'), "c_name"))
    )
    return table(spark, sf, "customer").select("c_custkey", traces.variable_kind(name).alias("kind"))


@query(
    "SELECT doc_id, NOT ends_with(text, '[') AND length(text) - length(replace(text, '[', '')) = length(text) - length(replace(text, ']', '')) AND trim(text) <> '' AS valid FROM documents WHERE text IS NOT NULL"
)
def valid_paths(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", traces.valid_path(F.col("text")).alias("valid"))


@query(
    "WITH v AS (SELECT l_partkey AS var, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS writers, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_suppkey END) AS readers FROM lineitem GROUP BY 1) "
    "SELECT 'db.' || var AS full_reference, CASE WHEN readers > 0 AND writers > 0 THEN 'R/W' WHEN writers > 0 THEN 'W' ELSE 'R' END AS access_type, readers, writers, "
    "CASE WHEN writers > 1 THEN 1 ELSE 0 END + CASE WHEN (writers > 0) <> (readers > 0) THEN 1 ELSE 0 END AS violation_count FROM v "
    "WHERE contains('db.' || var, '7') AND (writers > 1 OR (writers > 0) <> (readers > 0))"
)
def variable_list(spark, sf):
    rw = xref.readers_writers(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey", F.col("l_returnflag") == "R")
    named = F.concat(F.lit("db."), F.col("var").cast("string"))
    found = xref.audit(rw).select(named.alias("full_reference"))
    variables = rw.select(named.alias("full_reference"), F.lit("db").alias("db_name"), "readers", "writers")
    return browse.variable_list(variables, found, db="db", search="7", has_violations=True).drop("db_name")


@query("SELECT c_nationkey AS db_name, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS fields FROM customer GROUP BY 1")
def db_summary(spark, sf):
    refs = table(spark, sf, "customer").select(F.col("c_nationkey").alias("db_name"), F.col("c_mktsegment").alias("field_path"))
    return browse.db_summary(refs).select("db_name", F.array_join("fields", ",").alias("fields"))


LINES_SQL = "regexp_split_to_array(regexp_replace(text, '(?:\\r\\n|\\n|\\r)$', ''), '\\r\\n|\\n|\\r')"


@query(
    f"WITH d AS (SELECT doc_id AS block, {LINES_SQL} AS l, length(text) AS n FROM documents WHERE text IS NOT NULL), t AS (SELECT *, CASE WHEN n > 0 THEN len(l) ELSE 0 END AS total_lines FROM d) "
    "SELECT block, array_to_string(list_slice(l, 3, least(total_lines, 7)), chr(10)) AS source, total_lines, 3 AS start_line, least(total_lines, 7) AS end_line FROM t"
)
def source_excerpt(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    return browse.excerpt(docs.select(F.col("doc_id").alias("block"), "text"), 5, 2)


@query("SELECT o_orderkey, abs(o_totalprice - round(o_totalprice / 10) * 10) <= 2.5 AS ok FROM orders")
def tolerance_match(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", browse.values_match(price, F.round(price / 10) * 10, 2.5).alias("ok"))


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), 'machin') OR contains(lower(c_mktsegment), 'machin')")
def scenario_filter(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.concat(F.lit("a/b/"), "c_mktsegment", F.lit(".yaml")).alias("source_file"))
    return browse.select_scenarios(rows, "Machin").select("c_custkey")


@query(
    "WITH p AS (SELECT CASE p_type WHEN 'ECONOMY' THEN 'arms.' || p_size WHEN 'PROMO' THEN 'safety_arms.' || p_size WHEN 'STANDARD' THEN 'drive' ELSE 'global' END AS section FROM part) "
    "SELECT section, count(*) AS entries FROM p GROUP BY 1"
)
def parameter_sections(spark, sf):
    t, n = F.col("p_type"), F.col("p_size").cast("string")
    path = (
        F.when(t == "ECONOMY", F.concat(F.lit("db.arms["), n, F.lit("].speed")))
        .when(t == "PROMO", F.concat(F.lit("db.arm"), n, F.lit(".speed")))
        .when(t == "STANDARD", F.lit("db.drive.ramp"))
        .otherwise(F.lit("db.other"))
    )
    found = table(spark, sf, "part").select(browse.parameter_section(path, "db").alias("section"))
    return found.groupBy("section").agg(F.count("*").alias("entries"))


@query("SELECT p_size AS index, arg_max(p_name, p_partkey) AS value FROM part GROUP BY 1")
def indexed_parameters(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit("db.arms["), F.col("p_size").cast("string"), F.lit("].type")).alias("qualified_path"), F.col("p_name").alias("value")
    )
    return browse.indexed_values(rows, "db", "type")


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 20")
def first_of_each_class(spark, sf):
    return browse.first_of_each(table(spark, sf, "events").select("event_type", "event_id"), "event_type", "event_id")


@query(
    "SELECT l_orderkey AS scenario, count(*) AS steps, count(*) FILTER (WHERE l_returnflag = 'A') AS passed, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, count(*) FILTER (WHERE l_returnflag = 'N') AS skipped, "
    "CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 'FAILED' WHEN count(*) FILTER (WHERE l_returnflag = 'N') = count(*) THEN 'SKIPPED' ELSE 'PASSED' END AS outcome FROM lineitem GROUP BY 1"
)
def suite_summary(spark, sf):
    f = F.col("l_returnflag")
    outcome = F.when(f == "A", "PASSED").when(f == "R", "FAILED").otherwise("SKIPPED")
    steps = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scenario"), outcome.alias("outcome"), F.lit(1.0).alias("duration_s"))
    return browse.suite_summary(steps).drop("duration_s")


@query("SELECT DISTINCT l_suppkey AS block, l_partkey AS name FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_suppkey = a.l_suppkey AND b.l_partkey = a.l_partkey AND b.l_returnflag = 'R')")
def undefined_names(spark, sf):
    a = accesses(spark, sf).select("block", F.col("path").alias("name"), "is_write")
    return browse.undefined_names(a, a.where("is_write"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def kinds_by_frequency(spark, sf):
    return browse.by_frequency(table(spark, sf, "part"), "p_type")


VARIABLES_SQL = (
    "v AS (SELECT p_brand AS block, p_size > 25 AS is_constant, CASE WHEN p_type = 'PROMO' THEN upper(replace(p_name, ' ', '_')) ELSE replace(p_name, ' ', '') END AS name FROM part)"
)


def variables(spark, sf) -> DataFrame:
    name = F.when(F.col("p_type") == "PROMO", F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))).otherwise(F.replace("p_name", F.lit(" "), F.lit("")))
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("block"), F.when(F.col("p_size") < 10, "VAR_INPUT").otherwise("VAR").alias("section"), (F.col("p_size") > 25).alias("is_constant"),
        name.alias("name"), F.lit("Int").alias("data_type"), F.col("p_partkey").cast("int").alias("line"),
    )


RULES_SQL = (
    "hits AS (SELECT block, 'N001' AS rule_code FROM v WHERE NOT is_constant AND NOT regexp_full_match(name, '[a-z][a-zA-Z0-9]*') UNION ALL "
    "SELECT block, 'N004' FROM v WHERE is_constant AND NOT regexp_full_match(name, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)*'))"
)


@query(f"WITH {VARIABLES_SQL}, {RULES_SQL} SELECT rule_code, count(*) AS violations, count(DISTINCT block) AS subjects FROM hits GROUP BY 1")
def naming_rules(spark, sf):
    return rules.violation_counts(rules.variable_rules(variables(spark, sf)))


@query(f"WITH {VARIABLES_SQL}, {RULES_SQL} SELECT count(*) AS total, 0 AS errors, count(*) AS warnings, 0 AS infos, 0 AS subjects_with_errors FROM hits")
def violation_summary(spark, sf):
    return rules.violation_summary(rules.variable_rules(variables(spark, sf)))


@query(
    "WITH c AS (SELECT p_brand AS block, count(*) AS n, count(*) FILTER (WHERE p_size < 10) AS p FROM part GROUP BY 1) "
    "SELECT 'C004' AS rule_code, block AS subject FROM c WHERE n > 30 UNION ALL SELECT 'C005', block FROM c WHERE p > 10"
)
def count_rules(spark, sf):
    return rules.count_rules(variables(spark, sf)).select("rule_code", "subject")


@query(
    "WITH h AS (SELECT page_id, contains(html, '<title>') AS has, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS d, regexp_extract(html, 'ad ([0-9]+)', 1) AS a FROM pages) "
    "SELECT page_id AS subject, unnest(list_filter([CASE WHEN NOT has THEN 'D001' END, CASE WHEN has AND trim(title) = '' THEN 'D002' END, CASE WHEN trim(d) = '' THEN 'D003' END, 'D004', CASE WHEN has AND trim(a) = '' THEN 'D005' END], "
    "lambda x: x IS NOT NULL AND (x <> 'D004' OR has))) AS rule_code FROM h"
)
def header_rules(spark, sf):
    h = table(spark, sf, "pages")
    found = h.select(
        F.col("page_id").alias("block"), F.lit("FUNCTION").alias("block_type"), F.col("html").contains("<title>").alias("has_header"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("description"),
        F.lit(None).cast("string").alias("changelog"), F.regexp_extract("html", "ad ([0-9]+)", 1).alias("author"),
    )
    return rules.header_rules(found).select("subject", "rule_code")


@query(
    "SELECT doc_id AS subject, idx AS message FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\[\\s*(\\d+)\\s*\\]', 1)) AS idx FROM documents) WHERE idx <> '1'"
)
def hardcoded_indices(spark, sf):
    found = rules.hardcoded_indices(table(spark, sf, "documents").select(F.col("doc_id").alias("block"), "text"))
    return found.select("subject", F.regexp_replace("message", "^hardcoded index ", "").alias("message"))


@query(
    "WITH w AS (SELECT e.* FROM events e JOIN (SELECT user_id, min(ts) AS b FROM events GROUP BY 1) f ON f.user_id = e.user_id AND epoch_us(e.ts) <= epoch_us(f.b) + 864000000000), "
    "g AS (SELECT user_id, bool_or(value > 150) AS met, arg_min(event_id, ts) FILTER (WHERE value > 150) AS f, arg_max(event_id, ts) AS l FROM w GROUP BY 1) "
    "SELECT g.user_id, met, e.ts AS at, e.value FROM g JOIN events e ON e.event_id = CASE WHEN met THEN f ELSE l END"
)
def wait_until_timeout(spark, sf):
    return signals.wait_outcome(table(spark, sf, "events"), "user_id", "ts", "value", F.col("value") > 150, 864000)


@query(
    "WITH w AS (SELECT e.* FROM events e JOIN (SELECT user_id, min(ts) AS b FROM events GROUP BY 1) f ON f.user_id = e.user_id AND epoch_us(e.ts) <= epoch_us(f.b) + 432000000000) "
    "SELECT user_id, bool_and(value < 100) AS stable, min(CASE WHEN value >= 100 THEN ts END) AS first_dev FROM w GROUP BY 1"
)
def assert_stable_window(spark, sf):
    return signals.stable(table(spark, sf, "events"), "user_id", "ts", F.col("value") < 100, 432000)
