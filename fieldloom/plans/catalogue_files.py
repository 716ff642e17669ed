"""Queries of ladder scans, block runs, file checks, headers and labels, with their SQL.

Texts are built from columns of ``part`` and ``customer``, so that the SQL knows
what they say without reading them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import names
from fieldloom.lang import execute, ladder, parser
from fieldloom.operators import browse, formats, headers
from fieldloom.plans.scratch import Queries, table

QUERIES: Queries = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


#: A line that is large, or returned and not open, raises an alarm; a small one leaves before the level is worked out.
LADDER = """
NETWORK
  RUNG wire#powerrail
    GT_Contact( in1 := #quantity, in2 := 40 )
    wire#w1
    I_Contact( #open )
    Coil( #alarm )
  END_RUNG
  RUNG wire#powerrail
    Contact( #returned )
  END_RUNG wire#w1
END_NETWORK
NETWORK
  RUNG wire#powerrail
    Move( in := 0, out1 => #level )
  END_RUNG
  RUNG wire#powerrail
    LT_Contact( in1 := #quantity, in2 := 10 )
    JumpCoil( END )
  END_RUNG
  RUNG wire#powerrail
    Div( in1 := #quantity, in2 := 7, out => #level )
    Sub( in1 := #level, in2 := #line, out => #level )
  END_RUNG
  RUNG wire#powerrail
    Contact( #alarm )
    Neg( in := #level, out => #level )
  END_RUNG
  Label(END)
  RUNG wire#powerrail
    EQ_Contact( in1 := #level, in2 := 0 )
    Coil( #idle )
  END_RUNG
END_NETWORK
"""


@query(
    "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS q, (l_quantity > 40 OR l_returnflag = 'R') AND l_linestatus <> 'O' AS alarm FROM lineitem), "
    "y AS (SELECT *, CASE WHEN q < 10 THEN 0 WHEN alarm THEN -(q // 7 - l_linenumber) ELSE q // 7 - l_linenumber END AS level FROM x) "
    "SELECT l_orderkey, l_linenumber, l_partkey, alarm, level, level = 0 AS idle FROM y"
)
def ladder_scan(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_linestatus") == "O").alias("open"),
        (F.col("l_returnflag") == "R").alias("returned"),
        F.lit(False).alias("alarm"),
        F.lit(-1).alias("level"),
        F.col("l_linenumber").cast("int").alias("line"),
        F.lit(False).alias("idle"),
    )
    return ladder.run_program(lines, ladder.program(LADDER)).select("l_orderkey", "l_linenumber", "l_partkey", "alarm", "level", "idle")


def _block_files(spark, sf):
    """A file a part: its kind, its name, its pragma and its form follow from columns."""
    t, k = F.col("p_type"), F.col("p_partkey")
    kind = F.when(t == "ECONOMY", "FUNCTION_BLOCK").when(t == "PROMO", "DATA_BLOCK").when(t == "STANDARD", "TYPE").otherwise("FUNCTION")
    mode = F.when(k % 2 == 0, 'S7_EditorMode := "SCL";\n').otherwise("")
    kept = F.when(k % 3 == 0, 'S7_Optimized := "TRUE";\n').otherwise("")
    name = F.concat(F.lit("Part"), k.cast("string"))
    head = F.when(t == "STANDARD", F.concat(F.lit("TYPE\n  "), name, F.lit(" : STRUCT\n"))).otherwise(F.concat(kind, F.lit(' "'), name, F.lit('"\n')))
    text = F.concat(
        F.lit("{\n"), mode, kept, F.lit('}\n(* FUNCTION "hidden" *)\n'), head,
        F.when(k % 7 == 0, 'FUNCTION "second"\n').otherwise("// BEGIN\n"), F.when(k % 11 == 0, "BEGIN\n").otherwise(""),
    )
    path = F.concat(F.lit("blocks/"), F.when(k % 5 == 0, "Other").otherwise(name), F.lit(".s7dcl"))
    return table(spark, sf, "part").select("p_partkey", path.alias("file"), F.concat_ws("/", F.lit("p"), k.cast("string"), path).alias("path"), text.alias("text"))


@query(
    "WITH x AS (SELECT p_partkey AS k, p_type AS t, 4 + CAST(p_partkey % 2 = 0 AS INTEGER) + CAST(p_partkey % 3 = 0 AS INTEGER) AS pos FROM part), f AS ("
    "SELECT k, NULL AS line, 'F010' AS code, 'ERROR' AS severity FROM x WHERE k % 11 = 0 "
    "UNION ALL SELECT k, pos + CASE WHEN t = 'STANDARD' THEN 2 ELSE 1 END, 'F011', 'ERROR' FROM x WHERE k % 11 <> 0 AND k % 7 = 0 "
    "UNION ALL SELECT k, pos, 'F012', 'ERROR' FROM x WHERE k % 11 <> 0 AND k % 5 = 0 "
    "UNION ALL SELECT k, pos, 'F020', 'ERROR' FROM x WHERE k % 11 <> 0 AND t NOT IN ('PROMO', 'STANDARD') AND k % 2 <> 0 "
    "UNION ALL SELECT k, pos, 'F020', 'ERROR' FROM x WHERE k % 11 <> 0 AND t = 'PROMO' "
    "UNION ALL SELECT k, pos, 'F021', 'WARNING' FROM x WHERE k % 11 <> 0 AND t <> 'STANDARD' AND k % 3 <> 0) "
    "SELECT k AS p_partkey, line, code, severity FROM f"
)
def format_findings(spark, sf):
    found = formats.text_findings(_block_files(spark, sf))
    return found.select(F.split("path", "/")[1].cast("long").alias("p_partkey"), "line", "code", "severity")


@query(
    "SELECT p_partkey, p_name AS title, 'size ' || p_size AS comment, '' AS library, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS author, "
    "'(c) 2025 ' || p_type AS copyright, 1 + p_partkey % 2 AS changes, CASE WHEN p_partkey % 2 = 1 THEN 'v2.0' ELSE 'v1.0' END AS last_version FROM part"
)
def header_fields(spark, sf):
    k = F.col("p_partkey")
    text = F.concat(
        F.lit("FUNCTION\nREGION Block info header\n//----+----\n// Title:   "), F.col("p_name"), F.lit("\n// Comment/Function: size "), F.col("p_size").cast("string"),
        F.lit("\n// "), F.col("p_type"), F.lit(" / (c)Copyright 2025\n"), F.when(k % 2 == 0, F.concat(F.lit("// Author: "), F.col("p_brand"), F.lit("\n"))).otherwise(""),
        F.lit("// Change log table:\n// Version | Date | Expert | Changes\n//----|----\n// v1.0 | 2024 | me | first\n"),
        F.when(k % 2 == 1, "// | v2.0 | 2025 | you | second |\n").otherwise(""), F.lit("END_REGION\n"),
    )
    found = headers.block_headers(table(spark, sf, "part").select("p_partkey", text.alias("text")))
    return found.select(
        "p_partkey", "title", "comment", "library", "author", "copyright", F.size("changelog").cast("long").alias("changes"), F.element_at("changelog", -1)["version"].alias("last_version")
    )


@query(
    "SELECT c_custkey, 'HS-' || c_custkey || 'A' AS bare, 'HS' AS tag_type, c_custkey || 'A' AS code, 'st_' || c_nationkey AS state, "
    "'mode = ' || c_nationkey || ' AND level != 2' AS condition FROM customer"
)
def diagram_names(spark, sf):
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    bare = names.without_project(F.concat(F.lit("021-HS-"), k, F.lit("A")))
    tag = names.instrument(bare)
    return table(spark, sf, "customer").select(
        "c_custkey",
        bare.alias("bare"),
        tag["tag_type"].alias("tag_type"),
        tag["code"].alias("code"),
        names.state_name(F.concat(F.lit(' #"st_'), n, F.lit('" '))).alias("state"),
        names.short_condition(F.concat(F.lit('( "Data".user.mode='), n, F.lit(' AND "Data".level<>2 )'))).alias("condition"),
    )


@query(
    "WITH n AS (SELECT n_nationkey, max(CASE WHEN c_custkey % 3 = 0 THEN c_name END) AS named FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) "
    'SELECT n_nationkey AS "index", CASE WHEN n_nationkey % 4 = 0 THEN \'unit \' || n_nationkey ELSE coalesce(named, \'Unit \' || n_nationkey) END AS label FROM n'
)
def unit_labels(spark, sf):
    units = table(spark, sf, "nation").select(F.col("n_nationkey").alias("index"))
    configured = units.where("index % 4 = 0").select("index", F.concat(F.lit("unit "), F.col("index").cast("string")).alias("label"))
    customers = table(spark, sf, "customer").where("c_custkey % 3 = 0")
    named = customers.groupBy(F.col("c_nationkey").alias("index")).agg(F.concat(F.lit("'"), F.max("c_name"), F.lit("'")).alias("value"))
    return browse.unit_labels(units, configured, named)


#: A charge by quantity and priority, in a loop the steps of a discount.
CHARGE = """
FUNCTION "Charge"
VAR_INPUT
  quantity : Int;
  line : Int;
END_VAR
VAR_OUTPUT
  charge : Int;
END_VAR
VAR_TEMP
  i : Int;
  rate : Int := 3;
END_VAR
BEGIN
CASE #line OF
  1: #rate := 10;
  2..4: #rate := 7;
END_CASE;
IF #quantity > 30 THEN
  #charge := #quantity * #rate - 30;
ELSIF #quantity > 10 THEN
  #charge := #quantity * #rate;
END_IF;
FOR #i := 1 TO #line DO
  #charge += #i * 2;
END_FOR;
END_FUNCTION
"""


@query(
    "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS q, l_linenumber AS n, CASE WHEN l_linenumber = 1 THEN 10 WHEN l_linenumber BETWEEN 2 AND 4 THEN 7 ELSE 3 END AS rate FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN q > 30 THEN q * rate - 30 WHEN q > 10 THEN q * rate ELSE 0 END + n * (n + 1) AS charge FROM x"
)
def block_function(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("quantity"), F.col("l_linenumber").cast("int").alias("line"))
    return execute.run_function(lines, parser.parse_block(CHARGE)).select("l_orderkey", "l_linenumber", "l_partkey", "charge")


#: Rising values, and how many cycles ago the counter began.
RISING = """
FUNCTION_BLOCK "Rising"
VAR_INPUT
  value : LReal;
END_VAR
VAR_OUTPUT
  rises : Int;
  cycles : Int;
END_VAR
VAR
  before : LReal;
END_VAR
BEGIN
IF #cycles > 0 AND #value > #before THEN
  #rises := #rises + 1;
END_IF;
#before := #value;
#cycles := #cycles + 1;
END_FUNCTION_BLOCK
"""


@query(
    "WITH x AS (SELECT event_id, user_id, ts, value, value > lag(value) OVER w AS rose, row_number() OVER w AS cycles FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) "
    "SELECT event_id, cycles, sum(CASE WHEN rose THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY cycles) AS rises FROM x"
)
def block_cycles(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return execute.run_cycles(events, parser.parse_block(RISING), "user_id", ("ts", "event_id")).select("event_id", "cycles", "rises")
