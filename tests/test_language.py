import pytest
from pyspark.sql import functions as F

from fieldloom.lang import columns, facts, lexer, parser
from fieldloom.operators import corpus
from fieldloom.sources import corpus as scan

BLOCK = """{ S7_Version := "1.0" }
FUNCTION_BLOCK "PumpControl"
VAR_INPUT
  start : Bool;
  level : Int := 5;
END_VAR
VAR CONSTANT
  IDLE : Int := 0;
  RUN : Int := 1;
END_VAR
VAR
  state : Int;
  timer : TON_TIME;
END_VAR
NETWORK
REGION Main loop
  // a comment
  CASE #state OF
    #IDLE: IF #start AND "dbPlant".tank[1].level > 10 THEN #state := #RUN; END_IF;
    #RUN: #timer(IN := #start, PT := T#2s, Q => "dbPlant".done);
      IF NOT #start THEN #state := #IDLE; END_IF;
    ELSE ;
  END_CASE;
END_REGION
FOR #i := 0 TO 3 DO #sum += "dbPlant".tank[#i].level; END_FOR;
?? nonsense here;
END_FUNCTION_BLOCK
"""


def test_block_facts():
    b = parser.parse_block(BLOCK)
    assert (b.kind, b.name, b.networks, b.attributes["S7_Version"]) == ("FUNCTION_BLOCK", "PumpControl", 1, "1.0")
    assert [(v.name, v.section, v.default) for v in b.variables][:3] == [("start", "VAR_INPUT", None), ("level", "VAR_INPUT", "5"), ("IDLE", "CONSTANT", "0")]
    got = {(a.path, a.kind) for a in facts.accesses(b)}
    assert {('"dbPlant".tank[1].level', "read"), ('"dbPlant".done', "write"), ("#state", "write"), ("#sum", "read"), ("#i", "write")} <= got
    assert facts.calls(b) == [("timer", "instance", 20)]
    states, moves = facts.state_machine(b)
    assert states == [("IDLE", "0"), ("RUN", "1")] and [(a, z) for a, z, _ in moves] == [("IDLE", "RUN"), ("RUN", "IDLE")]
    assert facts.unread_tokens(b) == 4
    assert ("#state", "#RUN", '#state = #IDLE AND #start AND "dbPlant".tank[1].level > 10', 19) in facts.assignments(b)


def test_lexer_loses_nothing():
    text = "a:=16#FF+T#1h30m; (* c\nc *) 'x$'y' %I1.0 \"q r\" é ~ 1..3"
    kept = "".join(t.value for t in lexer.tokenize(text, keep_newlines=True, keep_comments=True))
    assert kept.replace(" ", "") == text.replace(" ", "")


@pytest.mark.parametrize(
    "source,value",
    [
        ("1 + 2 * 3 ** 2", 19.0), ("-7 MOD 3", 2.0), ("7 MOD -3", -2.0), ("2 ** 3 ** 2", 512.0), ("7 / 2", 3.5), ("16#FF", 255), ("INT#16#0F", 15),
        ("T#1m2s500ms", 62.5), ("NOT FALSE AND 3 > 2 OR FALSE", True), ("ABS(-4)", 4), ("LREAL_TO_INT(-3.7)", -3), ("#a * 2 + 1", 21), ("1 <> 2", True),
    ],
)
def test_expressions(spark, source, value):
    row = spark.sql("select 10 as a").select(columns.expression(source).alias("v")).first()
    assert float(row.v) == pytest.approx(float(value)) if not isinstance(value, bool) else row.v is value


def test_refused_expressions():
    for bad in ("1 +", "a XOR b", "foo(1)"):
        with pytest.raises(ValueError):
            columns.expression(bad)


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "blocks").mkdir()
    (tmp_path / "blocks" / "PumpControl.s7dcl").write_text("﻿" + BLOCK.replace("\n", "\r\n"), encoding="utf-8")
    (tmp_path / "blocks" / "broken.s7dcl").write_text("nothing")
    files = scan.read_blocks(spark, str(tmp_path))
    found = scan.facts(files).cache()
    assert scan.conformance(found).first().asDict()["failed"] == 1
    assert scan.exploded(found, "accesses").where("kind = 'write'").count() == 5
    assert scan.tokens(files).where("type = 'KEYWORD' and value = 'CASE'").count() == 1
    other = scan.facts(files.withColumn("text", F.replace("text", F.lit("#state := #RUN"), F.lit("#state := #IDLE"))))
    changes = {(r.change, r.line) for r in scan.diff_bodies(found, other).collect()}
    assert changes == {("removed", 19), ("added", 19)} and scan.diff_interfaces(found, other).count() == 0
    found.unpersist()


def test_text_rules(spark):
    rows = [("PumpControl", "FUNCTION_BLOCK", BLOCK), ("bad name", "FUNCTION", "IF a THEN\n x := 4711;\n")]
    df = spark.createDataFrame(rows, "block string, block_type string, text string")
    got = {(r.subject, r.rule_code) for r in corpus.rule_violations(df).collect()}
    assert {("bad name", "S002"), ("bad name", "N003"), ("bad name", "B001")} <= got and ("PumpControl", "S002") not in got
    refs = {r.full_reference: r.is_write for r in corpus.db_references(df).collect()}
    assert refs['"dbPlant".tank[1].level'] is False
    members = spark.createDataFrame([("b", i, n, s) for i, (n, s) in enumerate([("a", 1), ("b", 1), ("c", 8), ("d", 16), ("e", 8), ("f", 32)])], "block string, ord int, path string, size_bits int")
    at = {r.path: (r.byte_offset, r.bit_offset) for r in corpus.layout_offsets(members).collect()}
    assert at == {"a": (0, 0), "b": (0, 1), "c": (1, 0), "d": (2, 0), "e": (4, 0), "f": (6, 0)}
