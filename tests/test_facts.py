import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import browse, rules, traces
from fieldloom.sources import sinks, tables


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def brute_trace(flows, start, depth, stops):
    seen, frontier = {start: 0}, [start]
    for d in range(1, depth + 1):
        frontier = sorted({b for a, b in flows if a in frontier and a not in stops and b not in seen})
        seen |= {x: d for x in frontier}
    return seen


def test_trace_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    flows = sorted({(rnd.randrange(40), rnd.randrange(40)) for _ in range(70)})
    stops = {5: "IO_TAG", 7: "STATE_VAR"}
    df = spark.createDataFrame(flows, "src long, dst long")
    starts = spark.createDataFrame([(r, r) for r in (0, 1, 2, 5)], "root long, field long")
    halt = spark.createDataFrame(list(stops.items()), "field long, why string")
    got = traces.trace(df, starts, 4, halt).collect()
    for root in (0, 1, 2, 5):
        mine = {r.field: r.depth for r in got if r.root == root}
        assert mine == brute_trace([f for f in flows if f[0] != f[1]], root, 4, stops)
    assert all(r.why == ("MAX_DEPTH" if r.depth >= 4 else stops.get(r.field)) for r in got)
    assert all((r.parent, r.field) in flows for r in got if r.parent is not None)
    assert traces.trace(df.limit(0), starts, 3).count() == 4


def test_usages_chains_and_types(spark):
    rows = [("B", 3, "s", '"db".a[1].x', False), ("B", 3, "s", '"db".a[2].x', True), ("C", 1, "t", '"db".a[#i].x', True), ("C", 2, "u", "#local", False)]
    a = spark.createDataFrame(rows, "block string, line int, statement string, path string, is_write boolean")
    fields = spark.createDataFrame([('"db".a[ 7 ].x',), ("#local",)], "field string")
    got = {(r.block, r.line, r.access) for r in traces.usages(a, fields, exclude_writes=False).collect()}
    assert got == {("B", 3, "read"), ("C", 1, "write")} and traces.usages(a, fields).count() == 1
    assert [tuple(r) for r in traces.statement_flows(a).collect()] == [('"db".a[1].x', '"db".a[2].x')]
    best = traces.best_writers(a, "line", "block").orderBy("path").collect()
    assert [(r.path, r.block) for r in best] == [('"db".a[#i].x', "C"), ('"db".a[2].x', "B")]
    parts = spark.createDataFrame([("o", 2, "#b", None), ("o", 1, "#a", "#c = 1")], "target string, ord int, expression string, condition string")
    assert traces.combined(parts).first().expression == "(#c = 1 AND #a) OR #b"
    types = spark.createDataFrame([("tA",), ("tB",), ("tC",), ("tD",)], "type string")
    members = spark.createDataFrame([("tB", "Array[0..2] of tA"), ("tB", "tC"), ("tA", "Int"), ("tC", '"tA"')], "type string, data_type string")
    found = traces.type_components(types, traces.type_edges(members, types)).collect()
    assert [(r.name, r.size, r.members) for r in found] == [("tB", 3, ["tA", "tB", "tC"]), ("tD", 1, ["tD"])]


@pytest.mark.parametrize(
    "name,want",
    [('"DO_VALVE"', "io_tag"), ("SAI_X", "io_tag"), ('"db" . status . motionMode', "state_var"), ("#activeState", "state_var"), ("#x", "local"), ('"db".a', "field"), ('"db".unit.pumpMode', "state_var")],
)
def test_kinds_of_names(spark, name, want):
    assert one(spark, traces.variable_kind(F.lit(name))) == want
    assert one(spark, traces.is_termination(F.lit(name))) == (want in ("io_tag", "state_var"))


def test_paths(spark):
    for text, want in (("a[1].b", True), ("arms[", False), ("a[1", False), (" ", False), ("", False), (None, False)):
        assert one(spark, traces.valid_path(F.lit(text).cast("string"))) is want
    assert one(spark, traces.tight_path(F.lit('"D" . a [ # i ] . b'))) == '"D".a[#i].b'
    assert one(spark, browse.qualified(F.array(F.lit("a"), F.lit("[1]"), F.lit("b")))) == "a[1].b"
    assert one(spark, browse.tag_indices(F.lit("DO_ARM3_VALVE12_OPEN"))) == [3, 12]
    assert one(spark, browse.values_match(F.lit(1.0), F.lit(1.05), 0.1)) and not one(spark, browse.values_match(F.lit("a"), F.lit("b"), 0.1))


def test_rules(spark):
    v = [("B", "VAR", False, "GoodName", "Int", 1), ("B", "VAR", True, "maxValue", "Int", 2), ("B", "VAR", False, "MyTimer", "TonTime", 3), ("B", "VAR", False, "fine", "Bool", 4), ("B", "VAR_OUTPUT", False, "out", "Bool", 5)]
    variables = spark.createDataFrame(v, "block string, section string, is_constant boolean, name string, data_type string, line int")
    got = sorted((r.rule_code, r.line) for r in rules.variable_rules(variables).collect())
    assert got == [("N001", 1), ("N001", 3), ("N004", 2), ("N005", 3)]
    blocks = spark.createDataFrame([("typeUnit", "TYPE", "", 0), ("ArmInput", "TYPE", "", 0), ("pump_control", "FUNCTION", "x[7] y[1] x[7]", 0), ("B", "FUNCTION_BLOCK", "#fine := a[ 3 ];", 1)], "block string, block_type string, text string, networks int")
    assert sorted((r.rule_code, r.subject) for r in rules.block_name_rules(blocks).collect()) == [("N002", "ArmInput"), ("N003", "pump_control")]
    assert one(spark, rules.suggested_type(F.lit("TYPE_ARM_INPUT"))) == "typeArmInput" and one(spark, rules.suggested_type(F.lit("armInput"))) == "typeArmInput"
    assert sorted(r.message for r in rules.unused_variables(variables, blocks).collect()) == ["never used: GoodName", "never used: MyTimer"]
    assert sorted((r.subject, r.message) for r in rules.hardcoded_indices(blocks).collect()) == [("B", "hardcoded index 3"), ("pump_control", "hardcoded index 7")]
    sections = spark.createDataFrame([("B", "VAR_TEMP", 0), ("B", "VAR", 4)], "block string, section string, variables int")
    assert sorted((r.rule_code, r.subject) for r in rules.section_rules(blocks, sections).collect()) == [("S004", "pump_control"), ("S005", "B")]
    many = spark.createDataFrame([("M", "VAR_INPUT", False, f"v{i}", "Int", i) for i in range(31)] + [("N", "VAR_IN_OUT", False, f"p{i}", "Int", i) for i in range(10)], variables.schema)
    assert sorted((r.rule_code, r.subject) for r in rules.count_rules(many).collect()) == [("C004", "M"), ("C005", "M")]
    headers = spark.createDataFrame([("A", "FUNCTION", True, "t", "d", "c", "a"), ("B", "FUNCTION", True, " ", None, "", None), ("C", "FUNCTION", False, None, "d", None, None), ("T", "TYPE", False, None, None, None, None)], "block string, block_type string, has_header boolean, title string, description string, changelog string, author string")
    found = rules.header_rules(headers)
    assert sorted((r.subject, r.rule_code) for r in found.collect()) == [("B", "D002"), ("B", "D003"), ("B", "D004"), ("B", "D005"), ("C", "D001")]
    assert {r.block: r.passed for r in rules.passed(headers, found).collect()} == {"A": True, "B": False, "C": False, "T": True}
    assert tuple(rules.violation_summary(found).first()) == (5, 2, 1, 2, 2)
    assert rules.filter_violations(found, severity="ERROR", subject="C").count() == 1
    regions = spark.createDataFrame([("A", "Description", ' { S7_MLC := "" } \n', False, 1), ("B", "description", "text", False, 5), ("A", "Work", " ", False, 2), ("A", "Outer", "", True, 3), ("A", "Block info header", "", False, 4)], "block string, region string, content string, has_nested boolean, line int")
    assert sorted((r.rule_code, r.line) for r in rules.region_rules(regions).collect()) == [("B005", 2), ("D006", 1)]


SAFETY = """{ S7_Safety := "TRUE" }
TITLE = x
VAR_INPUT
  a : Int := 3;
  s : Struct
  list : Array[*] of Int;
END_VAR
  b : Int := 4;
  FkStage(
  "Quoted"(
  Move(
  Coil( "DB".out
  x := "DB".out;"""


def test_safety_text(spark):
    files = spark.createDataFrame([("a", SAFETY), ("b", SAFETY.replace("TRUE", "no")), ("c", "")], "path string, text string")
    got = [(r.path, r.line, r.code) for r in rules.safety_findings(files).collect()]
    assert [g[1:] for g in got if g[0] == "a"] == [(None, "S008"), (2, "S001"), (4, "S002"), (5, "S003"), (6, "S009"), (9, "S007")]
    assert [g[2] for g in got if g[0] == "b"] == ["S001", "S002", "S009", "S007"] and not [g for g in got if g[0] == "c"]
    block = 'S7_BlockTitle := "MLC_A" S7_NetworkTitle := "MLC_B"'
    pairs = spark.createDataFrame([("p", block, "- id: MLC_B\n  en-US: a: b\n  de: \"a: b\"\n- id: MLC_C\n"), ("q", block, None), ("r", "none", None)], "path string, block_text string, res_text string")
    found = [(r.path, r.code, r.severity, r.id) for r in rules.resource_pairs(pairs).collect()]
    assert found == [("p", "S006", "ERROR", "  en-US: a: b"), ("p", "S005", "ERROR", "MLC_A"), ("p", "S005", "WARNING", "MLC_C"), ("q", "S005", "ERROR", "no file")]


def test_lists(spark):
    tags = spark.createDataFrame([("DO_A", "DO", "output"), ("DI_A", "DI", "input"), ("DI_B", "DI", "input")], "name string, category string, direction string")
    rows, counts = browse.tag_list(tags, category="DO")
    assert [r.name for r in rows.collect()] == ["DO_A"] and [tuple(r) for r in counts.collect()] == [("DI", 2), ("DO", 1)]
    paths = spark.createDataFrame([("a.b", "n1"), ("a.c", "n2"), ("a.b", "n3")], "path string, node_id string")
    wanted = spark.createDataFrame([("a.b",), ("z",)], "path string")
    assert {r.path: r.node_id for r in browse.resolve_tags(wanted, paths).collect()} == {"a.b": "n3", "z": None}
    assert [r.path for r in browse.search_tags(paths, "A.C").collect()] == ["a.c"]
    src = spark.createDataFrame([("b", "1\n2\n3\n4\n5\n"), ("e", "")], "block string, text string")
    assert [tuple(r) for r in browse.excerpt(src, 2, 1).where("block = 'b'").collect()] == [("b", "1\n2\n3", 5, 1, 3)]
    assert {r.block: r.total_lines for r in browse.excerpt(src).collect()} == {"b": 5, "e": 0}
    calls = spark.createDataFrame([("m", "F", "s", '"db".x'), ("m", "F", "i", "#a")], "block string, callee string, parameter string, argument string")
    pars = spark.createDataFrame([("F", "s", "VAR_IN_OUT"), ("F", "i", "VAR_INPUT")], "block string, parameter string, section string")
    assert [r.argument for r in browse.struct_bindings(calls, pars).collect()] == ['"db".x']
    variables = spark.createDataFrame([("m", "t1", "Array[0..1] of Ton"), ("m", "n", "Int")], "block string, name string, data_type string")
    known = spark.createDataFrame([("Ton",)], "block string")
    assert [tuple(r) for r in browse.instance_types(variables, known).collect()] == [("m", "t1", "Ton")]
    entries = spark.createDataFrame([("p[10].a",), ("p[2].b",), ("x",)], "path string")
    assert [r.path for r in browse.by_instance(entries, "path").collect()] == ["x", "p[2].b", "p[10].a"]


def test_reports(spark, tmp_path):
    steps = [("s <1>", 0, "ok", "read", "PASSED", None, 0.5), ("s <1>", 1, None, "assert", "FAILED", 'a "b" & c', 0.25), ("s <1>", 2, None, "wait", "SKIPPED", None, 0.0), ("t", None, None, None, "SKIPPED", "later", 0.0)]
    df = spark.createDataFrame(steps, "scenario string, ord int, description string, step_type string, outcome string, error_message string, duration_s double")
    sinks.write_text(sinks.junit_xml(df), str(tmp_path / "junit"))
    (name,) = (tmp_path / "junit").glob("part-*.txt")
    root = ET.parse(name).getroot()
    assert root.attrib == {"tests": "3", "failures": "1", "time": "0.750"}
    suites = {s.get("name"): s for s in root}
    assert [c.get("name") for c in suites["s <1>"]] == ["ok", "Step 2: assert", "Step 3: wait"]
    assert suites["s <1>"][1][0].get("message") == 'a "b" & c' and suites["t"][0][0].get("message") == "later" and suites["t"].get("tests") == "1"
    back = tables.read_junit(spark, str(name)) if hasattr(tables, "read_junit") else None
    assert back is None or back.count() == 4
    text = sinks.markdown_table(df.select("scenario", "outcome"), "Results", "scenario").first().value
    assert text.splitlines()[:3] == ["# Results", "", "| scenario | outcome |"] and len(text.splitlines()) == 8
    rec = spark.createDataFrame([(0.2, 2, 5.0), (0.1, 1, 4.0)], "t_rel_s double, sample_cycles long, x double")
    sinks.write_recording(rec, str(tmp_path / "rec.csv"), {"depth": 2})
    assert [r.x for r in spark.read.csv(str(tmp_path / "rec.csv"), header=True).collect()] == ["4.0", "5.0"]
    assert json.loads(spark.read.text(str(tmp_path / "rec.csv.meta.json")).first().value) == {"depth": 2}
    sinks.write_schema(spark, str(tmp_path / "schema"))
    assert spark.read.csv(str(tmp_path / "schema"), header=True).count() == 16
    cache = spark.createDataFrame([("a", "FAILED", 1), ("b", "PASSED", 1)], "name string, outcome string, at int")
    new = spark.createDataFrame([("a", "PASSED", 2)], cache.schema)
    assert [(r.name, r.outcome) for r in sinks.merge_results_cache(cache, new, "name", "at").collect()] == [("a", "PASSED"), ("b", "PASSED")]
    shards = spark.createDataFrame([("b", 2), ("b", 1), ("b", 2)], "block string, line int")
    assert sinks.merge_coverage(shards).first().lines == [1, 2]


def test_tag_files_read_back(spark, tmp_path):
    rows = [("DI_B", "Bool", "%I1.1", "b & c", "G 1"), ("DI_A", "Bool", "%I1.0", "a", "G 1"), ("DO_A", "Int", None, None, None)]
    points = spark.createDataFrame(rows, "mnemonic string, data_type string, plc_address string, signal_name string, functional_group string")
    sinks.write_tag_files(points, str(tmp_path / "tags"))
    got = {r.name: (r.address, r.comment) for r in tables.read_tags(spark, str(tmp_path / "tags" / "*")).collect()}
    assert got["DI_A"] == ("%I1.0", "a") and got["DI_B"] == ("%I1.1", "b & c") and set(got) == {"DI_A", "DI_B", "DO_A"}
    ids = [e.get("ID") for e in ET.fromstring(sinks.tag_document(points).where("file = 'G_1'").first().value).iter("SW.Tags.PlcTag")]
    assert ids == ["1", "4"]
