import json
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import names
from fieldloom.lang import ladder
from fieldloom.operators import browse, formats, headers, plugins
from fieldloom.sources import corpus, project


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def rung(body, close=""):
    return f"NETWORK\nRUNG wire#powerrail\n{body}\nEND_RUNG{close}\nEND_NETWORK\n"


ABS = rung("Move( in := #x, out1 => #y )") + rung("GE_Contact( in1 := #x, in2 := 0 )\nJumpCoil( END )") + rung("Neg( in := #x, out => #y )") + "NETWORK\nLabel(END)\nRUNG wire#powerrail\nCoil( #end )\nEND_RUNG\nEND_NETWORK\n"


def test_ladder_plan_equals_a_scan(spark):
    rnd = random.Random(5)
    for _ in range(6):
        rungs, n = "", rnd.randrange(2, 6)
        for i in range(n):
            contacts = "".join(rnd.choice([f"Contact( #b{rnd.randrange(3)} )\n", f"I_Contact( #b{rnd.randrange(3)} )\n", f"{rnd.choice(ladder.COMPARE)}_Contact( in1 := #i{rnd.randrange(2)}, in2 := {rnd.randrange(-3, 4)} )\n"]) for _ in range(rnd.randrange(3)))
            action = rnd.choice([f"Coil( #b{rnd.randrange(3)} )", f"Add( in1 := #i0, in2 := #i1, out => #i{rnd.randrange(2)} )", f"Div( in1 := #i{rnd.randrange(2)}, in2 := -3, out => #i0 )", f"Mul( in1 := #i0, in2 := 2, out => #i1 )", f"JumpCoil( L{rnd.randrange(i, n)} )"])
            rungs += rung(contacts + action) + f"NETWORK\nLabel(L{i})\nEND_NETWORK\n"
        program = ladder.program(rungs)
        assert ladder.forward_only(program)
        rows = [dict(b0=rnd.random() < 0.5, b1=rnd.random() < 0.5, b2=rnd.random() < 0.5, i0=rnd.randrange(-9, 9), i1=rnd.randrange(-9, 9), extra="e") for _ in range(12)]
        df = spark.createDataFrame([tuple(r.values()) for r in rows], "b0 boolean, b1 boolean, b2 boolean, i0 int, i1 int, extra string")
        assert [r.asDict() for r in ladder.run_program(df, program).collect()] == [ladder.scan(program, r) for r in rows]


def test_ladder_branches_jumps_and_calls(spark):
    text = 'NETWORK { S7_Language := "LAD" } RUNG wire#powerrail Contact( #a ) wire#w1 Coil( #f ) END_RUNG RUNG wire#powerrail I_Contact( "Db".b ) END_RUNG wire#w1 END_NETWORK'
    program = ladder.program(text)
    assert [len(t) for t in program[0].rail] == [2] and len(program) == 1
    assert ladder.scan(program, {"a": False, '"Db".b': False, "f": False})["f"] is True
    assert ladder.scan(program, {"a": False, '"Db".b': True, "f": False})["f"] is False
    assert [ladder.scan(ladder.program(ABS), {"x": x, "y": 0, "end": False})["y"] for x in (-4, 0, 9)] == [4, 0, 9]
    with pytest.raises(OverflowError):
        ladder.scan(ladder.program(ABS), {"x": -(2**31), "y": 0, "end": False})
    call = ladder.program(rung('Contact( #on )\n"Twice"( v := #x, r => #y )'))
    assert ladder.scan(call, {"on": True, "x": 4, "y": 0}, {"Twice": lambda v: {"r": 2 * v}})["y"] == 8
    for bad in ("RUNG foo END_RUNG", "RUNG Coil( #x END_RUNG", "RUNG GT_Contact( in1 := #x ) END_RUNG", "RUNG Coil( #x ) END_RUNG wire#w1"):
        with pytest.raises(ladder.Unsupported):
            ladder.program(f"NETWORK {bad} END_NETWORK")
    # a loop that counts down, jumping backward
    loop = "NETWORK\nLabel(TOP)\nEND_NETWORK\n" + rung("Sub( in1 := #n, in2 := 1, out => #n )") + rung("GT_Contact( in1 := #n, in2 := 0 )\nJumpCoil( TOP )")
    df = spark.createDataFrame([(5,), (1,), (9,)], "n int")
    assert [r.n for r in ladder.run_program(df, ladder.program(loop)).collect()] == [0, 0, 0]
    with pytest.raises(RuntimeError):
        ladder.scan(ladder.program("NETWORK\nLabel(T)\nEND_NETWORK\n" + rung("JumpCoil( T )")), {})
    files = spark.createDataFrame([("a", ABS), ("b", "NETWORK RUNG foo END_RUNG END_NETWORK"), ("c", None)], "path string, text string")
    found = ladder.ladder_rows(files).collect()
    assert [r.kind for r in found if r.path == "a"] == ["box", "compare", "jump", "box", "label", "coil"]
    assert [r.error for r in found if r.path == "b"] == ["foo in a rung"] and not [r for r in found if r.path == "c"]


def test_masked_keeps_places(spark):
    text = "a 'x\ny' (* FUNCTION\n *) b // c\n\"q\" / ( d (* open"
    got = one(spark, formats.masked(F.lit(text)))
    assert len(got) == len(text) and got.count("\n") == text.count("\n")
    assert got.split() == ["a", "b", "/", "(", "d"]


def test_text_findings(spark):
    ok = '{ S7_Optimized := "TRUE"; S7_EditorMode := "x" }\n\n(* FUNCTION "no" *)\nFUNCTION_BLOCK "P"\nEND_FUNCTION_BLOCK\n'
    rows = [
        ("x/P.s7dcl", ok), ("x/Q.s7dcl", ok), ("x/P.txt", ok + "TYPE\n q : STRUCT\n"), ("T.s7dcl", "TYPE\n T : STRUCT\n a : Struct\n"), ("e", "TITLE = x"),
        ("f", "{ S7_Optimized_Access := 1 }"), ("g", '"BEGIN"\n// TITLE =\n'), ("n", None), ("d", '\n\nDATA_BLOCK "K"'),
    ]
    found = {}
    for r in formats.text_findings(spark.createDataFrame(rows, "path string, text string")).collect():
        found.setdefault(r.path, []).append((r.line, r.code, r.severity))
    assert found == {
        "x/Q.s7dcl": [(4, "F012", "ERROR")],
        "x/P.txt": [(6, "F011", "ERROR")],
        "e": [(None, "F010", "ERROR")],
        "f": [(None, "F010", "ERROR")],
        "d": [(1, "F012", "ERROR"), (1, "F020", "ERROR"), (1, "F021", "WARNING")],
    }


def test_xml_and_file_findings(spark, tmp_path):
    good = "<D><Engineering version='V1'/><SW.Tags.PlcTagTable/></D>"
    rows = [("p/PLC tags/a.xml", good), ("p/PLC tags/b.xml", "<D><SW.Tags.PlcTagTable/></D>"), ("p/c.xml", "<D>"), ("p/d.xml", "<?xml version='1.0'?><D></D>"), ("p/PLC Tags/e.xml", "<D/>"), ("p/n.xml", None)]
    found = formats.xml_findings(spark.createDataFrame(rows, "path string, text string")).collect()
    assert {r.path: (r.code, r.severity) for r in found} == {
        "p/PLC tags/b.xml": ("F030", "ERROR"), "p/c.xml": ("F031", "WARNING"), "p/d.xml": ("F031", "WARNING"), "p/PLC Tags/e.xml": ("F030", "ERROR"), "p/n.xml": ("F031", "WARNING"),
    }
    bom, head = b"\xef\xbb\xbf", b'{ S7_Optimized := "TRUE"; S7_EditorMode := "x"; S7_BlockTitle := "MLC_1" }\r\n'
    (tmp_path / "A.s7dcl").write_bytes(bom + head + b'FUNCTION_BLOCK "A"\r\n')
    (tmp_path / "A.s7res").write_bytes(bom + b"MultiLingualTexts:\r\n  - id: MLC_1\r\n    en-US: hello\r\n")
    (tmp_path / "B.s7dcl").write_bytes(head + b'FUNCTION_BLOCK "B"\nEND\n')
    (tmp_path / "C.s7dcl").write_bytes(bom + b"\xff\r\nTITLE = x\r\n")
    (tmp_path / "t.xml").write_bytes(bom + good.encode())
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = sorted((r.path.rsplit("/", 1)[-1], r.code, r.line or 0) for r in formats.file_findings(files).collect())
    assert got == [("B.s7dcl", "F001", 0), ("B.s7dcl", "F002", 2), ("B.s7dcl", "S005", 0), ("C.s7dcl", "F003", 0)]


def test_headers(spark):
    text = "// Title: Pump\n// Title: Pump2\n// Family: Lib\n// ACME / (c)Copyright 2024\n// Change log table:\n// Version | Date | By | Changes\n//---+---\n// 1.0 | d | me | a | b\nEND\n// 2.0 | d | me | late\n"
    rows = [("a", f"REGION block info header\n{text}END_REGION\nREGION Description\n(*\n  first\n    second\n\n  third*)\nEND_REGION\n"), ("b", "x"), ("c", None)]
    a, b, c = headers.block_headers(spark.createDataFrame(rows, "path string, text string")).orderBy("path").collect()
    assert (a.title, a.library, a.author, a.copyright, a.comment) == ("Pump2", "Lib", "", "(c) 2024 ACME", "")
    assert [(x.version, x.changes) for x in a.changelog] == [("1.0", "a | b")] and a.description == "first\n  second\n\nthird"
    assert [(x.title, x.copyright, x.changelog, x.description, x.has_header) for x in (b, c)] == [("", "", [], "", False)] * 2
    texts = spark.createDataFrame([("r", 0, "Block Info Header"), ("r", 1, " Title: X-Y\n ACME / (c)Copyright 2020\nAuthor: me"), ("r", 2, "description"), ("r", 3, " told "), ("s", 0, "description")], "path string, ord int, text string")
    (r,) = headers.resource_headers(texts).collect()
    assert (r.title, r.copyright, r.author, r.description) == ("X", "(c) 2020 ACME", "me", "told")
    assert one(spark, headers.description(F.lit("// one\n\n//two\nthree"))) == "one\ntwo\nthree"


def test_text_files_and_libraries(spark):
    pytest.importorskip("yaml")
    df = lambda *texts: spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = project.resource_texts(df("MultiLingualTexts:\n - id: A\n   en-US: 40021\n - id: B\n   en-US:\n", "[", None, "x: 1", "MultiLingualTexts:\n")).collect()
    assert [tuple(r) for r in got] == [("0", 0, "A", "40021"), ("0", 1, "B", "")]
    info = project.library_info(df("LibraryType:\n  Guid: g\nLibraryVersion:\n  Author: me\n  IsDefault: false\n", "[")).collect()
    assert [tuple(r) for r in info] == [("0", "g", "", "me", False), ("1", "", "", "", True)]
    face = project.library_interface(df("DocumentHash: [1]\nLibraryVersion: {Guid: g, DependsOn: [a]}", None)).collect()
    assert [tuple(r) for r in face] == [("0", "g", "[1]", '["a"]'), ("1", "", "[]", "[]")]


def test_scenarios_and_setup(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "sub").mkdir()
    (tmp_path / "test_a.yaml").write_text("scenario:\n  name: A\n  timeout: 2m\n  skip: 'false'\n  skip_reason:\n  tags: [1, x]\n  preconditions: [{path: p, value: 1}]\n  steps: [{step: WRITE, path: q, value: true}]\n")
    (tmp_path / "sub" / "EFAT_b.yml").write_text("scenario:\n  skip: yes\n  steps: [{step: fly}]\n")
    (tmp_path / "test_c.yaml").write_text("nothing: 1\n")
    (tmp_path / "setup.yaml").write_text("setup:\n  settle_time: 500ms\n  values: {a: 1}\n")
    (tmp_path / "other.yaml").write_text("scenario: {}\n")
    files = project.read_files(spark, str(tmp_path), project.SCENARIO_FILES)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in project.scenarios(files, known=("write",)).collect()}
    assert sorted(rows) == ["EFAT_b.yml", "test_a.yaml", "test_c.yaml"]
    a = rows["test_a.yaml"]
    assert (a.name, a.timeout_s, a.skip, a.skip_reason, a.tags, a.error) == ("A", 120.0, False, "", ["1", "x"], None)
    assert a.preconditions[0].value == "1" and a.steps[0].step == "write" and json.loads(a.steps[0].arguments) == {"path": "q", "value": True}
    assert rows["EFAT_b.yml"].error == "unknown step type: fly" and rows["test_c.yaml"].error == "no scenario"
    b = {r.path.rsplit("/", 1)[-1]: r for r in project.scenarios(files).collect()}["EFAT_b.yml"]
    assert (b.name, b.skip, b.timeout_s) == ("EFAT_b", True, 60.0)
    (s,) = project.suite_setup(project.read_files(spark, str(tmp_path), "*.y*ml")).collect()
    assert (s.settle_s, s.post_settle_s, s["values"], s.post_values) == (0.5, 1.0, '{"a": 1}', "{}")


def test_sources_caches_and_tag_folders(spark, tmp_path):
    for name in ("p/a/x.s7dcl", "p/a/b/y.s7dcl", "p/z.txt", "p/deep/er/Tags/t.xml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    root = str(tmp_path / "p")
    found = project.baseline_sources(spark, root, ["a/**/*.s7dcl", "**/x.*"]).collect()
    assert [r.relative for r in found] == ["a/b/y.s7dcl", "a/x.s7dcl"]
    assert project.baseline_sources(spark, root, []).count() == 0
    assert project.tag_folder(spark, root).endswith("deep/er/Tags")
    (tmp_path / "p" / "PLC tags").mkdir()
    assert project.tag_folder(spark, root).endswith("p/PLC tags") and project.tag_folder(spark, str(tmp_path / "none")) is None
    cache = {"baseline": {"hash": "h"}, "results": {"s": {"name": "s", "source_file": None, "outcome": "passed", "duration_s": 1.5, "error_message": None, "executed_at": "t"}}}
    for name, text in (("c.json", json.dumps(cache)), ("bad.json", "{"), ("other.json", '{"x": 1}')):
        (tmp_path / name).write_text(text)
    assert [(r.baseline, r.key, r.outcome, r.duration_s) for r in project.results_cache(spark, str(tmp_path / "c.json")).collect()] == [("h", "s", "passed", 1.5)]
    assert project.results_cache(spark, str(tmp_path / "bad.json")).count() == project.results_cache(spark, str(tmp_path / "other.json")).count() == 0
    tag = {"path": "a", "node_id": "n", "data_type": "Bool", "is_writable": True}
    (tmp_path / "t.json").write_text(json.dumps({"built_at": "2026-01-01T00:00:00+00:00", "ttl_hours": 2, "tags": {"a": tag}}))
    assert project.tag_cache(spark, str(tmp_path / "t.json"), "2026-01-01T01:59:00+00:00").collect()[0].asDict() == tag
    assert project.tag_cache(spark, str(tmp_path / "t.json"), "2026-01-01T02:01:00+00:00").count() == 0


TAGS = "<Document><SW.Tags.PlcTagTable><ObjectList>{}</ObjectList></SW.Tags.PlcTagTable></Document>"
TAG = "<SW.Tags.PlcTag><AttributeList><Name>{}</Name><DataTypeName>Bool</DataTypeName><LogicalAddress>{}</LogicalAddress></AttributeList></SW.Tags.PlcTag>"


def test_points_of_groups(spark, tmp_path):
    (tmp_path / "one.xml").write_text(TAGS.format(TAG.format("DI_A", "%I0.0") + TAG.format("DI_B", "%I0.1")))
    (tmp_path / "two.xml").write_text(TAGS.format(TAG.format("DI_A", "%I9.0")))
    (tmp_path / "out.xml").write_text(TAGS.format(TAG.format("DI_C", "%I5.0")))
    points, missing = project.points_of_groups(spark, str(tmp_path), [("g2", ["two.xml", "gone.xml"]), ("g1", ["one.xml"])])
    assert sorted((r.mnemonic, r.plc_address, r.functional_group) for r in points.collect()) == [("DI_A", "%I0.0", "g1"), ("DI_B", "%I0.1", "g1")]
    assert [tuple(r) for r in missing.collect()] == [("g2", "gone.xml")]


def test_parameters(spark):
    member = lambda name, kind, inner: f'<Member Name="{name}" Datatype="{kind}">{inner}</Member>'
    subs = lambda **v: "".join(f'<Subelement Path="{k[1:].replace("_", ",")}"><StartValue>{x}</StartValue></Subelement>' for k, x in v.items())
    arms = member("arms", "Array[1..2] of &quot;arm&quot;", "<Sections><Section>" + member("type", "String", subs(_1="'a'", _2="'b'")) + member("speeds", "Array[0..1] of Real", subs(_1_0="1.0", _2_1="4.0")) + "</Section></Sections>")
    body = member("limit", "Int", "<StartValue>7</StartValue>") + arms + member("u", "&quot;unit&quot;", "")
    xml = f'<Document><SW.Blocks.InstanceDB><AttributeList><Interface><Sections xmlns="{project.SPACE[1:-1]}"><Section Name="Static">{body}</Section></Sections></Interface><Name>Db</Name></AttributeList></SW.Blocks.InstanceDB></Document>'
    types = {"unit": [("", "z", "Array[0..1] of in", None), ("", "s", "Struct", None), ("s", "k", "Int", "3")], "in": [("", "v", "Bool", "TRUE")]}
    df = spark.createDataFrame([("a.xml", xml), ("b.xml", "<D/>"), ("c.xml", "<"), ("d.xml", None)], "path string, text string")
    rows = [(r.qualified_path, r.datatype, r.value) for r in project.parameters(df, types=types).orderBy("ord").collect()]
    assert rows == [
        ("Db.limit", "Int", "7"), ("Db.u.s.k", "Int", "3"), ("Db.u.z[0].v", "Bool", "TRUE"), ("Db.arms[1].type", "String", "'a'"), ("Db.arms[1].speeds[0]", "Real", "1.0"), ("Db.u.z[1].v", "Bool", "TRUE"),
        ("Db.arms[2].type", "String", "'b'"), ("Db.arms[2].speeds[1]", "Real", "4.0"),
    ]
    plain = project.parameters(df, "Other").orderBy("ord").collect()
    assert [r.qualified_path for r in plain][:2] == ["Other.limit", "Other.arms[1].type"] and len(plain) == 5
    entries = spark.createDataFrame([(0, "a[2].x"), (1, "a[10].x"), (2, "a[2].w"), (3, "q[5]")], "ord int, p string")
    assert [r.ord for r in browse.by_instance(entries, "p", "ord").collect()] == [3, 0, 2, 1]


def test_data_blocks(spark):
    text = 'DATA_BLOCK "K"\nVAR\n a : Int := 16#FF;\n b : Array[0..2] of Real;\n t : Time;\n n : Bool;\nEND_VAR\nBEGIN\n b[1] := 2.5;\n n := TRUE;\n n := FALSE;\nEND_DATA_BLOCK\n'
    got = project.data_blocks(corpus.facts(spark.createDataFrame([("k", text)], "path string, text string"))).collect()
    assert json.loads(got[0].json) == {"a": 255, "b": [0.0, 2.5, 0.0], "n": False}
    assert [project.literal_value(x) for x in ("16#0f", " TRUE ", "-3", "1.5", '"x"', "T#5s")] == [15, True, -3, 1.5, "x", "T#5s"]
    root = {}
    for path, value in (("S.A[2]", 1), ("M[1,2]", 1), ("A[1].b", 1), ("S.B", 4)):
        project.put(root, path, value)
    assert root == {"S": {"A": [0, 0, 1], "B": 4}}


def test_names_of_diagrams(spark):
    condition = lambda x: one(spark, names.short_condition(F.lit(x)))
    assert condition('#a=1 AND "Db".x.y<>2') == "a = 1 AND y != 2"
    assert condition("(#a)OR(#b)") == "(a) OR (b)" and condition("( #a )") == "a"
    assert condition("#hornAcknowledge AND #x") == "hornAcknowledge AND x" and condition("a ANDb") == "a AND b"
    tag = lambda x: tuple(one(spark, names.instrument(F.lit(x))))
    assert [tag(x) for x in ("HS-6020A", "HS102", "WEIRD", "")] == [("HS", "6020A"), ("HS", "102"), ("?", "WEIRD"), ("?", "")]
    assert one(spark, names.without_project(F.lit("021-HS-1"))) == "HS-1" and one(spark, names.state_name(F.lit('#"A B"'))) == "A B"


def test_labels_and_test_files(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "index int")
    label = browse.unit_labels(ids, spark.createDataFrame([(1, "One")], "index int, label string"), spark.createDataFrame([(1, "'x'"), (2, "'two'"), (3, "''")], "index int, value string"))
    assert sorted(tuple(r) for r in label.collect()) == [(1, "One"), (2, "two"), (3, "Unit 3")]
    blocks = spark.createDataFrame([("MotorStart",), ("Pump_2",), ("None",)], "block string")
    files = spark.createDataFrame([(1, "b/test_MotorStart.py"), (0, "a/sub/test_motor_start.py"), (0, "a/test_motor_start.py"), (0, "a/test_pump2.py")], "folder_ord int, path string")
    assert {r.block: r.path for r in browse.test_files(blocks, files).collect()} == {"MotorStart": "a/test_motor_start.py", "Pump_2": "a/test_pump2.py"}


def test_registry(spark):
    r = plugins.Registry()

    @r.rule("X1", "ERROR")
    def no_tab(df):
        return df.where("text like '%\t%'").select(F.col("path").alias("subject"), F.lit(None).alias("line"), F.lit("tab").alias("message"))

    @r.rule("X2")
    def is_long(df):
        return df.where("length(text) > 3").select(F.col("path").alias("subject"), F.lit(1).alias("line"), F.lit("long").alias("message"))

    @r.step("Above")
    def above(samples, given):
        return samples.agg((F.max("v") > given["than"]).alias("passed"), F.lit("max").alias("message"))

    files = spark.createDataFrame([("a", "\tabc"), ("b", "x")], "path string, text string")
    assert sorted((v.rule_code, v.severity, v.subject) for v in r.violations(files).collect()) == [("X1", "ERROR", "a"), ("X2", "WARNING", "a")]
    assert [v.rule_code for v in r.violations(files, without=["X1"]).collect()] == ["X2"] and r.violations(files, only=[]).count() == 0
    samples = spark.createDataFrame([(1,), (5,)], "v int")
    assert [(x.ord, x.passed) for x in r.run(samples, [{"step": "above", "than": 3}, {"step": "ABOVE", "than": 9}]).orderBy("ord").collect()] == [(0, True), (1, False)]
    for bad in (lambda: r.violations(files, only=["nope"]), lambda: r.run(samples, [{"step": "fly"}])):
        with pytest.raises(KeyError):
            bad()
