import pytest
from pyspark.sql import functions as F

from fieldloom.functions import addresses, names, values
from fieldloom.operators import components, corpus, graph, network, points, results, signals, xref
from fieldloom.sources import tables
from fieldloom.streaming import flows


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text,want",
    [
        ("%I1.0", ("I", 1, 0)), ("%qw70", ("QW", 70, None)), ("%I1", ("I", 1, None)), ("%IW7.1", None), ("%I1.9", ("I", 1, 9)), ("x", None),
        ("PIW4", ("PIW", 4, None)), ("%PQW6", ("PQW", 6, None)), ("%MB5", None), ("%ID8", None), ("M3.2", ("M", 3, 2)), ("%%Q 1.0", ("Q", 1, 0)),
        ("", None), ("%", None), ("%MW", None), (None, None),
    ],
)
def test_s7_addresses(spark, text, want):
    got = one(spark, addresses.parse_s7(F.lit(text)))
    assert (tuple(got) if got else None) == want


def test_addresses_round_trip(spark):
    assert one(spark, addresses.format_s7(addresses.parse_iol(F.lit("PEW 100")))) == "%IW100"
    assert one(spark, addresses.format_iol(addresses.parse_s7(F.lit("%Q2.1")))) == "A 2.1"
    assert one(spark, addresses.data_type(F.lit(" dINT "))) == "DInt" and one(spark, addresses.data_type(F.lit("x"))) == "Bool"
    assert one(spark, addresses.io_category(F.lit("sdi_A_B"))) == "SDI" and one(spark, addresses.io_category(F.lit("DIX"))) is None
    for text, want in {"E 1.0": ("I", 1, 0), "PEW 70": ("IW", 70, None), "PAW3": ("QW", 3, None), "EW 2": ("IW", 2, None), "A2": ("Q", 2, None), "MW9": ("MW", 9, None), "ED 4": None, "Q1.0": None}.items():
        got = one(spark, addresses.parse_iol(F.lit(text)))
        assert (tuple(got) if got else None) == want, text
    assert one(spark, addresses.format_iol(addresses.parse_s7(F.lit("%PIW4")))) == "PIW 4"
    assert one(spark, addresses.in_range(addresses.parse_s7(F.lit("%I1.9")))) is False


@pytest.mark.parametrize("text,want", [("HOLDING:40/3", ("HOLDING", 40, 3)), ("HOLDING:0", ("HOLDING", 0, None)), ("INPUT:7/15", ("INPUT", 7, 15)), ("COIL:7", ("COIL", 7, None)), ("DISCRETE:1", ("DISCRETE", 1, None)), ("COIL:7/1", None), ("HOLDING:5/16", None), ("HR:1", None), ("holding:1", None), ("HOLDING", None), (" HOLDING:70000 ", ("HOLDING", 70000, None))])
def test_register_addresses(spark, text, want):
    got = one(spark, addresses.register_address(F.lit(text)))
    assert (tuple(got) if got else None) == want


def test_fixed_names(spark):
    types = {"boolean": "Bool", "integer": "Int", "float": "Real", "dword": "DWord", "TOD": "TOD", "dt": "DT", "time": "Time", "lreal": "Bool"}
    for text, want in types.items():
        assert one(spark, addresses.data_type(F.lit(text))) == want
    for text in ("value_status1", "STATUS_X", "INTERNAL_A", "CALC_1", "TEMP_1", "FLAG_1", "TIMER_1", "COUNTER_1"):
        assert one(spark, names.is_internal(F.lit(text)))
    for text in ("HMI_START", "DIAG", "TAG_1", "SYSTEM_1", "STATUS"):
        assert not one(spark, names.is_internal(F.lit(text)))
    ports = {4840: "OPC-UA", 102: "S7comm", 8000: "API/WS", 5173: "Vite-HMR", 514: "Syslog", 6514: "Syslog-PLC", 88: "Kerberos", 389: "LDAP", 636: "LDAPS", 445: "SMB", 502: "Other", 161: "Other"}
    for port, want in ports.items():
        assert one(spark, network.protocol(F.lit("TCP"), F.lit(50000), F.lit(port))) == want
    for n, want in {1000: "1000 B", 1023: "1023 B", 1024: "1.0 KB", 1536: "1.5 KB", 1 << 20: "1.0 MB", 3 << 30: "3.0 GB"}.items():
        assert one(spark, names.human_bytes(F.lit(n))) == want


def test_byte_units_past_a_gigabyte(spark, tmp_path):
    """Keys of larger tables than the driver's sf0.1, by the query and by its SQL."""
    import duckdb
    from fieldloom.plans import catalogue

    keys = [0, 1, 2, 149_999, 1_076_972, 1_076_973, 1_076_974, 8_999_999, 1 << 40]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.text for r in catalogue.QUERIES["byte_units"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert got == dict(con.execute(catalogue.ORACLE_SQL["byte_units"]).fetchall())
    assert got[1_076_973] == "1024.0 MB" and one(spark, names.human_bytes(F.lit(1 << 30))) == "1.0 GB"


def test_mnemonics(spark):
    check = lambda t: tuple(one(spark, names.check_mnemonic(F.lit(t))))
    assert check("DI_LOC1_PUMP_START") == (True, [], []) and check("") == (False, ["EMPTY"], [])
    assert check("DI_A") == (True, [], ["SIGNAL"]) and check("XX_A_B") == (False, ["CATEGORY"], [])
    assert check("DI_A__B_") == (True, [], ["DOUBLE_UNDERSCORE", "EDGE_UNDERSCORE"]) and check("DI_A_" + "B" * 60)[1] == ["LENGTH"]
    assert check("DI_A_B" + "C" * 58)[1] == [] and check("DI_A_b c")[1] == ["CHARACTERS"]
    assert tuple(one(spark, names.parts(F.lit("sdi_loc_A_B")))) == ("SDI", "LOC", "A_B") and tuple(one(spark, names.parts(F.lit("pump_run")))) == (None, "PUMP", "run")
    got = one(spark, names.suggest_mnemonic(F.lit(" di"), F.lit("loc 1"), F.lit("pump start!")))
    assert got == "DI_LOC_1_PUMP_START" and one(spark, names.normalize_mnemonic(F.lit(" a b-c "))) == "A_B-C"


def test_values(spark):
    assert one(spark, values.bit_slice(F.lit(-1), "W", 1)) == 65535 and one(spark, values.bit_slice(F.lit(4), "X", 2)) is True
    assert one(spark, values.with_bit_slice(F.lit(0xFFFF), "B", 1, F.lit(0x12))) == 0x12FF
    assert one(spark, values.modulo(F.lit(-7), F.lit(3))) == 2 and one(spark, values.modulo(F.lit(7), F.lit(-3))) == -2
    assert one(spark, values.bcd16(F.lit(0x1234))) == 1234 and one(spark, values.swap_word(F.lit(0x1234))) == 0x3412
    assert one(spark, values.duration_seconds(F.lit("1.5min"))) == 90 and one(spark, values.duration_seconds(F.lit("7"))) == 7
    assert one(spark, values.time_literal_seconds(F.lit("T#1h30m"))) == 5400 and one(spark, values.time_literal_seconds(F.lit("T#1.5s"))) == 5
    assert tuple(one(spark, values.array_read(F.array(F.lit(5), F.lit(6)), F.lit(9)))) == (5, True)
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        one(spark, values.checked_dint("add", F.lit(2**31 - 1), F.lit(1)))


def test_names(spark):
    assert one(spark, names.camel_to_snake(F.lit("PumpHTTPState"))) == "pump_http_state"
    assert one(spark, names.camel_case(F.lit("pump_run_time"))) == "pumpRunTime"
    assert one(spark, names.wildcard_path(F.lit('"db".a[1].b[ #i ]'))) == '"db".a[*].b[*]'
    spec = one(spark, names.type_spec(F.lit('Array[0..2, 1..3] of "typeX"')))
    assert spec.base == "typeX" and one(spark, names.element_count(F.lit(None).cast("array<struct<lo:int,hi:int>>"))) is None
    assert names and one(spark, names.human_bytes(F.lit(1536.0))) == "1.5 KB"


def test_diff_treats_null_as_empty(spark):
    schema = "k string, a string, b string"
    s = spark.createDataFrame([("1", None, "X"), ("2", "p", "q"), ("3", "s", "t")], schema)
    t = spark.createDataFrame([("1", "", "x"), ("2", "P", "r"), ("4", "s", "t")], schema)
    got = [(r.k, r.diff_type, [f.field_name for f in r.field_diffs]) for r in points.diff_ordered(points.diff(s, t, "k", ["a", "b"]), "k").collect()]
    assert got == [("3", "removed", []), ("4", "added", []), ("1", "unchanged", []), ("2", "modified", ["b"])]
    assert {r.k: r.a for r in points.upsert(s, t, "k", overwrite=True).collect()} == {"1": "", "2": "P", "3": "s", "4": "s"}


def test_struct_propagation_and_as_of(spark):
    refs = spark.createDataFrame([("db.a", "B1", "write"), ("db.a.x", "B2", "read"), ("db.a.y", "B3", "read"), ("db.c", "B4", "read")], "path string, block string, kind string")
    got = {tuple(r) for r in xref.propagate_struct_refs(refs).collect()}
    assert got == {("db.a.x", "B1", "write"), ("db.a.y", "B1", "write"), ("db.a.x", "B2", "read"), ("db.a.y", "B3", "read"), ("db.c", "B4", "read")}
    schema = "block string, var string, line int, value string"
    uses = spark.createDataFrame([("b", "i", 5, None), ("b", "i", 2, None), ("b", "j", 9, None)], schema)
    sets = spark.createDataFrame([("b", "i", 2, "1"), ("b", "i", 4, "2"), ("b", "i", 5, "3")], schema)
    assert {(r.var, r.line): r.resolved for r in xref.resolve_as_of(uses, sets).collect()} == {("i", 5): "2", ("i", 2): None, ("j", 9): None}


def test_graphs(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "D"), ("E", "F"), ("F", "E")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "ABCDEFG"], "n string")
    sizes = {r.comp: r.size for r in graph.component_sizes(graph.components_with_isolated(nodes, edges)).collect()}
    assert sizes == {"A": 3, "D": 1, "E": 2, "G": 1}
    assert {r.n: r.layer for r in graph.layers(nodes, edges).collect()} == {"C": 0, "B": 1, "A": 2, "G": 0, "D": None, "E": None, "F": None}
    assert {r.n: r.depth for r in graph.reachable(edges, nodes.where("n = 'A'")).collect()} == {"B": 1, "C": 2}
    chain = spark.range(60).selectExpr("id as a", "id + 1 as b")
    assert components.connected_components(chain).select("component").distinct().collect()[0][0] == 0


def test_flow_reassembly(spark):
    def frame(kind, node, size=30):
        return kind + b"F" + size.to_bytes(4, "little") + bytes(16) + bytes([1, 0]) + node.to_bytes(2, "little") + bytes(size - 28)

    stream = frame(b"MSG", 631) + frame(b"HEL", 1, 32) + frame(b"MSG", 634)
    parts = [stream[:10], stream[10:50], stream[50:]]
    df = spark.createDataFrame([("f", i, p, 4840) for i, p in enumerate(parts)] + [("g", 0, b"MSGF\x01\x00\x00\x00zz", 1)], "flow string, ts int, payload binary, dport int")
    got = [(r.flow, r.type, r.size, r.service, r.request) for r in network.dissect(df).orderBy("flow", "n").collect()]
    assert got == [("f", "MSG", 30, 631, True), ("f", "HEL", 32, None, True), ("f", "MSG", 30, 634, True)]


def test_results(spark):
    lines = spark.createDataFrame([("b", [1, 2, 3, 5, 6, 9], [2, 9]), ("c", [], [])], "block string, executable array<int>, touched array<int>")
    # ranges are of line numbers that follow one another
    got = {r.block: (r.percent, r.missing) for r in results.coverage(lines).collect()}
    assert got["b"] == (33.33, "1,3,5-6") and got["c"][1] == ""
    found = spark.createDataFrame([("a/b", "ERROR"), ("a", "INFO")], "section_path string, severity string")
    assert {r.section: (r.errors, r.findings) for r in results.section_counts(found).collect()} == {"a": (1, 2), "a/b": (1, 1)}


def test_recorder_and_ring(spark):
    rows = [("k", i, i not in (3, 4), 2, i * 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "key string, n int, start boolean, k int, x double")
    assert [r.n for r in signals.record(df, "key", "n", "start", "k", 3, False, ["x"]).collect()] == [7, 9, 11]
    ring = spark.createDataFrame([("k", 1, True, [4, 2, 3], [40.0, 20.0, 30.0])], "key string, write_idx int, wrapped boolean, sample_cycles array<long>, x array<double>")
    assert [r.x for r in signals.ring_rows(ring, "key", ["x"], 3, 10.0).orderBy("n").collect()] == [20.0, 30.0, 40.0]


def test_files(spark, tmp_path):
    bad = b"a\r\nb\n\xff"
    df = spark.createDataFrame([("x", bad), ("y", b"\xef\xbb\xbfa\r\nb")], "path string, content binary")
    got = {(r.path, r.rule_code) for r in corpus.byte_findings(df).collect()}
    assert {("x", "F001"), ("x", "F003")} <= got and not [p for p, _ in got if p == "y"]
    xml = """<Document><SW.Tags.PlcTag ID="1"><AttributeList><Name>DI_A_B</Name><DataTypeName>Bool</DataTypeName><LogicalAddress>%I1.0</LogicalAddress></AttributeList>
    <ObjectList><MultilingualText><ObjectList><MultilingualTextItem><AttributeList><Culture>de-DE</Culture><Text>x</Text></AttributeList></MultilingualTextItem>
    <MultilingualTextItem><AttributeList><Culture>en-US</Culture><Text>y</Text></AttributeList></MultilingualTextItem></ObjectList></MultilingualText></ObjectList></SW.Tags.PlcTag></Document>"""
    (tmp_path / "tags.xml").write_text(xml)
    tags = tables.read_tags(spark, str(tmp_path / "tags.xml"))
    row = tables.points_of_tags(tags).first()
    assert (row.mnemonic, row.plc_address, row.io_category) == ("DI_A_B", "%I1.0", "DI") and tags.first().comment == "y"
    (tmp_path / "p.csv").write_text("id,mnemonic,signal_name,customer_tag,functional_group,io_category,physical_type,data_type,hw_address,plc_address,is_safety,circuit_ref,control_unit,control_light,is_intrinsically_safe,xml_source\n1,DI_A,,,,,,,,,true,,,,,\n2,DI_A,n,,,,,,,,false,,,,,\n")
    back = tables.read_points(spark, str(tmp_path / "p.csv"))
    assert [(r.id, r.is_safety) for r in back.collect()] == [("2", False)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("f", i, i // 2 % 3) for i in range(20)] + [("g", i, i) for i in range(5)]
    df = spark.createDataFrame(rows, "flow string, n long, seq long")
    df.repartition(1).sortWithinPartitions("n").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = flows.retransmissions(stream, "flow", "n", "seq").writeStream.format("memory").queryName("retr").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    got = {r.flow: r.retrans for r in spark.sql("select flow, max(retrans) retrans from retr group by 1").collect() if r.retrans}
    want = {r.flow: r.retrans for r in network.retransmissions(df, "flow", ("n",), "seq").collect()}
    assert got == want
