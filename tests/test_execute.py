import pytest

from fieldloom.lang import execute
from fieldloom.lang.parser import parse_block

HEAD = "FUNCTION \"F\"\nVAR_INPUT\n v : Int;\n on : Bool;\nEND_VAR\nVAR_OUTPUT\n n : Int;\n r : Real;\nEND_VAR\nVAR_TEMP\n s : Int := 3;\n i : Int;\n arr : Array[0..2] of Int;\nEND_VAR\nBEGIN\n"
NATIVE = HEAD + """
REGION all
 IF #on AND #v > 3 THEN
   #n := #n + 1;
 ELSIF #v = 0 THEN #n := 7;
 ELSE
   CASE #v OF
     1, 2: #s := 5;
     3..4: #s := #s * 2;
     ELSE #s := -#s;
   END_CASE;
 END_IF;
 FOR #i := 2 TO 0 BY -1 DO #arr[#i] := #v * #i; #n += #arr[#i]; END_FOR;
 FOR #i := 3 TO 1 DO #n := 100; END_FOR;
 #r := #s / 2;
 IF NOT #on THEN #n := #n + #s; END_IF;
END_REGION
END_FUNCTION"""
STEPPED = HEAD + """
 #s := #v;
 WHILE #s > 10 DO #s := #s - 3; IF #s = 12 THEN EXIT; END_IF; END_WHILE;
 REPEAT #n := #n + 1; UNTIL #n >= #s END_REPEAT;
 FOR #i := 0 TO 9 DO IF #i MOD 2 = 0 THEN CONTINUE; END_IF; #n := #n + #i; IF #i > 6 THEN RETURN; END_IF; END_FOR;
 #n := -1;
END_FUNCTION"""


def rows_of(spark):
    return spark.createDataFrame([(v, on, f"k{v}") for v in range(-2, 20) for on in (True, False)] + [(None, True, "x"), (4, None, "y")], "v int, on boolean, k string")


def test_columns_equal_steps(spark):
    block = parse_block(NATIVE)
    df = rows_of(spark)
    plan = execute.run_function(df, block)
    assert plan.columns == ["v", "on", "k", "n", "r"] and "MapInPandas" not in plan._jdf.queryExecution().toString()
    start = execute.start_values(block)
    for r in plan.where("v is not null").collect():
        want = execute.scan(block.body, start | {"v": r.v, "on": r.on})
        if r.on is None:
            want = execute.scan(block.body, start | {"v": r.v, "on": False}) | {"n": r.n}
        assert (r.n, r.r) == (want["n"], want["r"]), r
    (x,) = plan.where("k = 'x'").collect()
    assert x.n is None


def by_hand(v):
    s, n = v, 0
    while s > 10:
        s -= 3
        if s == 12:
            break
    while True:
        n += 1
        if n >= s:
            break
    return n + 1 + 3 + 5 + 7


def test_loops_and_jumps_run_in_steps(spark):
    block = parse_block(STEPPED)
    with pytest.raises(execute.Unsupported):
        execute.compile_body(block.body, {}, {})
    got = execute.run_function(rows_of(spark).where("v is not null"), block)
    assert "MapInPandas" in got._jdf.queryExecution().toString()
    assert all(r.n == by_hand(r.v) for r in got.collect())
    with pytest.raises(RuntimeError):
        execute.scan(parse_block(HEAD + "WHILE TRUE DO #n := 1; END_WHILE;\nEND_FUNCTION").body, {"n": 0})
    with pytest.raises(IndexError):
        execute.scan(parse_block(HEAD + "#arr[5] := 1;\nEND_FUNCTION").body, {"arr": [0, 0, 0]})


def test_calls_bind_names_and_places():
    body = parse_block(HEAD + '"Twice"(x := #v, y => #n);\n#r := Half(#n);\nEND_FUNCTION').body
    got = execute.scan(body, {"v": 4, "n": 0, "r": 0.0}, {"Twice": lambda x: {"y": 2 * x}, "Half": lambda x: x / 2})
    assert (got["n"], got["r"]) == (8, 4.0)
    with pytest.raises(execute.Unsupported):
        execute.scan(body, {"v": 4, "n": 0, "r": 0.0})


COUNTER = "FUNCTION_BLOCK \"C\"\nVAR_INPUT\n v : Int;\nEND_VAR\nVAR_OUTPUT\n n : Int;\n hits : Int;\nEND_VAR\nVAR\n before : Int := -1;\nEND_VAR\nVAR_TEMP\n t : Int;\nEND_VAR\nBEGIN\n#t := #t + 1;\nIF #v > #before THEN #n := #n + #t; END_IF;\n#before := #v;\n#hits := #hits + 1;\nEND_FUNCTION_BLOCK"


def counted(rows):
    out, kept = {}, {}
    for k, t, v in sorted(rows, key=lambda r: (r[0], r[1])):
        n, before, hits = kept.get(k, (0, -1, 0))
        kept[k] = (n + (v > before), v, hits + 1)
        out[(k, t)] = (kept[k][0], kept[k][2])
    return out


def test_cycles_keep_state_by_instance(spark):
    import random

    rnd = random.Random(2)
    rows = [(rnd.randrange(4), t, rnd.randrange(6)) for t in range(60)]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    got = {(r.k, r.t): (r.n, r.hits) for r in execute.run_cycles(df, parse_block(COUNTER), "k", ("t",)).collect()}
    assert got == counted(rows)
    assert execute.run_cycles(df.limit(0), parse_block(COUNTER), "k", ("t",)).count() == 0
    assert execute.run_cycles(spark.createDataFrame([(None, 1, 1), (None, 2, 2)], "k int, t int, v int"), parse_block(COUNTER), "k", ("t",)).orderBy("t").collect()[-1].n == 2


def test_stream_keeps_state_between_batches(spark, tmp_path):
    block = parse_block(COUNTER.replace("#t := #t + 1;", "#t := 1;"))
    rows = [(k, t, (k * t) % 5) for t in range(20) for k in range(3)]
    for part in range(2):
        spark.createDataFrame([r for r in rows if (r[1] >= 10) == part], "k int, t int, v int").coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema("k int, t int, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = execute.run_stream(stream, block, "k", "t").writeStream.format("memory").queryName("cycles").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.k, r.t): (r.n, r.hits) for r in spark.table("cycles").collect()} == counted(rows)
