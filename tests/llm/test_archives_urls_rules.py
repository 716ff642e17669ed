import random
import re

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import chat_format, quality, queries, url_filters, warc

from ..compare import same

CHAT = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_warc", "op3_url_filters", "op4_quality_rules"])
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_archives_round_trip(spark):
    rows = [(5, "http://a", "same"), (3, "http://b\r\nx", "same"), (9, None, None), (8, "u", ""), (7, "v", "WARC/1.1\r\n\r\nx" * 2000), (7, "v", "other"), (None, "w", "same"), (2, "é", "ü" * 70000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit(1))
    got = warc.archive_pages(df).collect()
    assert len(got) == len(rows)
    by = {(r.record_id, r.payload_bytes): (r.record_type, r.refers_to) for r in got}
    assert by[(3, 4)] == ("response", None) and by[(5, 4)] == ("revisit", 3)
    assert by[(8, 0)] == ("response", None) and by[(9, 0)] == ("revisit", 8)
    assert by[(2, 140000)] == ("response", None)
    digests = {r.record_id: r.payload_digest for r in got}
    assert digests[9] == warc.payload_digest(b"") and digests[3] == warc.payload_digest(b"same")
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_inflate_any_members():
    import gzip
    import io

    data = random.Random(1).randbytes(200000)
    for parts in ([data], [data[:5], data[5:70000], b"", data[70000:]]):
        stream = io.BytesIO(b"".join(gzip.compress(p) for p in parts))
        assert b"".join(warc.inflate(stream, 777)) == data
    with pytest.raises(EOFError):
        list(warc.inflate(io.BytesIO(gzip.compress(data)[:-20])))


def test_aliases_share_blocks(spark):
    link = '<link href="{}" rel="canonical">'
    rows = [
        (1, "http://a.net/x", link.format("https://example.org/es/1")),
        (2, "http://b.net/y", '<meta http-equiv="refresh" content="0; url=http://a.net/x">'),
        (3, "http://c.net/z", link.format("/w")),
        (4, "http://C.net/w#top", link.format("http://bad.com/de/1")),
        (5, "http://d.org/", link.format("http://c.net/w")),
        (6, "nothing", link.format("http://bad.com/de/1")), (7, None, None), (8, "http://free.net", ""), (8, "http://free.net", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("component", F.lit(0))
    rules = queries.URL_RULES
    for given in (rules, spark.createDataFrame(rules, "host string, path string, verdict string")):
        got = sorted((r.page_id, r.host, r.rule, r.verdict) for r in url_filters.judge_urls(df, given).collect())
        assert [(g[0], g[3]) for g in got] == [(1, "block"), (2, "block"), (3, "allow"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "allow"), (8, "allow")]
        assert got[4][2] == "org/" and got[3][1] == "c.net" and got[5][1] == got[6][1] == ""
    assert url_filters.judge_urls(df.limit(0), rules).count() == 0


def covered(words):
    at, out = {}, set()
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            out |= {j for i in places for j in (i, i + 1, i + 2)}
    return len(out)


def test_measures_against_brute_force(spark):
    rnd = random.Random(6)
    texts = [None, "", " \n\t ", "a b c a b c", "x" * 5, "\x0ba\x1fb\x85c d"] + ["".join(rnd.choice("ab \n#é|\t") for _ in range(rnd.randrange(160))) for _ in range(150)] + ["w v u " * 20000]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, n long, source string")
    order = quality.rule_order(df)
    assert {r.name for r in order} == {r.name for r in quality.RULES}
    for r in quality.judge(df, order=order).collect():
        t = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), covered(words))
    kept = {r.doc_id for r in quality.judge(df, order=order).where("rejected_by is null").collect()}
    assert {r.doc_id for r in quality.keep_good(df, order=order).collect()} == kept
    assert quality.keep_good(df.limit(0)).columns == df.columns and quality.judge(df.limit(0)).count() == 0


def test_rotation(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 1, "bob", "yo"), (1, 600, "ann", None), (2, None, None, "x"), (None, 5, "c d", "y"), (None, 300, "e", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], f"{CHAT}, start long")
    segments = chat_format.rotate(df)
    got = {(r.conv_id, r.perspective): (r.rendered, [r.rendered[m.start : m.end] for m in r.masks]) for r in chat_format.dialogues(segments).collect()}
    ann = "<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert got[(1, "ann")] == (ann, ["hi<|im_end|>", "<|im_end|>"])
    assert got[(1, "bob")][1] == ["yo<|im_end|>"] and got[(2, "unknown")][1] == ["x<|im_end|>"]
    assert "name=c_d\n" in got[(None, "e")][0]
    assert {r.copies for r in segments.collect()} == {1, 2} and chat_format.rotate(df.limit(0)).count() == 0


LINKED = [
    (1, "http://a.net/x", '<LINK title=1 href="https://example.org/es/1" rel="alternate canonical">'),
    (2, "http://b.net/y", """<meta http-equiv="refresh" content="0; url='http://a.net/x'"><link rel=canonical href=http://b.net/z>"""),
    (3, "HTTP://b.net/z#f", "<p>"), (4, "http://c.net/d/e?q=1", '<link rel="canonical" href="f"><link rel="canonical" href="//bad.com/de/2">'),
    (5, "http://c.net/d/f", "<link data-rel=canonical href=http://lone.net/>"), (6, "http://e.org/", "<link rel=canonical href=/k?a=1&amp;b=2>"),
    (7, "http://e.org/k?a=1&b=2", ""), (8, "http://x.com/de/1", "<link rel=canonical href=http://b.net/z>"), (9, None, "<link rel=canonical href=http://b.net/z>"),
    (10, "http://lone.net/", None), (11, "no address", "<link rel=canonical href=http://b.net/z>"), (12, "http://g.com/fr/1", "<link rel=canonical href=http://h.net/>"), (13, "http://h.net/", "<link rel=canonical href=http://i.com/de/>"),
]


def test_linked_pages_equal_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame(LINKED, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"select page_id, host, path, rule, verdict from ({queries.OP3_SQL})").fetchall()
    got = [tuple(r) for r in queries.op3_url_filters(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    verdicts = {r[0]: r[4] for r in got}
    assert {i for i in verdicts if verdicts[i] == "block"} == {1, 2, 3, 4, 5, 8}
    assert verdicts[13] == "allow" and verdicts[10] == "allow"


def test_dot_segments(spark):
    rows = [("http://a.net/b/c/d?x", "../e", "http://a.net/b/e"), ("http://a.net/b/", "./../../f/.", "http://a.net/f/"), ("http://a.net", "g/..", "http://a.net/"), ("http://a.net/b", "/h/./i?p=/../q", "http://a.net/h/i?p=/../q")]
    df = spark.createDataFrame(rows, "base string, href string, want string")
    for r in df.select(url_filters.resolve(F.col("base"), F.col("href")).alias("got"), "want").collect():
        assert r.got == r.want


def test_working_columns_may_be_taken(spark):
    df = spark.createDataFrame([(1, "word " * 60, 1, 2, 3, 4)], "doc_id long, text string, __words int, __row int, __node int, __language int")
    assert quality.keep_good(df).columns == quality.judge(df).columns[:6] == df.columns
    from fieldloom.llm import langid, order_minhash

    assert order_minhash.keep_one(df).collect()[0]["__node"] == 3
    assert langid.keep_identified(df.withColumn("lang", F.lit("en"))).columns == [*df.columns, "lang"]


def test_many_rows_of_one_turn_and_names_alike(spark):
    rows = [(1, None, "c d", f"t{i:04d}") for i in range(1500)] + [(1, None, "c_d", "z")]
    got = chat_format.rotate(spark.createDataFrame(rows, CHAT)).orderBy("perspective", "start").collect()
    for perspective in ("c d", "c_d"):
        mine = [r for r in got if r.perspective == perspective]
        assert len(mine) == 1501 and [r.start for r in mine] == [sum(len(x.segment) for x in mine[:i]) for i in range(1501)]
        assert {r.speaker for r in mine if r.mask_length} == {perspective}
