import hashlib
import itertools
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import spm_lattice as s

P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")
TEXTS = ["Hello  world", " a", "a ", "ﬁ Ａ\tb\n\nc", "é", "   ", "", None, "日本▁x", "a\r\nb\x00", "ththre.example.com/fr?x=1 éeuxêoi", "x" * 500, "naïve " * 50, "\n", "a\n b"]


def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_sentencepiece(spark):
    sp, model = processor(), s.load(PATH)
    assert model.kind == "bpe"
    rnd = random.Random(7)
    texts = TEXTS + ["".join(rnd.choice("theréou .,\n▁1") for _ in range(30)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    got = [(r.doc_id, r.ids) for r in s.encode(df, model).collect()]
    want = [(i, sp.encode(t or "")) for i, t in enumerate(texts)] + [(0, sp.encode(texts[0]))]
    assert sorted(got) == sorted(want)
    words = s.Words(model)
    row = spark.createDataFrame([(t,) for t in texts], "text string").select(s.words_of(F.col("text")).alias("w"))
    for r, t in zip(row.collect(), texts):
        assert [i for w in (r.w or []) for i in words[w]] == sp.encode(t or "")
    back = spark.createDataFrame([(i, sp.encode(t or "")) for i, t in enumerate(texts)], "k long, ids array<int>")
    for r in back.select("k", s.decoded(F.col("ids"), model).alias("t")).collect():
        assert r.t == sp.decode(sp.encode(texts[r.k] or "")), texts[r.k]
    assert s.encode(df.limit(0), model).count() == 0
    direct = s.encode_texts(df, model)
    assert sorted((r.doc_id, r.ids) for r in direct.collect()) == sorted(want)
    digest = {hashlib.sha256(sp.decode(sp.encode(t or "")).encode()).hexdigest() for t in texts}
    assert {r.decoded_sha256 for r in direct.collect()} == digest
    assert s.encode_texts(df.limit(0), model).count() == 0


def test_viterbi_against_all_paths(spark):
    rnd = random.Random(2)
    pieces = [("".join(p), 300 + i, -rnd.random() * 5 - 0.01) for i, p in enumerate(itertools.chain(itertools.product("ab▁"), itertools.product("ab", repeat=2), itertools.product("ab", repeat=3)))]
    model = s.Model(pieces, "unigram", 3)
    score = {p: (v, i) for p, i, v in pieces}

    def best(word):
        paths = []
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            parts = [word[a:b] for a, b in zip(at, at[1:])]
            if all(p in score for p in parts):
                paths.append((sum(score[p][0] for p in parts), [score[p][1] for p in parts]))
        return max(paths)[0]

    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 9))) for _ in range(40)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for r in s.encode_words(df, model).collect():
        by_id = {i: v for v, i in score.values()}
        assert abs(sum(by_id[i] for i in r.ids) - best(r.word)) < 1e-9, r.word


def test_one_pass_equals_replay_and_library(spark):
    """Words up to and over 64 characters, parted at marks and digits, with bytes and repeats."""
    sp, model = processor(), s.load(PATH)
    assert model.ordered and model.odd == ["▁▁▁"] and model.word != s.WORD
    rnd = random.Random(3)
    alphabet = "thereouniganß日ﷺ\u0301\U0001f600"
    words = ["".join(rnd.choice(alphabet) for _ in range(n)) for n in (1, 2, 3, 9, 20, 62, 63, 64, 64, 65, 90) for _ in range(6)]
    words += ["a" * n for n in (2, 3, 5, 63, 64, 65)] + ["▁" + "ing" * 21, "▁" * 64, "日" * 64, "\U0001f600"]
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    edges = s.lattice(df.where((F.length("word") <= s.FOLDED_CHARS) & ~F.contains("word", F.lit("▁▁▁"))), model, packed=True)
    table = {p: (v, i) for p, i, v in model.pieces}
    got = edges.select("word", s.fold_ranked(F.col("word"), F.col("edges"), model).alias("ids")).collect()
    assert len(got) == len({w for w in words if len(w) <= 64 and "▁▁▁" not in w})
    got += s.encode_words(df, model).collect()
    for r in got:
        assert r.ids == s.merged(r.word, table, model.first_byte), r.word
    for t in ("x1y.22,,_a__b 3.5%%% ²a", "Haanth.\nthe2nd (of) ...", "  12  .a"):
        assert "".join(s.split(t, model)) == s.SPACE + t.replace(" ", s.SPACE)
        assert [i for w in s.split(t, model) for i in s.Words(model)[w]] == sp.encode(t)


def test_models_that_one_pass_does_not_fit(spark):
    """A piece made by a merge worse than itself, and pieces across letters and marks."""
    model = s.Model([("a", 300, -9.0), ("b", 301, -9.5), ("c", 302, -9.6), (".", 303, -9.7), ("bc", 304, -5.0), ("abc", 305, -2.0), ("c.", 306, -3.0)], "bpe", 3)
    assert model.odd == ["abc"] and model.word is s.WORD
    odder = s.Model([*model.pieces, *[(f"{c}bc", 400 + k, -2.0) for k, c in enumerate("ghijklmnopqrstuvwyz")]], "bpe", 3)
    assert not odder.ordered
    words = ["abc", "abc.", "bcabc", "xabc", "c.c."]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    table = {p: (v, i) for p, i, v in model.pieces}
    assert {r.word: r.ids for r in s.encode_words(df, model).collect()} == {w: s.merged(w, table, 3) for w in words}
    table = {p: (v, i) for p, i, v in odder.pieces}
    assert {r.word: r.ids for r in s.encode_words(df, odder).collect()} == {w: s.merged(w, table, 3) for w in words}


def test_a_word_is_kept_once_however_many_chunks_hold_it(spark, monkeypatch):
    sp, model = processor(), s.load(PATH)
    monkeypatch.setattr(s, "CHUNK_CHARS", 40)
    kept, keep = {}, s.Scratch.keep

    def noted(self, df, name):
        kept[name] = keep(self, df, name)
        return kept[name]

    monkeypatch.setattr(s.Scratch, "keep", noted)
    texts = [f"the thing, {k % 7} ins. the" for k in range(60)] + [None, ""]
    df = spark.createDataFrame([(None if k == 5 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.objectHashAggregate.sortBased.fallbackThreshold")
    got = [(r.doc_id, r.n_ids, r.ids) for r in s.encode(df, model).collect()]
    want = [(None if k == 5 else k, len(ids), ids) for k, t in enumerate(texts) for ids in [sp.encode(t or "")]]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert kept["spm-used"].count() == len({w for t in texts for w in s.split(t, model)})
    assert spark.conf.get("spark.sql.objectHashAggregate.sortBased.fallbackThreshold") == before


def test_texts_parted_in_arrays_equal_split(monkeypatch):
    """Every code point, alone and beside others, by both ways of parting, texts over and under a block."""
    monkeypatch.setattr(s, "PARTED_CHARS", 1000)
    rnd = random.Random(11)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    texts = [None, "", None, *TEXTS, every, "".join(rnd.sample(every, len(every)))]
    texts += ["".join(rnd.choice("ab1_² \n.▁é日٣\U0001f600\t") for _ in range(rnd.randrange(40))) for _ in range(2000)]
    whole = s.Model([("a", 300, -9.0), ("b.", 301, -9.5), ("1b", 302, -9.6)], "bpe", 3)
    assert whole.word is s.WORD
    for model in (s.load(PATH), whole):
        words, first = s._words_of_texts(pa.chunked_array([pa.array(texts, pa.string())]), model)
        words = words.to_pylist()
        assert [words[a:b] for a, b in zip(first, first[1:])] == [s.split(t, model) for t in texts]
    words, first = s._words_of_texts(pa.chunked_array([pa.array([None, ""], pa.string())]), whole)
    assert len(words) == 0 and first.tolist() == [0, 0, 0]


def test_words_travel_narrow_and_decode_by_their_ids():
    model = s.load(PATH)
    words = sorted({w for t in TEXTS for w in s.split(t, model)} | {f"▁w{k}é" for k in range(3000)})
    coded = s.Words(model)
    table = pa.Table.from_arrays([pa.array(words, pa.large_string()), pa.array([coded[w] for w in words], pa.large_list(pa.int32()))], schema=s.WORDS)
    for part in (table, table[7:50], table[:0]):
        assert s._widened(s._narrowed(part)).equals(part)
    assert len(s._pack(s._narrowed(table))) < 0.8 * len(s._pack(table))
    texts = pa.table({"doc_id": pa.array([7, None, 8], pa.int64()), "text": ["a b", None, "b"]})
    wrong = {"▁a": [s.Words(model)["▁b"][0]], "▁b": [model.first_byte + 0xFF]}
    known = s.Known(pa.array(list(wrong), pa.large_string()), pa.array(list(wrong.values()), pa.large_list(pa.int32())), model)
    got = known.rows(texts, True).to_pylist()
    ids = [wrong["▁a"] + wrong["▁b"], [], wrong["▁b"]]
    assert [(r["doc_id"], r["n_ids"], r["ids"]) for r in got] == [(7, 2, ids[0]), (None, 0, []), (8, 1, ids[2])]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(",".join(map(str, x)).encode()) for x in ids]
    assert [r["decoded_sha256"] for r in got] == [hashlib.sha256(x.encode()).hexdigest() for x in ("b\ufffd", "", "\ufffd")]
    with pytest.raises(ValueError, match="no ids"):
        known.rows(pa.table({"doc_id": [1], "text": ["c"]}), False)


def test_words_keep_their_chunks_over_the_lattice(spark, monkeypatch):
    """No join of words and chunks; a word in many chunks and one merged on a heap among them."""
    monkeypatch.setattr(s, "CHUNK_CHARS", 100)
    kept, keep = {}, s.Scratch.keep

    def noted(self, df, name):
        kept[name] = keep(self, df, name)
        return kept[name]

    monkeypatch.setattr(s.Scratch, "keep", noted)
    texts = [f"the {'y' * 80} {k % 3}   ▁▁▁a" for k in range(40)]
    out = s.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), s.load(PATH))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "FlatMapCoGroupsInArrow" in plan
    sp = processor()
    got = {r.doc_id: r for r in out.collect()}
    assert [got[k].ids for k in range(40)] == [sp.encode(t) for t in texts]
    assert [got[k].decoded_sha256 for k in range(40)] == [hashlib.sha256(sp.decode(sp.encode(t)).encode()).hexdigest() for t in texts]
    chunks = {r.word: r.chunks for r in kept["spm-words"].collect()}
    assert chunks == {r.word: r.chunks for r in kept["spm-used"].collect()} and len(chunks["▁the"]) > 10
    assert len(chunks["▁" + "y" * 80]) == len(set(chunks["▁the"]))
