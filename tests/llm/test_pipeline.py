import itertools
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from fieldloom.llm import langid, order_minhash, pii

from ..compare import SF
from .test_archives_urls_rules import covered

P = pytest.importorskip("public_tokenizers")


def good(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars = len(words), sum(map(len, words))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    dup = len(lines) - len(set(lines))
    return not (
        n < 50 or chars < 2 * n or chars > 20 * n or 10 * symbols > 5 * chars or len(lines) >= 4 and 2 * dup > len(lines) or 100 * covered(words) > 50 * n
    )


def one_of_each(rows):
    """Rows with the smallest id of their class, from all pairs."""
    rows = sorted(rows)
    sh = [order_minhash.shingles(t) for _, t in rows]
    sets = [set(order_minhash.labelled(h).tolist()) for h in sh]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            near = len(sets[i] & sets[j]) >= 0.4 * max(len(sets[i]), len(sets[j]))
            if near and order_minhash.distance(sh[i], sh[j]) <= 0.2 + 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [rows[i] for i in range(len(rows)) if find(i) == i]


def test_pipeline_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    rows = [r for r in rows if good(r[1])]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    shares = {i: langid.infer(model, t) for i, t, _ in rows}
    rows = [(i, t) for i, t, _ in rows if shares[i] and max(shares[i].values()) >= langid.LEAST_SHARE]
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = set()
    for i, text in one_of_each(rows):
        ids = t.encode(pii.redacted(text), add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want.add((i, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    got = cp.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_stages_take_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join("".join(x) for x in itertools.islice(itertools.product("bdk", "aeiou", "lmnr", "aeio"), 200))
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, words, "en", None, 3), (4, words, None, "s", 1), (4, words, None, "s", 1), (5, words + " a@b.com", "en", "s", 1)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out = cp.STAGES[-1][1](spark, docs, SF)
        assert sorted({r.doc_id for r in out.collect()}) == ([4] if rows else [])
