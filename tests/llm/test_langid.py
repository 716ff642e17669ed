import numpy as np

from fieldloom.llm import langid

EN = "the quick brown fox jumps over the lazy dog while the rain keeps falling on the old town"
DE = "der schnelle braune fuchs springt über den faulen hund während der regen auf die alte stadt fällt"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_mixture_and_unknown(spark):
    rows = [(i, (EN if i % 2 else DE) + f" {'x' * (i % 3)}", "en" if i % 2 else "de", 1.0) for i in range(60)]
    df = docs(spark, rows + [(100, None, None, None), (101, "", "en", None), (102, "12 34 !!", None, None), (None, EN, None, None), (103, f"{EN} {EN} {DE}", None, 0.0), (104, EN * 3000, None, None)])
    model = langid.train(df)
    assert model.languages == ["de", "en"]
    assert np.allclose(model.table.sum(axis=0), 1)
    got = {r.doc_id: r.p for r in df.select("doc_id", langid.predicted(df, model, df["text"]).alias("p")).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "de" and got[104].lang_pred == "en"
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (100, 101, 102))
    assert got[103].lang_pred == "en" and 0.5 < got[103].score < 0.8 and "de:" in got[103].languages
    assert langid.keep_identified(df).count() == 63 and langid.keep_identified(df).columns == df.columns


def test_nothing_labelled(spark):
    df = docs(spark, [(1, EN, None, None)])
    model = langid.train(df)
    assert df.select(langid.predicted(df, model, df["text"]).alias("p")).first().p.lang_pred == "und"
    assert langid.keep_identified(df.limit(0)).count() == 0


def test_em_recovers_proportions():
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(200) * 0.1, size=3).T + 1e-9
    n = rng.multinomial(20000, p @ [0.6, 0.3, 0.1] / (p @ [0.6, 0.3, 0.1]).sum()).astype(float)
    pi, _ = langid.fit_mixture(p, n)
    assert np.abs(pi - [0.6, 0.3, 0.1]).max() < 0.03


def test_held_out_is_the_crc(spark):
    import zlib

    df = spark.range(200).withColumnRenamed("id", "doc_id")
    for r in df.select("doc_id", langid.held_out(df["doc_id"]).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language_sets_equal_brute_force():
    """The set kept is the best of all sets by penalised likelihood, on mixtures of four languages."""
    import itertools
    import math
    import random

    rnd = random.Random(12)
    syllables = {k: [a + b for a in cs for b in "aeiou"] for k, cs in {"aa": "bdgk", "bb": "kmnp", "cc": "prst", "dd": "tvzb"}.items()}
    say = lambda lang, n: " ".join("".join(rnd.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    names = sorted(syllables)
    table = np.full((langid.BUCKETS, 4), langid.SMOOTHING)
    for i, lang in enumerate(names):
        table[:, i] += np.bincount(langid.trigrams(say(lang, 4000)), minlength=langid.BUCKETS)
    model = langid.Model(names, table / table.sum(axis=0))
    for size in (1, 1, 2, 2, 3, 4) * 6:
        mix = rnd.sample(names, size)
        text = " ".join(say(lang, rnd.choice((20, 60, 200))) for lang in mix)
        grams = langid.trigrams(text)
        ids, n = langid.counted(grams)
        charge = langid.PENALTY * math.log(len(grams) + 1)
        sets = [c for k in range(1, 5) for c in itertools.combinations(range(4), k)]
        best = max(sets, key=lambda c: langid.fit_mixture(model.table[ids][:, list(c)], n)[1] - charge * len(c))
        assert set(langid.infer(model, text)) == {names[i] for i in best}
