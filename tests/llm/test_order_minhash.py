import hashlib
import random

import numpy as np

from fieldloom.llm import order_minhash as o


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_is_exact_where_it_matters():
    rnd = random.Random(2)
    for _ in range(2000):
        a = [rnd.randrange(6) for _ in range(rnd.randrange(1, 30))]
        b = list(a)
        for _ in range(rnd.randrange(6)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randrange(2)] = [rnd.randrange(6)] * rnd.randrange(2)
        if not b:
            continue
        m = lcs(a, b)
        s = m / (len(a) + len(b) - m)
        got = o.distance(np.array(a, np.uint64), np.array(b, np.uint64))
        assert abs(got - (1 - s)) < 1e-9 if s > 0.6 else got == 1.0, (a, b, s, got)


def brute(rows):
    """Class by id, from all pairs."""
    sh = [o.shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if same or (len(sh[i]) and len(sh[j]) and o.distance(sh[i], sh[j]) <= 0.2 + 1e-9):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))]


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows, passage = [], [word() for _ in range(40)]
    for g in range(6):
        base = [word() for _ in range(120)]
        for c in range(12):
            w = list(base)
            for _ in range(c % 5):
                w[rnd.randrange(len(w))] = word()
            if c % 4 == 3:
                w = passage + w[:60]
            rows.append((1000 - 12 * g - c, " ".join(w)))
    rows += [(7, ""), (8, ""), (9, None), (10, None), (11, "one two"), (12, "One  two"), (13, "one two three")]
    rows += [(14, " ".join(["la"] * 30000)), (15, " ".join(["la"] * 29000))]
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", b"n") for r in rows] + [(*rows[3], "x", b"n")], "doc_id long, text string, bucket string, node binary")
    got = o.classes(df).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: r.class_id for r in got} == dict(zip([r[0] for r in rows], brute(rows)))
    kept = o.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(rows)))


def test_empty_table_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert o.classes(spark.createDataFrame([], schema)).count() == 0
    got = o.classes(spark.createDataFrame([(None, "a b c"), (5, "a b c"), (None, "z")], schema)).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == [("5", "5"), ("None", "5"), ("None", "None")]


def test_chains_of_lengths_link_in_every_order_of_hashes(spark):
    """Of texts of 100, 98 and 79 shingles the shortest links to the second only."""
    rnd = random.Random(23)
    rows, count = [], {}
    while len(count) < 6 or min(count.values()) < 4:
        base = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(104)]
        texts = [" ".join(base[: n + 4]) for n in (100, 98, 79)]
        order = tuple(np.argsort([hashlib.md5(t.encode()).digest() for t in texts]).tolist())
        if count.get(order, 0) < 4:
            count[order] = count.get(order, 0) + 1
            rows += [(len(rows) + i, t) for i, t in enumerate(texts)]
    want = brute(rows)
    assert want == [i - i % 3 for i in range(len(rows))]
    got = o.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(want))


def test_ruled_out_against_lengths_and_bounds(spark):
    """A member leaves a bucket only if no other one can be within 0.2 of it."""
    members = {
        1: [("p", 100), ("x", 98), ("y", 79)],  # y unjudged: 0.21 from p by its length
        2: [("q", 80), ("u", 100), ("v", 80)],  # u holds all of q and v: 0.2 from both, which are 0.4 apart
        3: [("r", 100), ("w", 98), ("z", 50)],  # z is too short for w
    }
    judged = [("p", "x", 0.02), ("q", "u", 0.2), ("q", "v", 1.0), ("r", "w", 0.02)]
    state = spark.createDataFrame([(b, n.encode(), k, 0) for b, m in members.items() for n, k in m], "bucket long, node binary, n int, rank int")
    pivots = spark.createDataFrame([(b, m[0][0].encode(), m[0][1]) for b, m in members.items()], "bucket long, pivot binary, pivot_n int")
    pairs = spark.createDataFrame([(a.encode(), b.encode(), d) for a, b, d in judged], "a binary, b binary, dist double")
    out = o._ruled_out(o.Scratch(spark), state, pivots, pairs, None)
    assert [(r.bucket, bytes(r.node)) for r in out.collect()] == [(3, b"w")]


def test_buckets_of_one_component_are_not_carried(spark, monkeypatch):
    """Texts each 0.18 from the next: one class, though those further on are no links of a bucket's pivot."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(224)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 104])) for i in range(12)]
    keep, sizes = o.Scratch.keep, []

    def counted(self, df, name):
        out = keep(self, df, name)
        if name == "omh-state":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(o.Scratch, "keep", counted)
    got = o.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and len(got) == 12
    assert sizes[0] > 0 and sizes[1:] == [0]


def test_components_of_links_that_many_tasks_hold(spark, monkeypatch):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)]
    root = list(range(300))
    for _ in range(300):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    name = lambda i: f"{i:03}".encode()
    df = spark.createDataFrame([(name(a), name(b)) for a, b in links], "a binary, b binary").repartition(4)
    for most in (30, 1000):
        monkeypatch.setattr(o, "TASK_LINKS", most)
        got = {bytes(r.node): bytes(r.component) for r in o._components(o.Scratch(spark), df).collect()}
        assert all(got.get(name(i), name(i)) == name(root[i]) for i in range(300))
