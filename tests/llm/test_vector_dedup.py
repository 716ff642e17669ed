import numpy as np

from fieldloom.llm import vector_dedup as v


def brute(ids, x, cosine):
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = n @ n.T >= cosine
    np.fill_diagonal(hits, False)
    comp = list(ids)
    for _ in ids:
        comp = [min([c, *(comp[j] for j in np.flatnonzero(h))]) for c, h in zip(comp, hits)]
    return {i: (int(h.sum()), c, i == c) for i, h, c in zip(ids, hits, comp)}


def test_against_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(150, 24))
    near = base[:60] + 0.05 * rng.normal(size=(60, 24))
    hot = base[0] + 0.08 * rng.normal(size=(120, 24))
    x = np.vstack([base, near, hot, np.repeat(base[5:6], 40, axis=0), 3.5 * base[7:9]]).astype(np.float32)
    ids = rng.permutation(len(x)) + 10
    rows = [(int(i), [float(c) for c in r], 1) for i, r in zip(ids, x)]
    bad = [(1, None, 1), (2, [0.0] * 24, 1), (3, [float("nan")] * 24, 1), (4, [None] * 24, 1), (5, [float("inf")] + [1.0] * 23, 1), (6, [1.0], 1), (7, [], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, p int")
    old, v.BLOCK = v.BLOCK, 64
    try:
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in v.near_vectors(df, cell_rows=40).collect()}
    finally:
        v.BLOCK = old
    want = brute([int(i) for i in ids], x.astype(float), 0.95)
    assert {i: got[i] for i in want} == want
    assert all(got[i[0]] == (0, i[0], True) for i in bad)
    assert v.near_vectors(df.limit(0)).count() == 0 and v.near_vectors(df.where("vec_id < 5")).count() == 4


def test_full_slack_shows_every_border_pair():
    rng = np.random.default_rng(5)
    x = v.normed(rng.normal(size=(400, 16)))
    y = v.normed(x + 0.07 * rng.normal(size=x.shape))
    centres = v.spherical_kmeans(x, 12)
    hx, sx = v.cells_of(x, centres, 0.95, 1.0)
    hy, sy = v.cells_of(y, centres, 0.95, 1.0)
    for i in np.flatnonzero((x * y).sum(axis=1) >= 0.95):
        assert hy[i] in sx[i] or hx[i] in sy[i]


def test_lengths_are_taken_in_turn(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for d, n in ((16, 80), (5, 50), (2, 7)):
        x = rng.normal(size=(n, d))
        x = np.vstack([x, x[: n // 2] + 0.04 * rng.normal(size=(n // 2, d)), x[:3]])
        ids = [len(rows) + i for i in range(len(x))]
        rows += [(i, [float(c) for c in r]) for i, r in zip(ids, x)]
        want |= brute(ids, x, 0.95)
    got = v.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell_rows=20).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want


def test_planted_pairs_at_the_threshold(spark):
    """Pairs just above and just below 0.95 are told apart, whatever cells part them."""
    rng = np.random.default_rng(4)
    x = v.normed(rng.normal(size=(600, 64)))
    u = rng.normal(size=x.shape)
    u = v.normed(u - (u * x).sum(axis=1, keepdims=True) * x)
    cos = np.where(np.arange(600) % 2 == 0, 0.95 + 1e-9, 0.95 - 1e-9)
    y = cos[:, None] * x + np.sqrt(1 - cos**2)[:, None] * u
    rows = [(i, r.tolist()) for i, r in enumerate(np.vstack([x, y]))]
    got = v.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell_rows=50).collect()
    assert {r.vec_id: r.n_links for r in got} == {i: int(i % 600 % 2 == 0) for i in range(1200)}
