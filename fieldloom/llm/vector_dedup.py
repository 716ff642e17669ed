"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one vector kept a group.

Equal vectors are one point with a weight.  Cells come from spherical k-means
on a bounded sample; every point is put in the cell of the nearest centre and
also shown to the cells across whose boundary a partner may lie.  For a pair
with cosine c, |x - y| = sqrt(2 - 2c) bounds how far x is from the border that
separates the cells; the border of cells i and j is met by a probe of x if
<x, ci - cj> is below that distance times |ci - cj| times ``slack``.  With the
default of 1 that finds every pair; less is faster and may lose some.

Neighbouring cells form bins of about ``BLOCK`` rows, so that a row travels
once to a bin however many of its cells show it.  A bin with more rows and
visitors than a block holds is cut into blocks, and products are taken for
pairs of blocks: a task holds two blocks and a strip of products, whatever a
bin's size.  Pairs of a
common bin are counted where the probe rule shows them first, so no pair counts
twice, and only counts and a spanning set of links leave a task.

The driver holds the sample, the centres and a number per bin: at most
``SAMPLE_ROWS`` vectors and ``SAMPLE_ROWS / SAMPLE_PER_CELL`` cells, whatever
the input's size.  Vectors of each length are taken in turn.

Defined results: null or zero vectors and vectors with null or non-finite
components link with nothing and are kept, as do vectors of different lengths
among each other; repeated rows are equal vectors; a null id takes part in
counts and never is the smallest; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

COSINE = 0.95
#: Points for which there is one more cell.
CELL_ROWS = 4096
BLOCK = 16_384
#: How many bins' rows, and how many bytes of components, a block of a bin and its visitors holds.
VISITORS, BLOCK_BYTES = 4, 96 << 20
#: Rows of a block whose products are held at a time.
STRIP = 512
#: Points of the training sample that are expected for each cell, and of the sample at most.
SAMPLE_PER_CELL, SAMPLE_ROWS = 128, 200_000
ROUNDS = 12
SLACK = 1.0
#: Products are screened in single precision; what comes this close is computed again in double.
MARGIN = 1e-4
#: Products of rows and centres that are held at a time.
PRODUCTS = 1 << 22


def normed(v: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, scaled first so that no square overflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centres of length 1; empty cells get the points that fit their own worst."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near, fit = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), 8192):
            s = x[at : at + 8192] @ centres.T
            near[at : at + 8192] = s.argmax(axis=1)
            fit[at : at + 8192] = s.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        bad = np.flatnonzero(norm < 1e-9)
        sums[bad] = x[np.argsort(fit)[: len(bad)]]
        norm[bad] = 1
        centres = sums / norm[:, None]
    return centres


def cells_of(x: np.ndarray, centres: np.ndarray, cosine: float, slack: float) -> tuple[np.ndarray, list[list[int]]]:
    """Home cell of each row, and all cells that are shown it (home included, ascending)."""
    reach = np.sqrt(2 - 2 * cosine) * slack
    homes, shown = [], []
    step = max(1, PRODUCTS // len(centres))
    for at in range(0, len(x), step):
        s = x[at : at + step] @ centres.T
        home = s.argmax(axis=1)
        short = s[np.arange(len(s)), home][:, None] - s
        # centres are at most 2 apart; of those near enough for that, the true distance decides
        i, j = np.nonzero(short <= 2 * reach)
        apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", centres[home[i]], centres[j])))
        near = (short[i, j] <= reach * apart) | (j == home[i])
        i, j = i[near], j[near]
        shown += [c.tolist() for c in np.split(j, np.flatnonzero(np.diff(i)) + 1)]
        homes.append(home)
    return np.concatenate(homes), shown


def bins_of(centres: np.ndarray, cells: int) -> np.ndarray:
    """A bin for each centre: ``cells`` that follow one another along the direction in which centres differ most."""
    spread = centres - centres.mean(axis=0)
    along = spread @ np.linalg.svd(spread, full_matrices=False)[2][0]
    out = np.empty(len(centres), np.int64)
    out[np.argsort(along, kind="stable")] = np.arange(len(centres)) // cells
    return out


def _rows(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()) if len(vectors) else np.empty((0, 0))


def compare(a: pd.DataFrame, b: pd.DataFrame, cell: int, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, bytes]]]:
    """Weights linked to each row of ``a`` and of ``b``, and links that span the pairs found.

    A pair counts here if both rows are shown to this cell, one of them is at
    home in it, and no smaller cell sees it the same way.
    """
    same = a is b
    xa = normed(_rows(a["v"]))
    xb = xa if same else normed(_rows(b["v"]))
    fa = xa.astype(np.float32)
    fb = fa if same else xb.astype(np.float32)
    ha, hb = a["home"].to_numpy(np.int64), b["home"].to_numpy(np.int64)
    wa, wb = a["w"].to_numpy(), b["w"].to_numpy()
    pa, pb = a["p"].to_numpy(), b["p"].to_numpy()
    cells = 1 + max(int(ha.max()), int(hb.max()), cell)
    in_a, in_b = _shown_codes(a["shown"], cells), _shown_codes(b["shown"], cells)
    na, nb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    # labels of a's rows, then b's; a block with itself has one set
    label = np.arange(len(a) if same else len(a) + len(b))
    shift = 0 if same else len(a)
    links = []
    # rows at home here with all rows, then the others with those at home; two visitors never count here
    every = np.arange(len(b))
    parts = [(np.flatnonzero(ha == cell), every)]
    if not same:
        parts.append((np.flatnonzero(ha != cell), np.flatnonzero(hb == cell)))
    for rows, cols in [(r[at : at + STRIP], c) for r, c in parts for at in range(0, len(r), STRIP)]:
        hits = fa[rows] @ fb[cols].T >= cosine - MARGIN
        if same:
            hits &= (cols[None, :] > rows[:, None]) | (hb[cols] != cell)[None, :]
        ia, ib = np.nonzero(hits)
        ia, ib = rows[ia], cols[ib]
        exact = np.concatenate([np.einsum("ij,ij->i", xa[ia[k : k + BLOCK]], xb[ib[k : k + BLOCK]]) for k in range(0, len(ia) or 1, BLOCK)])
        keep = exact >= cosine
        # at home in different cells: each may be shown to the other's
        cross = keep & (ha[ia] != hb[ib])
        if cross.any():
            here = ha[ia] == cell
            other = np.where(here, hb[ib], ha[ia])
            seen = np.where(here, np.isin(ia * cells + other, in_a), np.isin(ib * cells + other, in_b))
            keep &= ~(cross & (other < cell) & seen)
        ia, ib = ia[keep], ib[keep]
        na += np.bincount(ia, wb[ib], len(a)).astype(np.int64)
        nb += np.bincount(ib, wa[ia], len(b)).astype(np.int64)
        for i, js in zip(*_groups(ia, ib)):
            mine = label[js + shift]
            old, first = np.unique(mine, return_index=True)
            low = min(int(old[0]), int(label[i]))
            if len(old) == 1 and old[0] == label[i]:
                continue
            links += [(pa[i], pb[js[f]]) for u, f in zip(old, first) if u != label[i]]
            label[np.isin(label, np.append(old, label[i]))] = low
    return na, nb, links


def _shown_codes(shown: pd.Series, cells: int) -> np.ndarray:
    """row * cells + cell for each cell below ``cells`` that a row is shown to."""
    sizes = [len(x) for x in shown]
    flat = np.concatenate([np.asarray(x, np.int64) for x in shown]) if len(shown) else np.empty(0, np.int64)
    rows = np.repeat(np.arange(len(shown)), sizes)
    keep = flat < cells
    return rows[keep] * cells + flat[keep]


def _groups(ia: np.ndarray, ib: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The rows of ``ia``, which is sorted, each with its partners."""
    if not len(ia):
        return [], []
    cuts = np.flatnonzero(np.diff(ia)) + 1
    return ia[np.concatenate(([0], cuts))].tolist(), np.split(ib, cuts)


def _links(scratch: Scratch, points: DataFrame, d: int, n: int, kind: str, cosine: float, slack: float, cell_rows: int) -> DataFrame:
    """``(p, n, q)`` of ``n`` distinct vectors of one length: weights linked to p (q is p), or a link of p and q (n is 0)."""
    spark = points.sparkSession
    k = min(max(1, -(-n // cell_rows)), max(1, SAMPLE_ROWS // SAMPLE_PER_CELL))
    want = min(SAMPLE_ROWS, max(2048, SAMPLE_PER_CELL * k))
    picked = F.pmod(F.xxhash64("p", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, want / n))
    sample = points.where(picked).select("p", "v").toPandas()
    if sample.empty:
        sample = points.select("p", "v").limit(1).toPandas()
    sample = sample.sort_values("p")
    model = spherical_kmeans(normed(_rows(sample["v"])), k)
    centres = spark.sparkContext.broadcast((model, bins_of(model, max(1, BLOCK // cell_rows))))

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, bins = centres.value
        for batch in batches:
            if len(batch):
                home, shown = cells_of(normed(_rows(batch["v"])), model, cosine, slack)
                yield pd.DataFrame(
                    {
                        "p": batch["p"], "w": batch["w"], "v": batch["v"], "home": bins[home].astype(np.int32),
                        "shown": [np.unique(bins[c]).astype(np.int32) for c in shown],
                    }
                )

    shown = scratch.keep(points.mapInPandas(show, f"p binary, w long, v array<{kind}>, home int, shown array<int>"), "vec-shown")
    seats = shown.select("p", "w", "v", "home", "shown", F.explode("shown").alias("cell"))
    # blocks of a bin by hash; visitors outnumber those at home, so a block may hold several times a bin's rows
    block = max(1, min(VISITORS * BLOCK, BLOCK_BYTES // (8 * d)))
    sizes = seats.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    cells = {r["cell"]: r["blocks"] for r in sizes.collect()}  # one number a bin
    blocks_of = F.get(F.lit([cells.get(c, 0) for c in range(len(model))]), F.col("cell"))
    seats = seats.withColumn("blocks", blocks_of).withColumn("block", F.pmod(F.xxhash64("p", F.lit(2)), F.col("blocks")).cast("int"))
    # a row goes to the pairs of blocks that its block is part of
    tasks = seats.select(
        "cell", "block", "p", "w", "v", "home", "shown",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select(
        "cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "p", "w", "v", "home", "shown"
    )

    def product(key: tuple[int, ...], group: pd.DataFrame) -> pd.DataFrame:
        cell, lo, hi = (int(x) for x in key)
        a = group[group["block"] == lo].reset_index(drop=True)
        b = a if lo == hi else group[group["block"] == hi].reset_index(drop=True)
        out = []
        if len(a) and len(b):
            na, nb, links = compare(a, b, cell, cosine)
            out = [(p, n, p) for p, n in zip(a["p"], na.tolist()) if n] + [(p, n, p) for p, n in zip(b["p"], nb.tolist()) if n]
            out += [(p, 0, q) for p, q in links]
        return pd.DataFrame(out, columns=["p", "n", "q"]).astype({"n": "int64"})

    return scratch.keep(tasks.groupBy("cell", "lo", "hi").applyInPandas(product, "p binary, n long, q binary"), "vec-found")


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    slack: float = SLACK,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``."""
    scratch = Scratch(vectors.sparkSession)
    # components travel as they are; lengths and products are taken in double precision
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    raw = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast(f"array<{kind}>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    raw = raw.withColumn("ok", F.coalesce(finite, F.lit(False)))
    # 0.0 + x turns -0.0 into 0.0, so that equal vectors have equal bytes
    keyed = raw.withColumn("key", F.when(F.col("ok"), F.unhex(F.md5(F.to_json(F.transform("v", lambda x: x.cast("double") + F.lit(0.0))).cast("binary")))))
    rows = scratch.keep(keyed.select("vec_id", "key"), "vec-rows")
    points = keyed.where("ok").groupBy("key").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    points = scratch.keep(points.withColumn("p", F.col("key")), "vec-points")
    sizes = points.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()
    if not sizes:
        return raw.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = None
    for d, n in sizes:
        of_length = points if len(sizes) == 1 else points.where(F.size("v") == d)
        part = _links(scratch, of_length.select("p", "w", "v"), d, n, kind, cosine, slack, cell_rows)
        found = part if found is None else found.union(part)
    comps = connected_components(found.where("p <> q"), "p", "q")
    linked = found.where("n > 0").groupBy("p").agg(F.sum("n").alias("n"))
    full = (
        points.select("key", "p", "w", "least")
        .join(linked, "p", "left")
        .join(comps.withColumnRenamed("node", "p"), "p", "left")
        .select("key", "least", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "p").alias("component"))
    )
    full = scratch.keep(full, "vec-full")
    least = scratch.keep(full.groupBy("component").agg(F.min("least").alias("component_id")), "vec-least")
    named = scratch.keep(full.join(least, "component").select("key", "n_links", "component_id"), "vec-named")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("key is not null").join(named, "key").select("vec_id", "n_links", "component_id").union(alone)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
