"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its 5-word shingles (words: runs of non-space
characters, lower-cased; a shorter text is one shingle).  Shingles are
labelled with their occurrence number.  Each of ``TABLES`` sketches takes the
``SAMPLE`` labelled shingles with the smallest hashes and keeps their order in
the text, so texts share a sketch by edit similarity rather than by mere
content.  Texts that share one are candidates.

Similarity is that of an alignment: with m shingles aligned in order, inside
the band that the threshold implies, it is m / (na + nb - m).  One minus it is
a metric, which is used to leave out comparisons that can't succeed.  Classes
are the connected components of pairs with similarity 0.8 or more.

A bucket of texts is never expanded into all pairs.  Exact copies are one node
from the start.  In each round a bucket's pivots are compared with the members
that are not of their component and then leave the bucket, as do members that
the distances rule out; a bucket with one component left is done and is not
carried further.  The first
pivot is the member that shares most buckets with others, which in a group of
near copies is about the text they stem from; in the second round those
outside meet a few members of its component, which in a group whose
members are about as far apart as a link reaches joins nearly all.  Texts left
in open buckets then meet by their rarest shingles, of which any two partners
share one: in a large group of texts well below the threshold most of those
are a text's own, so that such texts are not compared pair by pair.  There the
pivots are members outside a bucket's main component, many times more with
each round, so the rounds are logarithmically many, and no pair is skipped
that could link two components.

Defined results: a null text is a class of its own, equal texts are one class
(empty ones too), rows of one id and text are repeated rows of one document; a
null id takes the class of its text, null if no copy has an id; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, free_name

WORDS = 5
SIMILARITY = 0.8
#: A pair at exactly ``SIMILARITY`` shares no sketch with chance (1 - 0.8 ** 4) ** 24, 3 in a million.
TABLES = 24
SAMPLE = 4
#: Members of a bucket's main component that those outside meet before any of them meets all.
MAIN_SHARES = 8
#: Pivots of a bucket in the first round of rare shingles, and how many times more in each further one.
SHARES = 64
#: Counters for how common shingles are among the texts that the first round leaves open.
COUNTERS = 1 << 20
#: Links that one task joins to trees before the rounds of exchanges.
TASK_LINKS = 200_000
#: Words whose hashes a worker remembers; only speed depends on it.
CACHE = 300_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240601)
_XOR = _rng.integers(0, 2**63, TABLES, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, TABLES, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = _WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """64-bit hashes of the shingles of a text, in order."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * _ODD + _mix(w[i : len(w) - k + 1 + i])
    return _mix(h + np.uint64(k))


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingle hashes made distinct by their occurrence number."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    if new.all():
        return h
    start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    occ = np.empty(len(s), np.uint64)
    occ[order] = (np.arange(len(s)) - start).astype(np.uint64)
    return np.where(occ == 0, h, _mix(h + occ * _ODD))


def sketch(h: np.ndarray) -> np.ndarray:
    """A bucket key per table for the shingles of a text; none for a text without words."""
    if len(h) == 0:
        return np.empty(0, np.int64)
    x = labelled(h)
    picked = np.empty((min(SAMPLE, len(x)), TABLES), np.uint64)
    for t in range(TABLES):
        if len(x) > SAMPLE:
            y = (x ^ _XOR[t]) * _MUL[t]
            y ^= y >> np.uint64(32)
            picked[:, t] = x[np.sort(np.argpartition(y, SAMPLE - 1)[:SAMPLE])]
        else:
            picked[:, t] = x
    keys = np.arange(1, TABLES + 1, dtype=np.uint64)
    for row in picked:
        keys = _mix((keys ^ row) * _ODD)
    return keys.view(np.int64)


def _counter(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(44)).astype(np.int64)


def rare_shingles(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The rarest labelled shingles in order, one more than a partner can lack.

    A text of n shingles shares at least 0.8 n of them with a partner, so in
    any order of all shingles their first n - 0.8 n + 1 have one in common.
    """
    x = labelled(h) if len(h) else h
    if len(x) == 0:
        return np.empty(0, np.int64)
    keep = len(x) - int(np.ceil(SIMILARITY * len(x) - 1e-9)) + 1
    return x[np.lexsort((x, common[_counter(x)]))[:keep]].view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> int:
    """Most shingles that an alignment inside the band matches; 0 if ``least`` can't be reached.

    A similarity of ``least`` leaves at most D unmatched shingles on both
    sides, so its alignment stays within D of the diagonal.  The rows of the
    alignment are bit vectors.
    """
    need = least / (1 + least) * (len(a) + len(b))
    if min(len(a), len(b)) < need - 1e-9:
        return 0
    k = min(len(a), len(b))
    diff = np.flatnonzero(a[:k] != b[:k])
    head = int(diff[0]) if len(diff) else k
    a, b = a[head:], b[head:]
    k = min(len(a), len(b))
    diff = np.flatnonzero(a[len(a) - k :][::-1] != b[len(b) - k :][::-1])
    tail = int(diff[0]) if len(diff) else k
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    m = len(a)
    if m == 0 or len(b) == 0:
        return head + tail
    band = int((len(a) + len(b) + 2 * (head + tail)) - 2 * need + 1e-9) + 1
    at: dict[int, int] = {}
    for i, v in enumerate(a.tolist()):
        at[v] = at.get(v, 0) | (1 << i)
    full, window = (1 << m) - 1, (1 << (2 * band + 1)) - 1
    v = full
    for j, c in enumerate(b.tolist()):
        if hits := at.get(c):
            u = v & hits & (window << (j - band) if j >= band else window >> (band - j))
            if u:
                v = ((v + u) | (v - u)) & full
    return head + tail + m - v.bit_count()


#: Distances from here on are given as 1: no text within less than 0.2 of one is within 0.2 of the other.
FAR = 2 * (1 - SIMILARITY)


def distance(a: np.ndarray, b: np.ndarray, xa: np.ndarray | None = None) -> float:
    """1 - similarity of two shingle sequences, 1.0 for any of ``FAR`` or more."""
    least, total = 1 - FAR, len(a) + len(b)
    if total == 0 or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 1.0
    # an alignment matches no more than the common labelled shingles
    common = len(np.intersect1d(labelled(a) if xa is None else xa, labelled(b), assume_unique=True))
    if common < least * (total - common):
        return 1.0
    m = aligned(a, b, least)
    d = 1 - m / (total - m)
    return d if d < FAR else 1.0


def _sketch_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [shingles(t) for t in batch["text"]]
        yield pd.DataFrame({"node": batch["node"], "n": [len(h) for h in found], "keys": [sketch(h) for h in found]})


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for t in batch["text"]:
            if len(h := shingles(t)):
                np.add.at(sums, _counter(labelled(h)), 1)
    at = np.flatnonzero(sums)
    yield pd.DataFrame({"counter": at, "n": sums[at]})


def _verify_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, a, xa = None, None, None
    for batch in batches:
        out = []
        for p, q in zip(batch["text_a"], batch["text_b"]):
            if p != last:
                a = shingles(p)
                last, xa = p, labelled(a)
            out.append(distance(a, shingles(q), xa))
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "dist": out})


def _trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a task as links of nodes to the smallest one they reach with them."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"]):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    found = [(x, top) for x in list(root) if (top := find(x)) != x]
    yield pd.DataFrame(found, columns=["a", "b"])


def _components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Components of links ``(a, b)``; tasks of a bounded number of links spare most rounds of exchanges."""
    tasks = links.count() // TASK_LINKS + 1
    trees = scratch.keep(links.coalesce(tasks).mapInPandas(_trees, "a binary, b binary"), "omh-trees")
    out = connected_components(trees)
    scratch.drop(trees)
    return out


def _with_component(rows: DataFrame, comps: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the component of ``node``, which is the node itself where no link touches it."""
    c = comps.select(F.col("node").alias(node), F.col("component").alias(name))
    return rows.join(c, node, "left").withColumn(name, F.coalesce(name, node))


def _judge(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b, dist)`` of pairs of nodes.

    The side with very many partners is split by adaptive execution: both
    sides of either join are plain tables or rows of one.
    """
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(_verify_batches, "a binary, b binary, dist double")


def _ruled_out(
    scratch: Scratch, state: DataFrame, pivots: DataFrame, judged: DataFrame, comps: DataFrame | None, rest: bool = False
) -> DataFrame:
    """Members ``(bucket, node)`` of the pivot's component that can't link to one outside it.

    With x at distance d from the pivot and every y outside at more than
    d + 0.2, x and y are further apart than a link.  A member that ``ENOUGH``
    kept from being judged is as far away at least as its length tells, and one
    judged as far may be at ``FAR`` itself.  With ``comps``, members that other
    links join to the pivot's component count as inside.

    With ``rest``, the other members instead, of buckets with more than one
    component only, and without the pivots; with their component and with
    ``main``, that of the bucket's heaviest member but the pivot.
    """
    pairs = judged.select("a", "b", "dist").union(judged.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))
    met = state.join(pivots.select("bucket", "pivot", "pivot_n"), "bucket").where("node <> pivot")
    met = met.join(pairs.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "dist"), ["pivot", "node"], "left")
    by_length = 1 - F.least("n", "pivot_n") / F.greatest("n", "pivot_n")
    near = 1 - SIMILARITY + 1e-9
    apart = F.expr(f"dist is null or dist > {near}")
    if comps is not None:
        met = _with_component(_with_component(met, comps, "node", "comp"), comps, "pivot", "pivot_comp")
        apart = F.col("comp") != F.col("pivot_comp")
    more = ["n", "rank", "weight", "comp"] if rest else []
    met = met.select("bucket", "node", *more, "dist", F.coalesce("dist", by_length).alias("least"), apart.alias("apart"))
    met = scratch.keep(met, "omh-met")
    miss = F.min(F.when(F.col("apart"), F.col("least"))).alias("miss")
    out = f"dist <= {near} and dist + {near} < least(coalesce(miss, 1.0), {FAR})"
    if rest:
        found = met.groupBy("bucket").agg(miss, *map(F.expr, OPEN)).where("lo <> hi")
        found = scratch.keep(found.select("bucket", "miss", "main"), "omh-open")
        return met.join(found, "bucket").where(f"not coalesce({out}, false)").select("bucket", "node", *more, "main")
    missed = scratch.keep(met.groupBy("bucket").agg(miss), "omh-miss")
    return met.join(missed, "bucket").where(out).select("bucket", "node")


SKETCH = "node binary, n int, keys array<long>"
#: Partners have a first common shingle, in the order of their ranks, and at least this many from there on.
ENOUGH = f"least(n - rank, pivot_n - pivot_rank) >= {SIMILARITY / (1 + SIMILARITY)} * (n + pivot_n) - 1e-6"


def _members(scratch: Scratch, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(bucket, node, n, rank, weight)`` of buckets with more than one node, and these nodes; exact copies count once.

    weight is the number of members in all buckets of a node: the largest in a
    group of near copies is that of the text which most of them stem from.
    """
    members = scratch.keep(sketches.groupBy("bucket", "node").agg(F.min("n").alias("n"), F.min("rank").alias("rank")), "omh-members")
    crowded = scratch.keep(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "omh-crowded")
    shared = scratch.keep(members.join(crowded, "bucket"), "omh-shared")
    weights = scratch.keep(shared.groupBy("node").agg(F.sum("size").alias("weight")), "omh-weights")
    out = scratch.keep(shared.drop("size").join(weights, "node"), "omh-state")
    scratch.drop(members, crowded, shared)
    return out, weights


def _refined(scratch: Scratch, state: DataFrame, texts: DataFrame) -> DataFrame:
    """Buckets by rare shingle of the nodes that share a bucket with one of another component.

    The counters are of a fixed number; they only choose the order in which
    shingles count as rare, any order loses no pair.
    """
    mixed = state.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    mixed = scratch.keep(mixed.select("bucket"), "omh-mixed")
    left = scratch.keep(state.join(mixed, "bucket", "left_semi").select("node").distinct(), "omh-left")
    open_texts = texts.join(left, "node", "left_semi")
    counts = open_texts.mapInPandas(_count_batches, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    common = np.zeros(COUNTERS, np.int64)
    common[counts["counter"].to_numpy()] = counts["n"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t) for t in batch["text"]]
            keys = [rare_shingles(h, shared.value) for h in found]
            yield pd.DataFrame({"node": batch["node"], "n": [len(h) for h in found], "keys": keys})

    fine = open_texts.mapInPandas(rare, SKETCH).select("node", "n", F.posexplode("keys").alias("rank", "bucket"))
    out, nodes = _members(scratch, fine)
    scratch.drop(mixed, left, state, nodes)
    return out


#: A bucket's pivot ``p``: the member at the heart of most buckets.
HEAVIEST = "max(struct(weight, node, n, rank)) as p"
PIVOT = ["p.node as pivot", "p.n as pivot_n", "p.rank as pivot_rank"]


def _first_pivots(current: DataFrame) -> DataFrame:
    """The heaviest member of each bucket."""
    return current.groupBy("bucket").agg(F.expr(HEAVIEST)).selectExpr("bucket", *PIVOT, "p.node as pivot_comp")


#: A bucket's components, and that of its heaviest member.
OPEN = ["max(struct(weight, node, comp)).comp as main", "min(comp) as lo", "max(comp) as hi"]


def _open(scratch: Scratch, current: DataFrame) -> DataFrame:
    """Members of the buckets with more than one component, with ``main`` and the number of members.

    A bucket of one component stays so and is not carried further.
    """
    found = current.groupBy("bucket").agg(*map(F.expr, OPEN), F.count("*").alias("size")).where("lo <> hi")
    found = scratch.keep(found.select("bucket", "main", "size"), "omh-open")
    out = scratch.keep(current.join(found, "bucket"), "omh-state")
    scratch.drop(found)
    return out


def _main_pivots(current: DataFrame, shares: int) -> DataFrame:
    """Of each open bucket's main component, up to ``shares`` heavy members.

    In a group of near copies that are about as far from each other as a link
    reaches, a member outside meets one of several members of the main
    component soon, so that few have to meet all of it.
    """
    share = F.pmod(F.xxhash64("node"), F.lit(shares)).alias("share")
    inside = current.where("comp = main").groupBy("bucket", "main", share).agg(F.expr(HEAVIEST))
    return inside.selectExpr("bucket", *PIVOT, "main as pivot_comp")


def _stray_pivots(current: DataFrame, shares: int) -> DataFrame:
    """Of each open bucket's members outside its main component, dealt into ``shares``, one a share.

    A bucket of no more members has them all, which ends it.
    """
    dealt = F.pmod(F.xxhash64("node"), F.lit(shares)).cast("string").cast("binary")
    share = F.when(F.col("size") > shares, dealt).otherwise(F.col("node")).alias("share")
    strays = current.where("comp <> main").groupBy("bucket", share)
    one = strays.agg(F.max(F.struct("weight", "node", "n", "rank", "comp")).alias("p"))
    return one.selectExpr("bucket", *PIVOT, "p.comp as pivot_comp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(node, class_id)``: a node is the MD5 of a text, class_id the smallest id of its class."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    rows = node_rows(docs, id_col, text_col)
    named = rows.where("node is not null")
    ids = scratch.keep(named.groupBy("node").agg(F.min("doc_id").alias("rep")), "omh-ids")

    sketches = named.select("node", "text").mapInPandas(_sketch_batches, SKETCH)
    state, nodes = _members(scratch, sketches.select("node", "n", F.lit(0).alias("rank"), F.explode("keys").alias("bucket")))

    # the texts of candidates, one row a node, by a key that no two rows share
    wanted = scratch.keep(nodes.join(ids, "node").select("node", "rep"), "omh-wanted")
    texts = scratch.keep(
        named.join(wanted.hint("merge"), (named["node"] == wanted["node"]) & named["doc_id"].eqNullSafe(wanted["rep"]))
        .select(named["node"], named["doc_id"], named["text"])
        .dropDuplicates(["node", "doc_id"])
        .select("node", "text"),
        "omh-texts",
    )
    scratch.drop(wanted, nodes)

    comps: DataFrame | None = None
    judged: DataFrame | None = None
    turn, shares = 0, SHARES
    while True:
        if turn > 1:
            was, state = state, _open(scratch, state)
            scratch.drop(was)
        if state.isEmpty():
            break
        if turn == 0:
            current = state.withColumn("comp", F.col("node"))
            pivots = _first_pivots(current)
        else:
            current = state
            pivots = _main_pivots(current, MAIN_SHARES) if turn == 1 else _stray_pivots(current, shares)
        pivots = scratch.keep(pivots, "omh-pivots")
        against = current.join(pivots, "bucket").where(f"node <> pivot and comp <> pivot_comp and {ENOUGH}")
        pairs = against.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        if judged is not None:
            pairs = pairs.join(judged, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, "omh-pairs")
        if judged is None or not pairs.isEmpty():
            new = scratch.keep(_judge(pairs, texts), "omh-judged")
            judged = new if judged is None else judged.union(new)
            links = new.where(f"dist <= {1 - SIMILARITY + 1e-9}").select("a", "b")
            if comps is None:
                comps = _components(scratch, links)
            elif not links.isEmpty():  # earlier components as links of their members to the smallest
                comps = _components(scratch, links.union(comps.where("node <> component").select("node", "component")))

        # a pivot has met every other component of its bucket and leaves it
        gone = pivots.select("bucket", F.col("pivot").alias("node"))
        if turn == 0:
            first = pivots
        if turn < 2:
            nxt = _ruled_out(scratch, state.drop("comp", "main"), first, judged, comps, rest=True)
        else:
            nxt = _with_component(state.drop("comp", "main", "size"), comps, "node", "comp")
        if turn:
            nxt = nxt.join(gone, ["bucket", "node"], "left_anti")
        nxt = scratch.keep(nxt, "omh-state")
        scratch.drop(state, pairs, *([pivots] if turn else []))
        if turn == 1:
            nxt = _with_component(_refined(scratch, nxt, texts), comps, "node", "comp")
        elif turn > 1:
            shares *= SHARES
        state, turn = nxt, turn + 1

    if comps is None:
        return ids.select("node", F.col("rep").alias("class_id"))
    full = scratch.keep(_with_component(ids, comps, "node", "component"), "omh-full")
    least = scratch.keep(full.groupBy("component").agg(F.min("rep").alias("class_id")), "omh-class")
    return full.join(least, "component").select("node", "class_id")


def node_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        docs[id_col].alias("doc_id"),
        F.unhex(F.md5(docs[text_col].cast("binary"))).alias("node"),
        docs[text_col].alias("text"),
    )


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class_id, kept)``, one row per row of ``docs``; kept: its id is its class's."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(near_duplicates(docs, id_col, text_col), "omh-classes")
    rows = node_rows(docs, id_col, text_col).select("doc_id", "node")
    out = rows.where("node is not null").join(found, "node").select("doc_id", "class_id")
    alone = rows.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return out.union(alone).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their class's; a repeated row of an id and text stays once."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(near_duplicates(docs, id_col, text_col), "omh-classes")
    node, best, least = (free_name(docs, x) for x in ("__node", "__best", "__class"))
    rows = docs.select("*", F.unhex(F.md5(docs[text_col].cast("binary"))).alias(node))
    found = found.select(F.col("node").alias(best), F.col("class_id").alias(least))
    kept = rows.where(F.col(node).isNotNull()).join(
        found, (F.col(node) == F.col(best)) & rows[id_col].eqNullSafe(F.col(least))
    )
    one = kept.dropDuplicates([node, id_col])
    return one.select(*docs.columns).union(docs.where(docs[text_col].isNull()))
