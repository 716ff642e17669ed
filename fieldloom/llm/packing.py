"""Best-fit packing of tokenised documents by bin completion.

A document is its token ids and an end id.  Documents longer than a sequence
are cut into full pieces and a last, shorter one; nothing else is cut.  How
many pieces have each length is all that packing needs: at most ``capacity``
counts, however many documents there are.  Bin completion works on those
counts on the driver: around the largest piece left it enumerates the
undominated fillings of the rest of a sequence, branches over the least
wasteful ones, and prunes where waste exceeds what an improvement allows; the
best-fit-decreasing packing is the first incumbent.  A filling is used as
often as the counts allow.  The plan is a short list of runs (length, ranks ->
sequence, offset), each filling uses up a length but for a remainder, so its
size is bounded by the capacity too; it is what executors get.  Pieces get a
rank within their length by counts per salted bucket, so that one very common
length is spread over many tasks.

Defined results: a null or empty text is the end id alone; each row of a
repeated id is packed; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name

CAPACITY = 4096
END_ID = 1
#: Pieces for which a length has one more salted bucket.
BUCKET_ROWS = 20_000
#: Runs of letters whose ids a worker remembers, and other runs; only speed depends on them.
WORDS, CACHE = 1_200_000, 300_000
#: Fillings listed for a sequence and nodes visited for them, branches tried, and steps of the search
#: beside those that go deeper than any before.
FILLINGS, NODES, BRANCHES, STEPS = 50, 1000, 3, 2000


#: Characters of texts that are parted, and whose runs are looked up, together; runs encoded in one call.
TOGETHER, CALL = 1 << 21, 1000

#: Kinds of characters; those that this Unicode version doesn't know, or beyond ``POINTS``, are left to the tokenizer.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
POINTS = 0x40000
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: What the vocabulary writes at the end of a word.
WORD_END = "</w>"


@cache
def kinds() -> np.ndarray:
    """The kind of every code point; the last is an odd one, so that clipping finds it for those beyond."""
    majors = {"L": LETTER, "N": DIGIT}
    names = map(unicodedata.category, map(chr, range(POINTS)))
    out = np.fromiter((ODD if c == "Cn" or c == "Cs" else majors.get(c[0], OTHER) for c in names), np.uint8, POINTS)
    out[list(map(ord, WHITE))] = SPACE
    return out


def _starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a run begins at a character: letters, a digit, others, or ``'s 't 'm 'd 're 've 'll`` not behind others."""
    first = np.empty(len(kind), bool)
    first[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == DIGIT
    at = np.flatnonzero(points == ord("'"))
    at = at[(at == 0) | (kind[at - 1] != OTHER)]
    one, two = points.take(at + 1, mode="clip"), points.take(at + 2, mode="clip")
    r, v, e, l = map(ord, "rvel")  # noqa: E741
    long = ((one == r) | (one == v)) & (two == e) | (one == l) & (two == l)
    short = np.isin(one, list(map(ord, "stmd")))
    first[at[long | short] + 1] = False
    first[at[short] + 2] = True
    first[at[long] + 3] = True
    return first & (kind != SPACE)


def _stretches(text: str) -> Iterator[str]:
    """A long text cut before spaces, where there are any."""
    at = 0
    while len(text) - at > TOGETHER:
        stop = text.rfind(" ", at + 1, at + TOGETHER)
        if stop < 0 and (stop := text.find(" ", at + TOGETHER)) < 0:
            break
        yield text[at:stop]
        at = stop
    yield text[at:]


class Ids(dict):
    """Run of characters -> its ids as little-endian unsigned 32-bit bytes; ``words`` has those of letters.

    The tokenizer parts a normalised text into runs, whose ids do not depend on
    what stands beside them.  Here texts are parted by their characters' kinds,
    many together, and the tokenizer gets each distinct run once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.normalize = tokenizer.encode, tokenizer.normalizer.normalize_str
        #: whether a token ends a word, by id
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith(WORD_END)]] = True
        #: found in texts as they are, before anything else
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}

    def direct(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def normal(self, text: str) -> str:
        """The text as it is parted: composed and in lower case, a sigma that ends a word like any other.

        Which marks can be put in order differs by Unicode version, so the tokenizer composes.
        """
        if text.isascii():
            return text.lower()
        return text.replace("Σ", "σ").lower() if unicodedata.is_normalized("NFC", text) else self.normalize(text)

    def learn(self, runs: list[str], into: dict[str, bytes]) -> None:
        """Encode runs many at a time; a run's last token tells where it ends."""
        for at in range(0, len(runs), CALL):
            part = runs[at : at + CALL]
            ids = np.array(self.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data = ids.tobytes()
            if len(cuts) != len(part):
                into.update((x, self.direct(x)) for x in part)
                continue
            into.update(zip(part, [data[i:j] for i, j in zip([0, *cuts], cuts)]))

    def known(self, runs: list[str]) -> list[bytes]:
        """Ids of distinct runs."""
        if len(self.words) > WORDS:
            self.words.clear()
        if len(self) > CACHE:
            self.clear()
        out = list(map(self.words.get, runs))
        rest = [k for k, x in enumerate(out) if x is None]
        new = [x for k in rest if (x := runs[k]) not in self]
        self.learn([x for x in new if x.isalpha()], self.words)
        self.learn([x for x in new if not x.isalpha()], self)
        for k in rest:
            out[k] = self.words.get(runs[k]) or self[runs[k]]
        return out

    def together(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, whose runs are looked up together."""
        odd = {k for k, t in enumerate(texts) if any(x in t for x in self.added)}
        plain = ["" if k in odd else self.normal(t) for k, t in enumerate(texts)]
        # lower case may be not composed, and the tokenizer would compose a run anew
        odd.update(k for k, t in enumerate(plain) if not (t.isascii() or unicodedata.is_normalized("NFC", t)))
        ends = np.cumsum([len(t) + 1 for t in plain])
        joined = "\n".join([*plain, ""])
        points = np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = kinds().take(points, mode="clip")
        odd.update(np.searchsorted(ends, np.flatnonzero(kind == ODD), side="right").tolist())
        first, inner = _starts(points, kind), kind != SPACE
        points, cuts = points[inner], np.flatnonzero(first[inner])
        if points.dtype == np.uint8:
            data, offsets = points.tobytes(), np.append(cuts, len(points))
        else:
            data = points.tobytes().decode("utf-32-le").encode()
            width = np.uint8(1) + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            offsets = np.append(0, np.cumsum(width, dtype=np.int64))[np.append(cuts, len(points))]
        runs = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        ids = self.known(runs.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        which = runs.indices.to_numpy()
        sizes = size[which]
        till = np.append(0, np.cumsum(sizes))
        tokens = np.frombuffer(b"".join(ids), "<u4")[np.repeat((np.cumsum(size) - size)[which] - till[:-1], sizes) + np.arange(till[-1])]
        bounds = [0, *till[np.searchsorted(np.flatnonzero(first), ends)].tolist()]
        for k, t in enumerate(texts):
            yield self.direct(t) if k in odd else tokens[bounds[k] : bounds[k + 1]].tobytes()

    def of_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text; a long one alone, in stretches."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= TOGETHER):
                size += len(texts[stop] or "")
                stop += 1
            if size > TOGETHER:
                yield b"".join(x for part in _stretches(texts[at]) for x in self.together([part]))
            else:
                yield from self.together([t or "" for t in texts[at:stop]])
            at = stop

    def of(self, text: str | None) -> bytes:
        return next(self.of_all([text]))


_ids: dict[str, Ids] = {}


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of every row of ``docs``."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _ids.get(tokenizer) or _ids.setdefault(tokenizer, Ids(tokenizer))
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch["doc_id"].tolist(), ids.of_all(batch["text"].tolist())):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
            yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInPandas(run, schema)


@dataclass(frozen=True)
class Filling:
    """What one sequence holds: (length, how many) from the largest; and how many sequences are like it."""

    parts: tuple[tuple[int, int], ...]
    times: int


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences: total length, and pieces no two of which share one."""
    lengths = np.arange(len(counts))
    return max(-(-int(counts @ lengths) // capacity), int(counts[capacity // 2 + 1 :].sum()))


def _times(counts: np.ndarray, parts: tuple[tuple[int, int], ...]) -> int:
    return min(int(counts[n]) // k for n, k in parts)


def _take(counts: np.ndarray, f: Filling, sign: int = -1) -> None:
    for n, k in f.parts:
        counts[n] += sign * k * f.times


def _greedy(counts: np.ndarray, first: int, room: int) -> tuple[tuple[int, int], ...]:
    """Best fit: the largest that fits, again and again."""
    left = {first: 1}
    parts = [(first, 1)]
    top = room
    while top > 0:
        at = np.flatnonzero(counts[1 : top + 1])
        if not len(at):
            break
        n = int(at[-1]) + 1
        have = int(counts[n]) - left.get(n, 0)
        k = min(have, room // n)
        if k > 0:
            parts.append((n, k))
            room -= n * k
        top = min(n - 1, room)
    return _merged(parts)


def _merged(parts) -> tuple[tuple[int, int], ...]:
    out: dict[int, int] = {}
    for n, k in parts:
        out[n] = out.get(n, 0) + k
    return tuple(sorted(out.items(), reverse=True))


def best_fit(counts: np.ndarray, capacity: int) -> list[Filling]:
    """Best-fit decreasing on counts; the first incumbent."""
    counts, out = counts.copy(), []
    while (left := np.flatnonzero(counts)).size:
        first = int(left[-1])
        parts = _greedy(counts, first, capacity - first)
        f = Filling(parts, _times(counts, parts))
        _take(counts, f)
        out.append(f)
    return out


def _exact(have: np.ndarray, room: int) -> list[list[tuple[int, int]]]:
    """One or two parts that fill ``room``, the largest first."""
    out = [[]] if room == 0 else [[(room, 1)]] if have[room] > 0 else []
    larger = np.arange((room + 1) // 2, room)
    fits = larger[(have[larger] > 0) & (have[room - larger] > (2 * larger == room))]
    return out + [[(int(n), 1), (room - int(n), 1)] for n in fits[: -BRANCHES - 1 : -1]]


def fillings(counts: np.ndarray, first: int, capacity: int, most_waste: int) -> list[tuple[int, tuple]]:
    """Undominated fillings around ``first`` as (waste, parts), least waste first.

    A filling is dominated if something left fits beside it, or fits instead
    of one of its parts and is larger; only others are listed, at most
    ``FILLINGS`` of them, found from the largest parts downwards.  Where
    ``BRANCHES`` of one or two parts leave nothing, these are all.
    """
    have = counts.copy()
    have[first] -= 1
    if len(exact := _exact(have, capacity - first)) >= BRANCHES:
        return [(0, _merged([(first, 1), *parts])) for parts in exact[:BRANCHES]]
    sizes = (np.flatnonzero(have[1 : capacity - first + 1]) + 1)[::-1].tolist()
    falling = [-n for n in sizes]
    left = have.tolist()
    present = [n for n, k in enumerate(left) if k > 0 and n]
    out: list[tuple[int, tuple]] = []
    seen = 0

    def dominated(parts: list[tuple[int, int]], room: int) -> bool:
        used = dict(parts)

        def free(above: int, most: int) -> bool:
            """Whether a length over ``above`` up to ``most`` is left."""
            for at in range(bisect_right(present, above), bisect_right(present, most)):
                if left[n := present[at]] > used.get(n, 0):
                    return True
            return False

        return free(0, room) or any(free(n, n + room) for n, _ in parts)

    def walk(i: int, room: int, parts: list[tuple[int, int]]) -> bool:
        """Fillings that add parts from ``sizes[i:]``, largest first; true when enough are found."""
        nonlocal seen
        i = max(i, bisect_left(falling, -room))
        if room == 0 or i == len(sizes):
            if room <= most_waste and not dominated(parts, room):
                out.append((room, _merged([(first, 1), *parts])))
            return len(out) >= FILLINGS or room == 0 and len(out) >= BRANCHES
        for j in range(i, len(sizes)):
            n = sizes[j]
            for k in range(min(int(have[n]), room // n), 0, -1):
                seen += 1
                if seen > NODES or walk(j + 1, room - n * k, [*parts, (n, k)]):
                    return True
        return False

    walk(0, capacity - first, [])
    return sorted(out, key=lambda x: (x[0], [-n for n, _ in x[1]]))


def complete(counts: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> list[Filling]:
    """Bin completion on counts by length (index 0 unused); the best packing found within ``steps``.

    A step to a depth not reached before is free, so that a descent is not cut
    by how many different fillings it takes; only going back and trying others
    counts.
    """
    best = best_fit(counts, capacity)
    size = sum(f.times for f in best)
    bound = lower_bound(counts, capacity)
    total = int(counts @ np.arange(len(counts)))
    state = counts.copy()
    chosen: list[Filling] = []
    # depth first; an entry is a list of fillings still to try at that depth
    used = waste = spent = deepest = 0

    def options() -> list[tuple[int, tuple]]:
        first = int(np.flatnonzero(state)[-1])
        allowed = (size - 1) * capacity - total - waste
        got = fillings(state, first, capacity, max(0, allowed)) if allowed >= 0 else []
        greedy = _greedy(state, first, capacity - first)
        w = capacity - sum(n * k for n, k in greedy)
        if allowed >= 0 and all(p != greedy for _, p in got[:BRANCHES]):
            got = [*got[: BRANCHES - 1], (w, greedy)]
        return sorted(got[:BRANCHES], key=lambda x: x[0], reverse=True)

    stack = [options()] if size > bound else []
    while stack and spent < steps and size > bound:
        if not stack[-1]:
            spent += 1
            stack.pop()
            if chosen:
                f = chosen.pop()
                _take(state, f, 1)
                used -= f.times
                waste -= f.times * (capacity - sum(n * k for n, k in f.parts))
            continue
        w, parts = stack[-1].pop()
        f = Filling(parts, _times(state, parts))
        if w and (allowed := (size - 1) * capacity - total - waste) < w * f.times:
            f = Filling(parts, allowed // w)  # as often as the waste allows
            if f.times < 1:
                spent += 1
                continue
        _take(state, f)
        chosen.append(f)
        if len(chosen) > deepest:
            deepest = len(chosen)
        else:
            spent += 1
        used, waste = used + f.times, waste + f.times * w
        if not state.any():
            if used < size:
                best, size = list(chosen), used
            stack.append([])
        else:
            stack.append(options())
    return best


def plan(packed: list[Filling]) -> pd.DataFrame:
    """Runs (length, rank, each, sequence, offset): piece ``rank + i`` of a length stands in
    sequence ``sequence + i // each`` at ``offset + length * (i % each)``."""
    rows, ranks, sequence = [], {}, 0
    for f in packed:
        offset = 0
        for n, k in f.parts:
            rows.append((n, ranks.get(n, 0), k, sequence, offset))
            ranks[n] = ranks.get(n, 0) + k * f.times
            offset += n * k
        sequence += f.times
    out = pd.DataFrame(rows, columns=["length", "rank", "each", "sequence", "offset"], dtype=np.int64)
    return out.sort_values(["length", "rank"], ignore_index=True)


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces, which is read several times."""
    scratch = Scratch(found.sparkSession)
    got = found.groupBy("length").agg(F.count("*").alias("n")).toPandas()
    if got.empty:
        return found.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    counts = np.zeros(capacity + 1, np.int64)
    counts[got["length"].to_numpy()] = got["n"].to_numpy()
    runs = found.sparkSession.sparkContext.broadcast(plan(complete(counts, capacity)))

    buckets = 64 + int(counts.sum()) // BUCKET_ROWS
    bucket, below, row, rank, seat_of = (free_name(found, f"__{x}") for x in ("bucket", "floor", "row", "rank", "seat"))
    # what tells pieces apart, null ids too; pieces equal in all of it are alike
    by = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in found.columns]
    salted = found.withColumn(bucket, F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    sums = salted.groupBy("length", bucket).agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    floor = scratch.keep(
        sums.select("length", bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(below)), "packing-floor"
    )
    here = Window.partitionBy("length", bucket).orderBy(*by)
    ranked = salted.withColumn(row, F.row_number().over(here) - 1).join(floor, ["length", bucket])
    ranked = ranked.withColumn(rank, F.col(below) + F.col(row))

    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = runs.value
        keys = t["length"].to_numpy() * (1 << 44) + t["rank"].to_numpy()
        at = np.searchsorted(keys, length.to_numpy() * (1 << 44) + rank.to_numpy(), side="right") - 1
        i = rank.to_numpy() - t["rank"].to_numpy()[at]
        each = t["each"].to_numpy()[at]
        return pd.DataFrame(
            {
                "sequence_id": t["sequence"].to_numpy()[at] + i // each,
                "offset": t["offset"].to_numpy()[at] + length.to_numpy() * (i % each),
            }
        )

    seated = ranked.withColumn(seat_of, F.pandas_udf(seat, "sequence_id long, offset long")("length", rank))
    return seated.select(*found.columns, f"{seat_of}.sequence_id", f"{seat_of}.offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, **columns: str) -> DataFrame:
    """One row a piece: where it stands in which sequence; with its ids if asked."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(pieces(docs, tokenizer, capacity=capacity, with_ids=with_ids, **columns), "packing-pieces")
    return place(found, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` from pieces packed with ids; a sequence holds a capacity of ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
