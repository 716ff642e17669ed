"""SentencePiece encoding and decoding over a lattice of pieces.

A text is prefixed by one space, spaces become ``▁``, and it is cut into words
(a run of ``▁`` and what follows it, or a line feed) that no piece spans.  For
each distinct word the lattice is relational: bounded-length substrings are
exploded, equi-joined to the piece table, and the edges grouped by word; a fold
with ``aggregate`` turns them into ids.  For unigram models the fold is Viterbi.
A BPE model's scores are ranks of merges, whose best path by sum is not what
such a model defines, so for these the fold replays the merges: as often as
needed, the edge with the best score (leftmost of equals) that joins two
neighbouring symbols is taken.  Where a word's pieces come out of merges that are
all better than they (tried for each piece of a model), no merge can make way for
a better one, and one pass over the edges from the best replays them.  Words are cut further where no
piece of the model has such a pair of characters.  Characters without a piece become byte pieces.

Defined results: a null or empty text has no ids; repeated rows are encoded
alike; a text or word of any length is encoded whole; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

SPACE = "▁"
#: Between words: before a run of spaces, and on both sides of a line feed.
CUT = f"(?<=[^{SPACE}])(?={SPACE})|(?<=\\n)|(?=\\n)"
#: The fold's work grows with the square of a word's length; longer words of a BPE
#: model are merged on a heap, which is exact too, so that a megabyte without a space ends.
FOLDED_CHARS = 64
#: Words whose lattice one task builds.
TASK_WORDS = 50_000
#: Odd pieces of an ordered model; words with one of them are folded merge by merge.
ODD = 16
#: Groups a task holds before Spark sorts all its rows instead; a task has about ``TASK_WORDS``.
HELD_GROUPS = 4 * TASK_WORDS
#: Code points of the texts that meet the ids of their words in one task.
CHUNK_CHARS = 16_000_000
#: Code points of texts that are parted, and looked up, at a time.
PARTED_CHARS, FOUND_CHARS = 250_000, 4_000_000
#: How hard texts, and words with their ids, are compressed on their way.
ZSTD_LEVEL = 6
#: Words whose ids a worker remembers; only speed depends on it.
CACHE = 300_000


#: Words of a text whose spaces are marked; what ``CUT`` parts.
WORD = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def parts(marks: str = "") -> re.Pattern:
    """Words cut where letters, digits and other characters meet, and between digits; ``marks`` are no letters."""
    marks = re.escape(marks)
    return re.compile(rf"\n|{SPACE}*[^\W\d_{marks}]+|{SPACE}*(?:[^\w{SPACE}\n]|[_{marks}])+|{SPACE}+|\d")


#: Kinds of characters; whether one of the second kind goes on with the word of the first.
LINE, MARK, LETTER, OTHER, DIGIT = range(5)
JOINED = np.zeros((8, 8), bool)
for _pair in ((MARK, MARK), (MARK, LETTER), (MARK, OTHER), (LETTER, LETTER), (OTHER, OTHER)):
    JOINED[_pair] = True


def kinds(marks: str | None = None) -> np.ndarray:
    """The kind of every code point by ``parts(marks)``; by ``WORD`` if there are no marks but None."""
    out = np.full(0x110000, LETTER if marks is None else OTHER, np.uint8)
    if marks is not None:
        every = "".join(map(chr, range(len(out))))
        for kind, one in ((DIGIT, r"\d+"), (LETTER, rf"[^\W\d_{re.escape(marks)}]+")):
            for run in re.finditer(one, every):
                out[run.start() : run.end()] = kind
        out[list(map(ord, marks))] = OTHER
    out[ord("\n")], out[ord(SPACE)] = LINE, MARK
    return out


@dataclass
class Model:
    """Pieces with ids and scores; ``first_byte`` is the id of the byte piece 0.

    ``word`` parts texts: by ``parts`` if it leaves together every two characters
    that stand side by side in a piece; ``kinds`` of characters say the same.  ``odd``
    pieces do not come out of merges that are all better than they; a model with few
    of them is ``ordered``.
    """

    pieces: list[tuple[str, int, float]]
    kind: str
    first_byte: int
    unknown: int = 0
    longest: int = field(init=False)
    odd: list[str] = field(init=False)
    ordered: bool = field(init=False)
    word: re.Pattern = field(init=False)
    kinds: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        self.longest = max(len(p) for p, _, _ in self.pieces)
        pairs = {p[i : i + 2] for p, _, _ in self.pieces for i in range(len(p) - 1)}
        self.word, self.kinds = WORD, kinds()
        marks = "".join({c for x in pairs if len(parts().findall(x)) > 1 for c in x if parts().fullmatch(c) and c.isalnum() and not c.isalpha()})
        if all(len(parts(marks).findall(x)) == 1 for x in pairs):
            self.word, self.kinds = parts(marks), kinds(marks)
        self.odd = _odd(self) if self.kind == "bpe" else []
        fits = len({p for p, _, _ in self.pieces}) == len(self.pieces) < 1 << 22 and all(0 <= i < 1 << 26 for _, i, _ in self.pieces)
        self.ordered = self.kind == "bpe" and fits and len(self.odd) <= ODD


def _odd(model: Model) -> list[str]:
    """Pieces that no merges make, or not only better ones than the last; without those that hold another."""
    table = {p: (s, i) for p, i, s in model.pieces}
    out: list[str] = []
    for p, i, s in sorted(model.pieces, key=lambda x: len(x[0])):
        scores: list[float] = []
        if len(p) > 1 and (merged(p, table, model.first_byte, scores) != [i] or min(scores[:-1], default=np.inf) <= s):
            if len(out) > ODD or not any(x in p for x in out):
                out.append(p)
    return out


def load(path: str) -> Model:
    """The pieces of a model file; its kind is taken from how it writes scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [
        (sp.id_to_piece(i), i, sp.get_score(i))
        for i in range(n)
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
    ]
    ranks = sum(float(s).is_integer() for _, _, s in pieces) > 0.99 * len(pieces)
    return Model(pieces, "bpe" if ranks else "unigram", sp.piece_to_id("<0x00>"), sp.unk_id())


def words_of(text: Column) -> Column:
    """Words of a text, in order; joined they are the text with its spaces marked."""
    marked = F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))
    return F.when(F.length(text) > 0, F.filter(F.split(marked, CUT), lambda w: w != "")).otherwise(F.array().cast("array<string>"))


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    place = {s: k for k, s in enumerate(sorted({s for _, _, s in model.pieces}, reverse=True))}
    rows = [(p, i, float(s), place[s]) for p, i, s in model.pieces]
    return spark.createDataFrame(rows, "piece string, id int, score double, rank long")


def lattice(words: DataFrame, model: Model, packed: bool = False) -> DataFrame:
    """``edges`` beside each row of distinct words: every (start, end, score, id) of a substring that is a piece.

    Packed, an edge is a number: rank by score, start, end and id from the highest bits.
    The piece table has as many rows as the vocabulary file, which bounds what
    is broadcast; the grouping keeps the words' partitioning.  Other columns are carried.
    """
    n, kept = F.length("word"), words.columns
    starts = words.select(*kept, F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    ends = starts.select(
        *kept, "start", F.explode(F.sequence(F.col("start") + 1, F.least(n, F.col("start") + model.longest))).alias("end")
    )
    spans = ends.select(*kept, "start", "end", F.expr("substring(word, start + 1, end - start)").alias("piece"))
    edges = spans.join(F.broadcast(piece_table(words.sparkSession, model)), "piece", "left")
    # of spans that are no piece only a word's first is kept, so that a word without pieces stays
    edges = edges.where((F.col("id").isNotNull()) | ((F.col("start") == 0) & (F.col("end") == 1)))
    edge = F.struct("start", "end", "score", "id")
    if packed:
        edge = F.expr("shiftleft(rank, 40) | shiftleft(cast(start as long), 33) | shiftleft(cast(end as long), 26) | id")
    edge = F.when(F.col("id").isNotNull(), edge)
    return edges.groupBy(*kept).agg(F.collect_list(edge).alias("edges"))


def _byte_ids(char: Column, model: Model) -> Column:
    hexed = F.hex(char.cast("binary"))
    at = F.sequence(F.lit(1), F.length(hexed), F.lit(2))
    return F.transform(at, lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("int") + F.lit(model.first_byte))


def _ids_between(word: Column, edges: Column, bounds: Column, model: Model) -> Column:
    """Ids of the symbols between neighbouring bounds; bytes where a symbol is no piece."""
    at = F.sequence(F.lit(0), F.size(bounds) - 2)

    def one(i: Column) -> Column:
        s, e = F.get(bounds, i), F.get(bounds, i + 1)
        found = F.get(F.filter(edges, lambda x: (x["start"] == s) & (x["end"] == e)), 0)["id"]
        return F.when(found.isNotNull(), F.array(found)).otherwise(_byte_ids(F.substring(word, s + 1, e - s), model))

    return F.flatten(F.transform(at, one))


def fold_merges(word: Column, edges: Column, model: Model) -> Column:
    """Ids by replaying merges over the lattice."""
    n = F.length(word)

    def step(bounds: Column, _: Column) -> Column:
        def joins(x: Column) -> Column:
            a = F.array_position(bounds, x["start"])
            return (a > 0) & (F.get(bounds, (a + 1).cast("int")) == x["end"])

        rated = F.transform(
            F.filter(edges, joins),
            lambda x: F.struct(x["score"].alias("score"), (-x["start"]).alias("left")),
        )
        best = F.array_max(rated)["left"]
        gone = F.get(bounds, F.array_position(bounds, -best).cast("int"))
        return F.when(best.isNull(), bounds).otherwise(F.array_remove(bounds, gone))

    bounds = F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), step)
    return F.get(F.transform(F.array(bounds), lambda b: _ids_between(word, edges, b, model)), 0)


def _start(edge: Column) -> Column:
    return F.shiftright(edge, 33).bitwiseAND(127).cast("int")


def _end(edge: Column) -> Column:
    return F.shiftright(edge, 26).bitwiseAND(127).cast("int")


def _shifted(number: Column, by: Column) -> Column:
    return F.call_function("shiftleft", number, by)


def fold_ranked(word: Column, edges: Column, model: Model) -> Column:
    """What ``fold_merges`` returns for words of up to 64 code points without odd pieces, from packed edges.

    A bit tells whether a symbol begins at a place; that of place 64 is bit 0, as shifts
    have it, which is always set.
    """
    n, one = F.length(word), F.lit(1).cast("long")

    def inner(e: Column) -> Column:
        return _shifted(_shifted(one, _end(e) - _start(e) - 1) - 1, _start(e) + 1)

    def bounded(bits: Column, e: Column) -> Column:
        ends = _shifted(one, _start(e)).bitwiseOR(_shifted(one, _end(e)))
        return bits.bitwiseAND(ends) == ends

    def step(bits: Column, e: Column) -> Column:
        joins = bounded(bits, e) & (F.bit_count(bits.bitwiseAND(inner(e))) == 1)
        return F.when(joins, bits.bitwiseAND(F.bitwise_not(inner(e)))).otherwise(bits)

    every = F.lit(-1).cast("long")
    bits = F.aggregate(
        F.sort_array(edges), F.when(n > 63, every).otherwise(F.call_function("shiftrightunsigned", every, 63 - n)), step
    )

    def ids(bits: Column) -> Column:
        symbols = F.filter(edges, lambda e: bounded(bits, e) & (bits.bitwiseAND(inner(e)) == 0))
        in_order = F.sort_array(F.transform(symbols, lambda e: e.bitwiseAND((1 << 40) - 1)))
        bounds = F.filter(F.sequence(F.lit(0), n), lambda i: bits.bitwiseAND(_shifted(one, i)) != 0)
        parts = F.transform(
            edges, lambda e: F.struct(_start(e).alias("start"), _end(e).alias("end"), e.bitwiseAND((1 << 26) - 1).cast("int").alias("id"))
        )
        return F.when(
            F.size(symbols) == F.bit_count(bits) - (n < 64).cast("int"),
            F.transform(in_order, lambda e: e.bitwiseAND((1 << 26) - 1).cast("int")),
        ).otherwise(_ids_between(word, parts, bounds, model))

    return F.get(F.transform(F.array(bits), ids), 0)


#: Score of a character that is no piece, below that of any path of pieces.
UNSEEN = -1e6


def fold_viterbi(word: Column, edges: Column, model: Model) -> Column:
    """Ids of the path with the largest sum of scores; of equals the one with the longest last piece."""
    n = F.length(word)
    cell = "struct<score:double,start:int>"

    def step(best: Column, end: Column) -> Column:
        here = F.filter(edges, lambda x: x["end"] == end)
        paths = F.transform(
            here,
            lambda x: F.struct(
                (F.get(best, x["start"])["score"] + x["score"]).alias("score"), (-x["start"]).alias("back")
            ),
        )
        unseen = F.struct((F.get(best, end - 1)["score"] + F.lit(UNSEEN)).alias("score"), (1 - end).alias("back"))
        top = F.array_max(F.concat(paths, F.array(unseen)))
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), (-top["back"]).alias("start")).cast(cell)))

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("start")).cast(cell))
    table = F.aggregate(F.sequence(F.lit(1), n), first, step)

    def back(t: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), n),
            F.array(n),
            lambda acc, _: F.when(F.get(acc, 0) > 0, F.concat(F.array(F.get(t, F.get(acc, 0))["start"]), acc)).otherwise(acc),
        )

    bounds = F.get(F.transform(F.array(table), back), 0)
    return F.get(F.transform(F.array(bounds), lambda b: _ids_between(word, edges, b, model)), 0)


class Words(dict):
    """Word -> ids, by merges over its lattice on a heap."""

    def __init__(self, model: Model):
        self.model, self.table = model, {p: (s, i) for p, i, s in model.pieces}

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids = merged(word, self.table, self.model.first_byte)
        return ids


def merged(word: str, table: dict[str, tuple[float, int]], first_byte: int, scores: list[float] | None = None) -> list[int]:
    """Ids of a word of a BPE model; ``scores`` gets those of the merges in turn."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, int]] = []
    find = table.get

    def offer(s: int) -> None:
        m = end[s]
        if m < n and (hit := find(word[s : end[m]])):
            heapq.heappush(heap, (-hit[0], s, end[m]))

    for s in range(n - 1):
        offer(s)
    alive = [True] * n
    while heap:
        worse, s, e = heapq.heappop(heap)
        # still two neighbouring symbols that make up this edge
        if not alive[s] or end[s] >= n or end[s] >= e or end[end[s]] != e:
            continue
        if scores is not None:
            scores.append(-worse)
        alive[end[s]] = False
        end[s] = e
        if e < n:
            before[e] = s
            offer(s)
        if before[s] >= 0:
            offer(before[s])
    ids: list[int] = []
    s = 0
    while s < n:
        hit = find(word[s : end[s]])
        ids += [hit[1]] if hit else [first_byte + b for b in word[s : end[s]].encode("utf-8", "surrogatepass")]
        s = end[s]
    return ids


def split(text: str | None, model: Model) -> list[str]:
    return model.word.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Coded(Words):
    """Word -> (ids, their text form, the bytes they decode to)."""

    def __init__(self, model: Model):
        super().__init__(model)
        self.bytes = {i: p.encode("utf-8", "surrogatepass") for p, i, _ in model.pieces}
        self.bytes |= {model.first_byte + b: bytes([b]) for b in range(256)}

    def __missing__(self, word: str) -> tuple[list[int], bytes, bytes]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = out = self.forms(merged(word, self.table, self.model.first_byte))
        return out

    def forms(self, ids: Iterable[int]) -> tuple[list[int], bytes, bytes]:
        ids = list(ids)
        return ids, ",".join(map(str, ids)).encode(), b"".join([self.bytes[i] for i in ids])

    def split(self, text: str | None) -> list[str]:
        return split(text, self.model)

    def of(self, text: str | None) -> list[tuple[list[int], bytes, bytes]]:
        return list(map(self.__getitem__, self.split(text)))


def back(parts: list[bytes]) -> str:
    """Text of decoded words."""
    text = b"".join(parts).decode("utf-8", "replace").replace(SPACE, " ")
    return text.removeprefix(" ")


OUT = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string"


def _row(doc_id: int | None, got: list[tuple[list[int], bytes, bytes]], with_ids: bool) -> tuple:
    ids = b",".join([x[1] for x in got])
    digest = hashlib.sha256(back([x[2] for x in got]).encode("utf-8", "surrogatepass")).hexdigest()
    row = (doc_id, ids.count(b",") + 1 if got else 0, zlib.crc32(ids), digest)
    return (*row, np.concatenate([x[0] for x in got]).astype(np.int32) if got else np.empty(0, np.int32)) if with_ids else row


def _frame(rows: list[tuple], with_ids: bool) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", *(["ids"] if with_ids else [])])
    out["doc_id"] = pd.array([None if i is None or i != i else int(i) for i in out["doc_id"].tolist()], "Int64")
    return out


def encode_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """What ``encode`` returns with a BPE model, without a shuffle and without the relational lattice.

    Each worker merges words on a heap and remembers a bounded number of them.
    """
    if model.kind != "bpe":
        raise ValueError("texts of a unigram model go through encode")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Coded(shared.value)
        for batch in batches:
            yield _frame([_row(i, words.of(t), with_ids) for i, t in zip(batch["doc_id"].tolist(), batch["text"])], with_ids)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInPandas(run, OUT + ", ids array<int>" * with_ids)


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """``ids`` beside each row of a table of distinct words."""
    spark, kept = words.sparkSession, words.columns
    short = words.where(F.length("word") <= FOLDED_CHARS)
    fold = fold_merges if model.kind == "bpe" else fold_viterbi

    def folded(words: DataFrame, fold, packed: bool = False) -> DataFrame:
        return lattice(words, model, packed).select(*kept, fold(F.col("word"), F.col("edges"), model).alias("ids"))

    if model.ordered:
        odd = F.lit(False)
        for p in model.odd:
            odd = odd | F.contains("word", F.lit(p))
        out = folded(short.where(~odd), fold_ranked, True)
        out = out.union(folded(short.where(odd), fold)) if model.odd else out
    else:
        out = folded(short, fold)
    if model.kind != "bpe":
        return out.union(
            lattice(words.where(F.length("word") > FOLDED_CHARS), model).select(
                *kept, fold(F.col("word"), F.col("edges"), model).alias("ids")
            )
        )
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Words(shared.value)
        for batch in batches:
            ids = pa.array([of[w] for w in batch["word"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*kept, "ids"])

    return out.union(words.where(F.length("word") > FOLDED_CHARS).mapInArrow(run, out.schema))


@contextmanager
def _held_groups(spark: SparkSession) -> Iterator[None]:
    """Spark keeps up to ``HELD_GROUPS`` groups of a task in memory, not 128, and writes scratch tables in less room."""
    ours = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": HELD_GROUPS, "spark.sql.parquet.compression.codec": "zstd"}
    were = {key: spark.conf.get(key, None) for key in ours}
    for key, value in ours.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, was in were.items():
            spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def _parted(texts: list[str | None], model: Model) -> tuple[pa.Array, np.ndarray]:
    """Words of texts in turn, as ``split`` parts them, and where the words of each text begin and those of the last end."""
    marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    joined = "".join(marked)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    first = np.concatenate(([0], np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))))
    kind = model.kinds[points]
    cut = np.ones(len(points) + 1, bool)
    np.logical_not(JOINED.ravel()[(kind[:-1] << 3) | kind[1:]], out=cut[1 : len(points)])
    cut[first] = True
    at = np.flatnonzero(cut)
    width = np.ones(len(points), np.uint8)
    for more in (0x80, 0x800, 0x10000):
        width += points >= more
    ends = np.concatenate(([0], np.cumsum(np.add.reduceat(width, at[:-1], dtype=np.int64) if len(at) > 1 else [])))
    words = pa.Array.from_buffers(
        pa.large_string(), len(at) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(joined.encode("utf-8"))]
    )
    return words, np.searchsorted(at, first)


def _blocks(texts: pa.ChunkedArray, most: int) -> Iterator[tuple[int, int]]:
    """Rows from and to, of about ``most`` code points together; a text of any length is whole."""
    total = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy()).astype(np.int64)
    at = 0
    while at < len(total):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _words_of_texts(texts: pa.ChunkedArray, model: Model) -> tuple[pa.ChunkedArray, np.ndarray]:
    """What ``_parted`` returns, some texts at a time."""
    words, firsts, n = [], [np.zeros(1, np.int64)], 0
    for at, to in _blocks(texts, PARTED_CHARS):
        part, first = _parted(texts[at:to].to_pylist(), model)
        words.append(part)
        firsts.append(first[1:] + n)
        n += len(part)
    return pa.chunked_array(words, pa.large_string()), np.concatenate(firsts)


def _joined(values: pa.Array, first: np.ndarray) -> pa.Array:
    """Values (large binary) put together from each of ``first`` to the next."""
    if not len(values):
        return pa.array([b""] * (len(first) - 1), pa.large_binary())
    _, ends, data = values.buffers()
    at = np.frombuffer(ends, np.int64)[values.offset :][first]
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(at), data])


class Known:
    """Words and what is made of their ids: text forms, bytes they decode to; nothing in it is a Python object a word."""

    def __init__(self, words: pa.Array, ids: pa.Array, model: Model):
        names = [b""] * (max([i for _, i, _ in model.pieces] + [model.first_byte + 255]) + 1)
        for b in range(256):
            names[model.first_byte + b] = bytes([b])
        for p, i, _ in model.pieces:
            names[i] = p.encode("utf-8", "surrogatepass")
        self.words, self.model = words, model
        self.sizes = pc.list_value_length(ids).to_numpy()
        starts = np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64)))
        self.ids, flat = ids, ids.flatten()
        #: With a comma behind every id.
        self.forms = _joined(pa.array([b"%d," % i for i in range(len(names))], pa.large_binary()).take(flat), starts)
        self.bytes = _joined(pa.array(names, pa.large_binary()).take(flat), starts)
        #: Whether every word decodes to itself, so that any text of them does.
        self.same = self.bytes.equals(words.cast(pa.large_binary()))

    def rows(self, texts: pa.Table, with_ids: bool) -> pa.Table:
        """One row a text (``doc_id, text``); its words are all known."""
        words, first = _words_of_texts(texts["text"], self.model)
        at = pc.index_in(words, value_set=self.words).combine_chunks()
        if at.null_count:
            raise ValueError("a text has a word that its chunk has no ids for")
        sizes = np.concatenate(([0], np.cumsum(self.sizes[at.to_numpy()], dtype=np.int64)))[first]
        forms = _joined(self.forms.take(at), first).to_pylist()
        coded = words.combine_chunks().cast(pa.large_binary()) if self.same else self.bytes.take(at)
        digests = [hashlib.sha256(back([x]).encode("utf-8", "surrogatepass")).hexdigest() for x in _joined(coded, first).to_pylist()]
        crcs = [zlib.crc32(memoryview(x)[:-1]) for x in forms]
        out = [texts["doc_id"], pa.array(np.diff(sizes)), pa.array(crcs, pa.int64()), pa.array(digests, pa.string())]
        if with_ids:
            flat = self.ids.take(at).flatten()
            out.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat.cast(pa.int32())))
        return pa.Table.from_arrays(out, names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", *(["ids"] if with_ids else [])])


def _pack(part: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    codec = pa.Codec("zstd", compression_level=ZSTD_LEVEL)
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as out:
        out.write_table(part)
    return sink.getvalue().to_pybytes()


def _unpack(blobs: pa.ChunkedArray) -> Iterator[pa.Table]:
    for blob in blobs:
        yield pa.ipc.open_stream(blob.as_buffer()).read_all()


def _one_list(numbers: pa.Array) -> pa.Array:
    """All numbers as one list, no wider than they need."""
    values = numbers.to_numpy(zero_copy_only=False)
    narrow = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    return pa.LargeListArray.from_arrays(pa.array([0, len(narrow)], pa.int64()), pa.array(narrow))


def _narrowed(part: pa.Table) -> pa.Table:
    """Words and their ids as one row, sizes instead of places, which takes less room when compressed."""
    words, ids = part["word"].combine_chunks(), part["ids"].combine_chunks()
    return pa.table(
        {
            "word": _joined(words.cast(pa.large_binary()), np.array([0, len(words)])),
            "sizes": _one_list(pc.binary_length(words)),
            "ids": _one_list(ids.flatten()),
            "counts": _one_list(pc.list_value_length(ids)),
        }
    )


def _widened(row: pa.Table) -> pa.Table:
    data, sizes, ids, counts = (row[n].combine_chunks() for n in ("word", "sizes", "ids", "counts"))
    at, of_ids = (np.concatenate(([0], np.cumsum(x.flatten().to_numpy(), dtype=np.int64))) for x in (sizes, counts))
    words = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), data.buffers()[2]])
    lists = pa.LargeListArray.from_arrays(pa.array(of_ids), ids.flatten().cast(pa.int32()))
    return pa.Table.from_arrays([words, lists], schema=WORDS)


def _packed(rows: pa.Table, order: np.ndarray, chunks: np.ndarray, name: str, form=lambda x: x) -> Iterator[pa.RecordBatch]:
    """``(chunk, name)``: the rows at ``order``, compressed together for each of the sorted ``chunks`` beside them."""
    found, at = np.unique(chunks, return_index=True)
    for chunk, start, stop in zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(chunks)]):
        part = rows.take(pa.array(order[start:stop])).combine_chunks()
        blob = pa.array([_pack(form(part))], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), blob], names=["chunk", name])


TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
WORDS = pa.schema([("word", pa.large_string()), ("ids", pa.large_list(pa.int32()))])


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunks = batch["chunk"].to_numpy()
        order = np.argsort(chunks, kind="stable")
        yield from _packed(pa.Table.from_batches([batch]).select(["doc_id", "text"]), order, chunks[order], "texts")


def _pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their ids for each chunk they are in; words alike stand together."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).sort_by("word").combine_chunks()
        held.clear()
        lists = rows["chunks"].combine_chunks()
        chunks, word = pc.list_flatten(lists).to_numpy(), pc.list_parent_indices(lists).to_numpy()
        order = np.argsort(chunks, kind="stable")
        yield from _packed(rows.select(["word", "ids"]), word[order], chunks[order], "words", _narrowed)

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= TASK_WORDS:
            yield from out()
    if held:
        yield from out()


def _words_in(batch: pa.RecordBatch, model: Model) -> pa.Table:
    """``(word, chunks)``: the distinct words of the batch's texts and the chunks they are in."""
    at = batch["chunk"].to_numpy()
    order = np.argsort(at, kind="stable")
    found, first = np.unique(at[order], return_index=True)
    words = []
    for start, stop in zip(first.tolist(), [*first[1:].tolist(), len(at)]):
        texts = pa.chunked_array([batch["text"].take(pa.array(order[start:stop]))])
        words.append(_words_of_texts(texts, model)[0].unique())
    coded = pa.chunked_array(words, pa.large_string()).combine_chunks().dictionary_encode()
    place, chunks = coded.indices.to_numpy(), np.repeat(found, list(map(len, words)))
    sizes = np.bincount(place, minlength=len(coded.dictionary))
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(chunks[np.argsort(place, kind="stable")], pa.int64())
    )
    return pa.table({"word": coded.dictionary.cast(pa.string()), "chunks": lists})


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(doc_id, n_ids, ids_crc32, decoded_sha256[, ids])``, one row per row of ``docs``.

    Distinct words are encoded once, over their lattice.  Texts are dealt into
    chunks of about ``CHUNK_CHARS`` by a hash of id and text, so copies spread;
    a chunk meets the ids of its own distinct words, which its size bounds.  A
    word carries the list of its chunks, over its lattice too; texts, and words
    with their ids, travel compressed.  Texts are parted and ids looked up in arrays.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chars // CHUNK_CHARS + 1)).alias("chunk")
    rows = rows.select("doc_id", "text", chunk)
    shared = spark.sparkContext.broadcast(model)

    def words_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _words_in(batch, shared.value).to_batches(TASK_WORDS)
            pa.default_memory_pool().release_unused()

    dealt = rows.mapInArrow(words_in, "word string, chunks array<long>").repartition("word")
    with _held_groups(spark):
        used = scratch.keep(dealt.groupBy("word").agg(F.array_distinct(F.flatten(F.collect_list("chunks"))).alias("chunks")), "spm-used")
        del dealt
        _free(spark)
        # so many tasks that a task groups the edges of its words in memory
        spread = used.repartition(used.count() // TASK_WORDS + 1, "word")
        coded = scratch.keep(encode_words(spread, model), "spm-words")
        del spread
        _free(spark)

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        texts = pa.concat_tables([TEXTS.empty_table(), *(x.cast(TEXTS) for x in _unpack(texts["texts"]))])
        words = pa.concat_tables([WORDS.empty_table(), *map(_widened, _unpack(words["words"]))])
        known = Known(*(words[n].combine_chunks() for n in WORDS.names), shared.value)
        out = [known.rows(texts[at:to], with_ids) for at, to in list(_blocks(texts["text"], FOUND_CHARS)) or [(0, 0)]]
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    known = coded.mapInArrow(_pack_words, "chunk long, words binary")
    texts = rows.mapInArrow(_pack_texts, "chunk long, texts binary")
    return texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, OUT + ", ids array<int>" * with_ids)


def _free(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing holds any more."""
    gc.collect()
    spark._jvm.System.gc()


def decoded(ids: Column, model: Model) -> Column:
    """The text of ids: pieces and bytes joined, marks turned to spaces, the first space dropped.

    The vocabulary is a literal array, indexed by id.
    """
    hexes = [""] * (max([i for _, i, _ in model.pieces] + [model.first_byte + 255]) + 1)
    for b in range(256):
        hexes[model.first_byte + b] = f"{b:02X}"
    for p, i, _ in model.pieces:
        hexes[i] = p.encode().hex()
    table = F.split(F.lit(",".join(hexes)), ",")
    joined = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "utf-8")
    text = F.replace(joined, F.lit(SPACE), F.lit(" "))
    return F.when(text.startswith(" "), F.substr(text, F.lit(2))).otherwise(text)
