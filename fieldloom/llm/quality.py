"""Quality rules as a short-circuit cascade.

Every rule is a predicate over measures of a text.  On a bounded sample the
share of texts that a rule rejects and the time its measure takes are
estimated; rules then run in order of rejections per cost inside one ``CASE``,
which stops at the first rule that rejects.  The order never changes a
verdict, only which rule is named first and how much is left unevaluated.

DataFrame functions only.  Measures are computed inside the row, with no
shuffle, whatever the length of the text.  Defined results: a null or empty
text has no words and is rejected by the base rule; repeated rows are judged
alike; an empty table gives an empty result; extra columns pass untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name

#: What separates words, and what counts as a symbol.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
#: Expected rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 1000
#: Times that each sampled text is judged to time a rule, so that the rule outweighs the job around it.
REPEATS = 8


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def window_keys(words: Column) -> Column:
    """A 64-bit key for each 3-word window, in text order."""
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )


def _covered(keys: Column) -> Column:
    """Words covered by windows whose key stands at least twice in ``keys``.

    One sort of (key, position) pairs brings equal windows together; a fold
    over their positions in text order adds up the union of the windows.
    """
    pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def twice(p: Column) -> Column:
        none = F.lit(None).cast("struct<k:bigint,i:int>")
        last = F.size(p) - 1
        trio = F.arrays_zip(
            p.alias("p"),
            F.concat(F.array(none), F.slice(p, 1, last)).alias("before"),
            F.concat(F.slice(p, 2, last), F.array(none)).alias("after"),
        )
        same = lambda x, y: F.coalesce(x["p"]["k"] == x[y]["k"], F.lit(False))
        return F.transform(F.filter(trio, lambda x: same(x, "before") | same(x, "after")), lambda x: x["p"]["i"])

    # the sorted pairs are bound once, by a one-element transform
    starts = F.get(F.transform(F.array(pairs), lambda p: F.sort_array(twice(p))), 0)
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct(
            (acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"),
            (i + 3).alias("end"),
        ),
        lambda acc: acc["n"].cast("bigint"),
    )


class Measures:
    """Columns for the measures of a text, built when a rule asks for them."""

    def __init__(self, text: Column, words: Column):
        self.text, self.words = F.coalesce(text, F.lit("")), words

    @property
    def n_words(self) -> Column:
        return F.size(self.words).cast("bigint")

    @property
    def word_chars(self) -> Column:
        return F.length(F.array_join(self.words, "")).cast("bigint")

    @property
    def n_symbols(self) -> Column:
        return F.regexp_count(self.text, F.lit(SYMBOL)).cast("bigint")

    @property
    def _lines(self) -> Column:
        return F.filter(F.split(self.text, "\n"), lambda x: x.rlike(WORD_CHAR))

    @property
    def n_lines(self) -> Column:
        return F.size(self._lines).cast("bigint")

    @property
    def n_dup_lines(self) -> Column:
        return F.get(
            F.transform(F.array(self._lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")), 0
        )

    @property
    def n_repeat_words(self) -> Column:
        """Most texts repeat no window, which a hash set shows; only the others are sorted."""
        return F.get(
            F.transform(
                F.array(window_keys(self.words)),
                lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("bigint")).otherwise(
                    _covered(k)
                ),
            ),
            0,
        )


class _Named:
    """The same measures, read from columns of their names."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


@dataclass(frozen=True)
class Rule:
    """``reject`` maps measures to the predicate that rejects a text."""

    name: str
    reject: Callable[[Measures], Column]


#: Conservative bounds: each holds for text that no reader would keep.
RULES = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 20 * m.n_words)),
    Rule("symbols", lambda m: 10 * m.n_symbols > 5 * m.word_chars),
    Rule("dup_lines", lambda m: (m.n_lines >= 4) & (2 * m.n_dup_lines > m.n_lines)),
    Rule("repeat_words", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _with_words(df: DataFrame, text_col: str) -> tuple[DataFrame, str, str]:
    """``df`` with a column of words and one of row numbers, and the names that were free for them."""
    words, row = free_name(df, "__words"), free_name(df, "__row")
    # the row number keeps the optimizer from pulling the split into each rule
    return df.select("*", words_of(df[text_col]).alias(words), F.monotonically_increasing_id().alias(row)), words, row


def estimate(docs: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Name, share rejected and seconds of each rule, on about ``sample_rows`` rows.

    A rule's cost is the time of a job that judges each sampled text
    ``REPEATS`` times, less the time of the same job with a rule that looks at
    nothing; the faster of two runs, after one that compiles the code.
    """
    rows = docs.count()
    if rows == 0:
        return [{"name": r.name, "share": 0.0, "seconds": 1.0} for r in rules]
    scratch = Scratch(docs.sparkSession)
    text = docs.select(docs[text_col].alias("text"))
    sample = scratch.keep(text.sample(min(1.0, sample_rows / rows), seed=1), "quality-sample")
    staged, words, _ = _with_words(sample, "text")
    staged = staged.select("text", words, F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("again"))
    m = Measures(F.col("text"), F.col(words))

    def timed(reject: Column) -> tuple[float, float]:
        took, share = [], 0.0
        for _ in range(3):
            began = time.perf_counter()
            share = staged.agg(F.avg(reject.cast("double")).alias("share")).first()["share"] or 0.0
            took.append(time.perf_counter() - began)
        return share, min(took[1:])

    _, nothing = timed(F.size(words) < 0)
    out = []
    for rule in rules:
        share, seconds = timed(rule.reject(m))
        out.append({"name": rule.name, "share": share, "seconds": max(1e-4, seconds - nothing)})
    scratch.drop(sample)
    return out


def rule_order(docs: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by estimated rejections per second, best first; ties by time, then name."""
    got = {x["name"]: x for x in estimate(docs, text_col, rules, sample_rows)}
    return sorted(
        rules, key=lambda r: (-got[r.name]["share"] / max(1e-6, got[r.name]["seconds"]), got[r.name]["seconds"], r.name)
    )


def cascade(order: list[Rule], measures: Measures | _Named) -> Column:
    """Name of the first rule in ``order`` that rejects, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(order):
        out = F.when(rule.reject(measures), F.lit(rule.name)).otherwise(out)
    return out


def judge(docs: DataFrame, text_col: str = "text", order: list[Rule] | None = None) -> DataFrame:
    """Adds every measure and ``rejected_by`` (null: kept) to the columns of ``docs``."""
    order = order or rule_order(docs, text_col)
    staged, words, _ = _with_words(docs, text_col)
    m = Measures(staged[text_col], F.col(words))
    out = staged.select(*docs.columns, *[getattr(m, x).alias(x) for x in MEASURES])
    return out.select("*", cascade(order, _Named()).alias("rejected_by"))


def keep_good(docs: DataFrame, text_col: str = "text", order: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects; measures after the first rejection aren't computed."""
    order = order or rule_order(docs, text_col)
    staged, words, row = _with_words(docs, text_col)
    verdict = cascade(order, Measures(staged[text_col], F.col(words)))
    return staged.where(verdict.isNull() & (F.col(row) >= 0)).select(*docs.columns)
