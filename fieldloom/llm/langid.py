"""Language identification as inference of a multilingual mixture.

Each language is a distribution over hashed character trigrams.  A document's
trigrams are taken as draws from a mixture of languages, whose proportions
expectation-maximisation estimates; the set of languages comes from penalised
likelihood, dropping the weakest language while that costs less log-likelihood
than a language is charged for.  The language named is the one with the
largest proportion, which is also the score.

The model is fitted on a bounded sample (``TRAIN_DOCS`` documents are expected
in it) of labelled documents; its table has ``BUCKETS`` rows a language, so
what is broadcast does not grow with the data.  Every document is judged on its
whole text.  Defined results: a null text or one without a letter is ``und``
with score 0, and so is every text if nothing is labelled; equal texts get
equal results; ties go to the first language in alphabetical order; an empty
table gives an empty result; extra columns pass untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Documents expected in the training sample, however many are labelled.
TRAIN_DOCS = 20_000
#: Trigrams are hashed into so many buckets.
BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 25
#: Log-likelihood that a language is charged, times the logarithm of the number of trigrams.
PENALTY = 2.0
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point up to U+FFFF: the lower-case letter, or a space."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((i if chr(i).isalpha() else 32 for i in range(0x10000)), np.uint32, 0x10000)
    return _letters


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the letters of a text, with one space between words; whole text."""
    if not text:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if codes.max(initial=0) > 0xFFFF:
        high = codes > 0xFFFF
        codes = codes.copy()
        codes[high] = [c if chr(c).isalpha() else 32 for c in codes[high].tolist()]
        low = ~high
        codes[low] = _letter_table()[codes[low]]
    else:
        codes = _letter_table()[codes]
    codes = np.concatenate((np.array([32], np.uint32), codes, np.array([32], np.uint32)))
    space = codes == 32
    codes = codes[~(space & np.concatenate(([False], space[:-1])))]
    if len(codes) < 3:
        return np.empty(0, np.uint32)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    h = a * np.uint32(0x9E3779B1) ^ (b * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F)) ^ c * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(16))[b != 32]


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(grams) > 2000:
        all_counts = np.bincount(grams, minlength=BUCKETS)
        ids = np.flatnonzero(all_counts)
        return ids, all_counts[ids].astype(float)
    ids, n = np.unique(grams, return_counts=True)
    return ids, n.astype(float)


@dataclass
class Model:
    """languages, and P(bucket | language) as a (BUCKETS, languages) array."""

    languages: list[str]
    table: np.ndarray


def fit_mixture(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``p`` and the log-likelihood of counts ``n``."""
    pi, total = np.full(p.shape[1], 1 / p.shape[1]), n.sum()
    for _ in range(ROUNDS):
        q = p @ pi
        new = pi * (p.T @ (n / q)) / total
        done = np.abs(new - pi).max() < 1e-4
        pi = new
        if done:
            break
    return pi, float(n @ np.log(p @ pi))


def infer(model: Model, text: str | None) -> dict[str, float]:
    """Proportions of the languages selected for a text; empty without a letter."""
    grams = trigrams(text)
    if len(grams) == 0 or not model.languages:
        return {}
    ids, n = counted(grams)
    p = model.table[ids]
    chosen = np.arange(len(model.languages))
    pi, fit = fit_mixture(p, n)
    charge = PENALTY * math.log(len(grams) + 1)
    while len(chosen) > 1:
        keep = np.delete(np.arange(len(chosen)), int(np.argmin(pi)))
        pi2, fit2 = fit_mixture(p[:, chosen[keep]], n)
        if fit - fit2 >= charge:
            break
        chosen, pi, fit = chosen[keep], pi2, fit2
    return {model.languages[c]: float(x) for c, x in zip(chosen, pi / pi.sum())}


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text divisible by five; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS
) -> Model:
    """Fit on labelled documents that are not held out, a sample of about ``train_docs``.

    Documents enter by a hash of their id; counts per language and bucket are
    summed before they come to the driver, at most ``BUCKETS`` a language.
    """
    labelled = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).where(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id"))
    )
    rows = labelled.select("id", "lang").count()
    if rows > train_docs:
        labelled = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * train_docs / rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                at = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                at += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in sums.items():
            ids = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": ids.astype(np.int32), "n": n[ids]})

    sums = (
        labelled.select("text", "lang")
        .mapInPandas(run, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(sums["lang"].unique().tolist())
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    for i, lang in enumerate(languages):
        part = sums[sums["lang"] == lang]
        table[part["bucket"].to_numpy(), i] += part["n"].to_numpy()
    return Model(languages, table / table.sum(axis=0))


PREDICTED = "lang_pred string, score double, languages string"


def predicted(docs: DataFrame, model: Model, text: Column) -> Column:
    """struct of ``PREDICTED`` for a text; ``languages`` lists the set with proportions."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            got = infer(shared.value, text)
            best = min(got, key=lambda k: (-got[k], k)) if got else UNKNOWN
            rows.append(
                (best, min(1.0, got.get(best, 0.0)), ",".join(f"{k}:{got[k]:.4f}" for k in sorted(got, key=lambda k: (-got[k], k))))
            )
        return pd.DataFrame(rows, columns=["lang_pred", "score", "languages"])

    return F.pandas_udf(run, PREDICTED)(text)


#: A document of the pipeline stays if its largest language has such a share.
LEAST_SHARE = 0.4


def keep_identified(docs: DataFrame, text_col: str = "text", least: float = LEAST_SHARE) -> DataFrame:
    """The rows of ``docs`` whose main language is known and has at least the share ``least``."""
    name = free_name(docs, "__language")
    got = docs.select("*", predicted(docs, train(docs, text_col=text_col), docs[text_col]).alias(name))
    return got.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least)).select(*docs.columns)
