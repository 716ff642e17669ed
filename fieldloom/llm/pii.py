"""Personal data: plain identifiers, and disguised ones found through offset-preserving transducers.

Plain identifiers come from four fixed patterns.  For disguises a text runs
through two transducers, each of which keeps a map from its output to source
spans: one folds homoglyphs, width forms, foreign digits and zero-width
characters, one rewrites spelled digits and at/dot disguises.  Four numbers
joined by dots of any writing are an IP; a number of at least four spelled
digits is judged by itself, one of fewer by the fixed patterns.  The fixed
patterns then run on the normalised text and their spans are mapped back to
code points of the source.  A mapped span is added beside the plain ones, or
around one that is only a part of it; any other overlap leaves it out.

Every text is handled whole, in the Arrow batches that Spark bounds by bytes;
a text that nothing disguises costs a few substring scans.  Defined results: a
null text is an empty one and has no span; repeated rows are handled alike; an
empty table gives an empty result; extra columns pass untouched.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (start, end) in code points, end exclusive
Span = tuple[int, int]
KINDS = ("email", "ip", "card", "phone")

EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only start where a run of digits does, so no run is scanned twice.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of the email pattern, found from each ``@`` outwards.

    The local part can hold no ``@``, so it is the run of its characters just
    before one, from the end of the match before; that is where a scan from
    the left would start too, without its quadratic backtracking.
    """
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in EMAIL_LEFT:
            start -= 1
        if start < at and (m := EMAIL_RIGHT.match(text, at)):
            out.append((start, m.end()))
            floor = m.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)
    return out


def has_digit(text: str) -> bool:
    return any(c in text for c in "0123456789")


def plain(text: str) -> dict[str, list[Span]]:
    """Spans of the four fixed patterns, leftmost and non-overlapping within a kind."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if has_digit(text):
        if "." in text:
            out["ip"] = [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


class Mapped:
    """A text with the source span of each of its characters, kept as runs."""

    def __init__(self, text: str):
        self.text = text
        #: starts in this text; (source start, source end, one-to-one) per run
        self.starts, self.runs = [0], [(0, len(text), True)]

    def source(self, start: int, end: int) -> Span:
        a, b = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        (s, _, same), (s2, e2, same2) = self.runs[a], self.runs[b]
        return (s + start - self.starts[a] if same else s), (s2 + end - self.starts[b] if same2 else e2)

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """This text with non-overlapping, ordered edits (start, end, new text)."""
        out = Mapped("")
        out.starts, out.runs, parts, at, size = [], [], [], 0, 0

        def keep(upto: int) -> None:
            nonlocal size, at
            while at < upto:
                i = bisect_right(self.starts, at) - 1
                stop = min(upto, self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text))
                s, e, same = self.runs[i]
                out.starts.append(size)
                out.runs.append((s + at - self.starts[i], s + stop - self.starts[i], True) if same else (s, e, False))
                parts.append(self.text[at:stop])
                size, at = size + stop - at, stop

        for start, end, new in edits:
            keep(start)
            if new:
                out.starts.append(size)
                out.runs.append((*self.source(start, end), False))
                parts.append(new)
                size += len(new)
            at = end
        keep(len(self.text))
        out.text = "".join(parts)
        return out


# Letters of other scripts that look like Latin ones, and marks
# that stand for ASCII ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "г": "r", "п": "n",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "τ": "t", "υ": "u", "ι": "i", "κ": "k", "χ": "x", "η": "n", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ℓ": "l",
    "﹫": "@", "。": ".", "․": ".", "﹒": ".", "·": ".", "•": ".", "∙": ".",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "﹢": "+", "＿": "_",
}
#: Characters without width.
INVISIBLE = "­​‌‍⁠﻿"
#: Ranges of decimal digits outside ASCII, full width forms, spaces.
FOLDED = (
    "".join(map(re.escape, HOMOGLYPHS)) + INVISIBLE + "！-～  -   　"
    "٠-٩۰-۹०-९০-৯๐-๙\U0001d7ce-\U0001d7ff⁰-⁹²³¹₀-₉①-⑨"
)
FOLDED_RE = re.compile(f"[{FOLDED}]")


@lru_cache(maxsize=4096)
def fold(c: str) -> str:
    """The ASCII text that a folded character stands for; empty for one without width."""
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c.isspace():
        return " "
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    return unicodedata.normalize("NFKC", c)


# Digits as words in English, French, German and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8",
    "nueve": "9",
}
#: A number is taken for spelled from so many digit words in a row.
SPELLED_RUN = 4
#: ... and, with neither plus, dots nor check digit, so many different characters; an article said over and over is no number.
DISTINCT_DIGITS = 3
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_UNIT = rf"(?:{_WORD}(?![^\W\d_])|[0-9]+)"
_GAP = r"(?:[\s,./()-]{1,3}|(?=[0-9])|(?<=[0-9]))"
SPELLED = re.compile(
    rf"(?<!\w)(?:plus[\s-]+|\+[\s]?)?{_UNIT}(?:(?:{_GAP}|\s+(?:dot|point|punkt|punto)\s+){_UNIT})+", re.IGNORECASE
)
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+", re.UNICODE)

ATOM_CHARS = EMAIL_LEFT - {"."}
#: White space before a sign is taken from where it starts, so no run of it is scanned twice.
_BLANKS = r"(?<!\s)\s*+"
_BLANK = r"(?<!\s)\s++"
_DOT = rf"(?:\.|{_BLANKS}[\[({{<]\s*+(?:dot|\.)\s*+[\])}}>]\s*+|{_BLANK}dot\s++|{_BLANK}\.\s++|_dot_)"
_HIDDEN_DOT = rf"(?:{_BLANKS}[\[({{<]\s*+(?:dot|\.)\s*+[\])}}>]\s*+|{_BLANK}dot\s++|_dot_)"
#: A sure at: in brackets, or @ set apart.  A bare word needs a hidden dot after it.
SURE_AT = re.compile(rf"{_BLANKS}[\[({{<]\s*+(?:at|@)\s*+[\])}}>]\s*+|{_BLANK}@\s*+|@\s*+|_at_", re.IGNORECASE)
BARE_AT = re.compile(rf"{_BLANK}at\s++", re.IGNORECASE)
DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.IGNORECASE)
HIDDEN_DOT = re.compile(_HIDDEN_DOT, re.IGNORECASE)
_NUMBER_DOT = rf"(?:{_DOT}|{_BLANK}(?:point|punkt|punto)\s++)"
#: Numbers and digit words with anything between them that one of the patterns below, or ``SPELLED``, takes.
NUMBERS = re.compile(
    rf"(?<!\w)(?:plus[\s-]+|\+\s?)?{_UNIT}(?:(?>{_NUMBER_DOT}|\s+|[,./()-])*+{_UNIT})*", re.IGNORECASE
)
UNIT = re.compile(_UNIT, re.IGNORECASE)
_GROUP = rf"{_UNIT}(?:(?:[\s-]{{1,3}}|(?=[0-9])|(?<=[0-9])){_UNIT}){{0,2}}"
#: Four groups of up to three numbers or digit words.
DOTTED_IP = re.compile(rf"(?<!\w)({_GROUP}){_NUMBER_DOT}({_GROUP}){_NUMBER_DOT}({_GROUP}){_NUMBER_DOT}({_GROUP})", re.IGNORECASE)
#: What becomes another character in a number: a plus, a dot, a digit word.
REWRITTEN = re.compile(rf"(?P<plus>\Aplus[\s-]+|\A\+\s)|(?<!\s)(?P<dot>{_NUMBER_DOT})|(?<!\w)(?P<word>{_WORD})(?![^\W\d_])", re.IGNORECASE)
ANY_DOT = re.compile(_DOT, re.IGNORECASE)
WORD_BEFORE = re.compile(rf"(?<![^\W\d_]){_WORD}[\s-]{{1,3}}\Z", re.IGNORECASE)
WORD_AFTER = re.compile(rf"[\s-]{{1,3}}{_WORD}(?![^\W\d_])", re.IGNORECASE)
WORD_HERE = re.compile(_WORD, re.IGNORECASE)
LONGEST_WORD = max(map(len, DIGIT_WORDS))
def _disguised_emails(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn disguised addresses into plain ones."""
    found: list[tuple[int, int, bool]] = sorted(
        [(*m.span(), True) for m in SURE_AT.finditer(text)] + [(*m.span(), False) for m in BARE_AT.finditer(text)]
    )
    edits, floor = [], 0
    for start, end, sure in found:
        if start < floor or not (m := DOMAIN.match(text, end)):
            continue
        hidden = HIDDEN_DOT.search(m[0])
        if not sure and not hidden:
            continue
        if not (local := text[_local_start(text, start, floor) : start]):
            continue
        if text[start:end] == "@" and not hidden and ANY_DOT.fullmatch("."):
            if not re.search(r"[\s\[({<]|_dot_", local + m[0], re.IGNORECASE):
                continue  # a plain address
        a = start - len(local)
        edits.append((a, m.end(), f"{ANY_DOT.sub('.', local)}@{ANY_DOT.sub('.', m[0])}"))
        floor = m.end()
    return edits


def _unspaced(text: str, end: int, floor: int) -> int:
    """Where the white space that ends at ``end`` starts."""
    while end > floor and text[end - 1].isspace():
        end -= 1
    return end


def _dot_start(text: str, end: int, floor: int) -> int | None:
    """Where the plain or hidden dot that ends at ``end`` starts; None if there is none."""
    if end > floor and text[end - 1] == ".":
        return end - 1
    at = _unspaced(text, end, floor)
    if at > floor and text[at - 1] in "])}>":
        inner = _unspaced(text, at - 1, floor)
        if text[max(floor, inner - 3) : inner].lower() == "dot":
            inner -= 3
        elif inner > floor and text[inner - 1] == ".":
            inner -= 1
        else:
            return None
        inner = _unspaced(text, inner, floor)
        return _unspaced(text, inner - 1, floor) if inner > floor and text[inner - 1] in "[({<" else None
    if at < end and text[max(floor, at - 3) : at].lower() == "dot" and (gap := _unspaced(text, at - 3, floor)) < at - 3:
        return gap
    return None


def _local_start(text: str, end: int, floor: int) -> int:
    """Where the local part that ends at ``end`` starts: atoms joined by plain or hidden dots."""
    start = end
    while True:
        atom = start
        while atom > floor and text[atom - 1] in ATOM_CHARS:
            atom -= 1
        if atom == start:
            return kept if start != end else end
        kept = start = atom
        if (dot := _dot_start(text, start, floor)) is None:
            return kept
        start = dot


def _digits(text: str) -> str:
    """The digits of numbers and digit words."""
    return "".join(DIGIT_WORDS.get(t[0].casefold(), "") or t[0] for t in UNIT.finditer(text))


def _octet(digits: str) -> bool:
    return len(digits.lstrip("0")) < 4 and int(digits) <= 255


def _dotted_ips(text: str) -> list[Span]:
    """Spans of four numbers joined by dots, however dots and digits are written."""
    out, at = [], 0
    while m := DOTTED_IP.search(text, at):
        at = m.end(1)
        if not (_octet(_digits(m[2])) and _octet(_digits(m[3]))):
            continue
        # of the outer groups, what is nearest to the dots and makes a number
        starts = [m.start(1) + u.start() for u in UNIT.finditer(m[1])]
        ends = [m.start(4) + u.end() for u in UNIT.finditer(m[4])]
        start = next((i for i in starts if _octet(_digits(text[i : m.end(1)]))), None)
        end = next((i for i in reversed(ends) if _octet(_digits(text[m.start(4) : i]))), None)
        if start is None or end is None:
            continue
        # a digit word beside an outer number of digit words makes that number longer
        before = text[max(0, start - LONGEST_WORD - 4) : start]
        if WORD_HERE.match(text, start) and WORD_BEFORE.search(before):
            continue
        last = [u for u in UNIT.finditer(m[4]) if m.start(4) + u.end() <= end][-1]
        if WORD_HERE.match(last[0]) and WORD_AFTER.match(text, end):
            continue
        if not re.search(r"(?:plus[\s-]+|\+\s?)\Z", before[-8:], re.IGNORECASE):
            out.append((start, end))
            at = end
    return out


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Numbers with spelled digits (start, end, digits), dots between groups kept."""
    found = []
    for m in SPELLED.finditer(text):
        out, words = "+" if re.match(r"plus|\+", m[0], re.IGNORECASE) else "", 0
        for t in TOKEN.finditer(m[0]):
            w = t[0].casefold()
            if w in DIGIT_WORDS:
                out, words = out + DIGIT_WORDS[w], words + 1
            elif w in ("dot", "point", "punkt", "punto"):
                out += "."
            elif w.isdigit():
                out += w
        if words >= SPELLED_RUN:
            found.append((*m.span(), out))
    return found


def _outside(items: list[tuple[int, int, str]], taken: list[Span]) -> list[tuple[int, int, str]]:
    """The items (start, end, ...) that touch none of ``taken``; both ordered and without overlaps."""
    out, i = [], 0
    for item in items:
        while i < len(taken) and taken[i][1] <= item[0]:
            i += 1
        if i == len(taken) or item[1] <= taken[i][0]:
            out.append(item)
    return out


def _numbers(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, str]]]:
    """Disguised numbers (kind, start, end), and edits of others for the fixed patterns to judge."""
    found, edits = [], []
    for run in NUMBERS.finditer(text):
        changes = [(*m.span(), m.lastgroup) for m in REWRITTEN.finditer(run[0])]
        if all(kind == "dot" and e - s == 1 for s, e, kind in changes):
            continue
        at, taken = run.start(), _dotted_ips(run[0])
        found += [("ip", at + s, at + e) for s, e in taken]
        for s, e, digits in _outside(_spelled(run[0]), taken):
            only, kind = NOT_DIGIT.sub("", digits), None
            if digits[0] == "+" and 9 <= len(only) <= 15:
                kind = "phone"
            elif 13 <= len(only) <= 19 and len(set(only)) > 1 and luhn(only):
                kind = "card"
            elif 9 <= len(only) <= 15 and len(set(digits)) >= DISTINCT_DIGITS:
                kind = "phone"
            if kind:
                taken.append((s, e))
                found.append((kind, at + s, at + e))
        only = _digits(run[0])
        if len(only) >= 9 and (len(set(only)) > 1 or changes[0][2] == "plus" or run[0][0] == "+"):
            words = [c for c in changes if c[2] == "word"]
            if len(words) == 1 and (words[0][0] == 0 or words[0][1] == len(run[0])) and any(plain(run[0])[k] for k in ("card", "phone")):
                changes.remove(words[0])  # an article beside a number that is whole without it
            for s, e, kind in _outside(changes, sorted(taken)):
                edits.append((at + s, at + e, {"plus": "+", "dot": "."}.get(kind) or DIGIT_WORDS.get(run[0][s:e].casefold(), run[0][s:e])))
    return found, edits


#: A superset of what ``_disguised_emails`` takes beside plain addresses (lower case).
AT_OR_DOT = re.compile(r"\s@|@\s|dot|_at_|[\[({<]\s*(?:at|@|\.)\s*[\])}>]|\s\.\s")


def _hints(text: str) -> tuple[bool, bool]:
    """Whether a text may hold folded characters, disguised addresses."""
    folded = not text.isascii() and FOLDED_RE.search(text) is not None
    return folded, AT_OR_DOT.search(text.lower()) is not None


def disguised(text: str) -> dict[str, list[Span]]:
    """Spans, in code points of ``text``, of identifiers that only the normalised text shows."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    folded, dotted = _hints(text)
    mapped = Mapped(text)
    if folded:
        mapped = mapped.rewritten([(m.start(), m.end(), fold(m[0])) for m in FOLDED_RE.finditer(text)])
        _, dotted = _hints(mapped.text)
    numbers, changes = _numbers(mapped.text)
    for kind, start, end in numbers:
        # a spelled number is a whole identifier: joined to nothing beside it
        out[kind].append(mapped.source(start, end))
    edits = _disguised_emails(mapped.text) if dotted else []
    edits = sorted(edits + _outside(changes, [e[:2] for e in edits]))
    rewritten = mapped.rewritten(edits) if edits else mapped
    if folded or rewritten is not mapped:
        for kind, spans in plain(rewritten.text).items():
            out[kind] += [rewritten.source(*s) for s in spans]
    return out


class Blocks:
    """Spans by the blocks of 256 characters that they touch."""

    def __init__(self, spans: Iterable[Span]):
        self.at: dict[int, list[Span]] = {}
        for s in spans:
            self.add(s)

    def add(self, span: Span) -> None:
        for k in range(span[0] >> 8, (span[1] + 255) >> 8):
            self.at.setdefault(k, []).append(span)

    def near(self, span: Span) -> set[Span]:
        return {s for k in range(span[0] >> 8, (span[1] + 255) >> 8) for s in self.at.get(k, ())}


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans, and those that the transducers add."""
    text = text or ""
    base = plain(text)
    more = disguised(text)
    if any(more.values()):
        taken = Blocks(s for v in base.values() for s in v)
        for kind in KINDS:
            kept = []
            for s in sorted(set(more[kind])):
                # beside every other span, or around a plain one that is only a part of it
                if all(s[1] <= b or e <= s[0] or s[0] <= b and e <= s[1] and s != (b, e) for b, e in taken.near(s)):
                    kept.append(s)
                    taken.add(s)
            more[kind] = kept
    return base, more


def joined(spans: dict[str, list[Span]]) -> str:
    """``kind:start:end`` by kind, then start, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in capitals and brackets."""
    if not text:
        return text
    base, more = find(text)
    spans = sorted((s, -e, k) for d in (base, more) for k in KINDS for s, e in d[k])
    if not spans:
        return text
    parts, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            parts += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, -e)
    return "".join([*parts, text[at:]])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, n_added long, base string, spans string"


def _found(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base, more = find(text)
        rows.append(
            (*(len(base[k]) for k in KINDS), sum(map(len, more.values())), joined(base), joined({k: base[k] + more[k] for k in KINDS}))
        )
    return pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")])


def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(redacted)


def found(text: Column) -> Column:
    """struct of ``FOUND`` for a text: plain counts, spans added, plain spans and all spans."""
    return F.pandas_udf(_found, FOUND)(text)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with identifiers in the text replaced; ``length_col``, if there, follows the text."""
    out = docs.withColumn(text_col, F.pandas_udf(_redacted, "string")(docs[text_col]))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
