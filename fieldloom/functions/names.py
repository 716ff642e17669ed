"""Mnemonics, paths and identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of tags that are internal to the controller.
INTERNAL_PREFIXES = ("VALUE_STATUS", "STATUS_", "INTERNAL_", "CALC_", "TEMP_", "FLAG_", "TIMER_", "COUNTER_")
#: The first segment of a mnemonic.
CATEGORIES = ("DI", "DO", "AI", "AO", "SDI", "SDO", "SAI", "SAO")
MAX_LENGTH = 64


def is_internal(mnemonic: Column, prefixes=INTERNAL_PREFIXES) -> Column:
    m = F.upper(mnemonic)
    out = F.lit(False)
    for p in prefixes:
        out = out | m.startswith(p)
    return out


def is_spare(mnemonic: Column) -> Column:
    return F.upper(mnemonic).endswith("_SPARE")


def parts(mnemonic: Column) -> Column:
    """struct(category, location, signal): the first segment if it is a category, the next (upper case), the rest."""
    s = F.split(mnemonic, "_")
    known = F.upper(F.get(s, 0)).isin(*CATEGORIES)
    at = F.when(known, 1).otherwise(0)
    rest = F.array_join(F.slice(s, at + 2, F.greatest(F.size(s) - at - 1, F.lit(0))), "_")
    return F.struct(
        F.when(known, F.upper(F.get(s, 0))).alias("category"),
        F.when(F.length(mnemonic) > 0, F.upper(F.get(s, at))).alias("location"),
        F.nullif(rest, F.lit("")).alias("signal"),
    )


def normalize_mnemonic(text: Column) -> Column:
    """Upper case, outer blanks dropped, inner ones to ``_``."""
    return F.replace(F.trim(F.upper(text)), F.lit(" "), F.lit("_"))


def suggest_mnemonic(category: Column, location: Column, signal: Column, max_length: int = MAX_LENGTH) -> Column:
    """``category_location_signal`` in upper case; other characters of the signal dropped, the whole cut to length."""
    clean = F.regexp_replace(normalize_mnemonic(signal), r"[^A-Z0-9_]", "")
    return F.substring(F.concat_ws("_", F.trim(F.upper(category)), normalize_mnemonic(location), clean), 1, max_length)


def signal_name(mnemonic: Column) -> Column:
    """What follows the first two segments, with spaces."""
    s = F.split(mnemonic, "_")
    return F.array_join(F.slice(s, 3, F.greatest(F.size(s) - 2, F.lit(0))), " ")


def check_mnemonic(mnemonic: Column, max_length: int = MAX_LENGTH) -> Column:
    """struct(is_valid, errors, warnings): codes of the naming rules that a mnemonic breaks."""
    p = parts(mnemonic)
    empty = F.coalesce(F.length(mnemonic), F.lit(0)) == 0
    errors = F.array(
        F.when(empty, "EMPTY"),
        F.when(F.length(mnemonic) > max_length, "LENGTH"),
        F.when(~empty & ~F.upper(mnemonic).rlike(r"^[A-Z0-9_]+$"), "CHARACTERS"),
        F.when(~empty & p["category"].isNull(), "CATEGORY"),
    )
    warnings = F.array(
        F.when(~empty & p["signal"].isNull(), "SIGNAL"),
        F.when(mnemonic.contains("__"), "DOUBLE_UNDERSCORE"),
        F.when(mnemonic.startswith("_") | mnemonic.endswith("_"), "EDGE_UNDERSCORE"),
    )
    errors, warnings = (F.filter(x, lambda c: c.isNotNull()) for x in (errors, warnings))
    return F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), warnings.alias("warnings"))


def first_number(text: Column) -> Column:
    """The first run of digits as a number, null without one."""
    return F.regexp_extract(text, "[0-9]+", 0).try_cast("long")


def file_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_-]", "_")


def wildcard_path(path: Column) -> Column:
    """Every ``[..]`` replaced by ``[*]``, spaces dropped: the key on which paths match."""
    return F.regexp_replace(F.regexp_replace(path, r"\s+", ""), r"\[[^\]]+\]", "[*]")


def path_indices(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit(r"\[([^\]]+)\]"), F.lit(1))


def path_parent(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"^(.*)\.([^.]+)$", 1), F.lit(""))


def path_leaf(path: Column) -> Column:
    return F.regexp_extract(path, r"([^.]+)$", 1)


def path_root(path: Column) -> Column:
    """The quoted first name of a path, else its bare first name."""
    quoted = F.regexp_extract(path, r'^"([^"]*)"', 1)
    return F.when(quoted != "", quoted).otherwise(F.nullif(F.regexp_extract(path, r"^([A-Za-z_]\w*)", 1), F.lit("")))


def ancestors(path: Column, separator: str = ".") -> Column:
    """Proper prefixes of a path, shortest first."""
    s = F.split(path, F.lit("\\" + separator))
    n = F.size(s)
    return F.when(
        n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(s, F.lit(1), i), separator))
    ).otherwise(F.array().cast("array<string>"))


def suffixes(path: Column, separator: str = "/") -> Column:
    """Suffixes of a path from the longest."""
    s = F.split(path, F.lit("\\" + separator))
    return F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.array_join(F.slice(s, i, F.size(s)), separator))


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2"))


def pascal_case(name: Column) -> Column:
    s = F.split(camel_to_snake(name), r"[_\s-]+")
    return F.array_join(F.transform(s, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")


def camel_case(name: Column) -> Column:
    p = pascal_case(name)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))


def screaming_snake(name: Column) -> Column:
    return F.upper(camel_to_snake(F.regexp_replace(name, r"[\s-]+", "_")))


def python_identifier(name: Column) -> Column:
    safe = F.regexp_replace(name, r"\W", "_")
    return F.when(safe.rlike(r"^\d"), F.concat(F.lit("_"), safe)).otherwise(safe)


def type_spec(text: Column) -> Column:
    """``Array[lo..hi, ...] of T`` or ``String[n]`` to struct(base, bounds, length)."""
    low = F.trim(text)
    inside = F.regexp_extract(low, r"(?i)^array\s*\[([^\]]*)\]", 1)
    pairs = F.regexp_extract_all(inside, F.lit(r"(-?\d+)\s*\.\.\s*(-?\d+)"), F.lit(0))
    bounds = F.transform(
        pairs,
        lambda x: F.struct(
            F.trim(F.get(F.split(x, r"\.\."), 0)).cast("int").alias("lo"), F.trim(F.get(F.split(x, r"\.\."), 1)).cast("int").alias("hi")
        ),
    )
    base = F.regexp_replace(low, r"(?i)^array\s*\[[^\]]*\]\s*of\s+", "")
    n = F.regexp_extract(base, r"(?i)^w?string\s*\[(\d+)\]", 1)
    return F.struct(
        F.regexp_replace(F.regexp_replace(base, r"\s*\[\d+\]$", ""), '"', "").alias("base"),
        bounds.alias("bounds"),
        F.when(n != "", n.cast("int")).alias("length"),
    )


def element_count(bounds: Column) -> Column:
    return F.aggregate(bounds, F.lit(1).cast("long"), lambda acc, b: acc * (b["hi"] - b["lo"] + 1))


def human_bytes(n: Column, largest: str = "GB") -> Column:
    """In units of 1024 up to ``largest``; halves to even, as the format of the reference rounds them.

    The reference's packet display ends with GB, its session display with MB.
    """
    units = ["KB", "MB", "GB"]
    out = None
    for k in range(units.index(largest), -1, -1):
        scale = 1 << (10 * (k + 1))
        text = F.concat(F.format_string("%.1f", F.bround(n / float(scale), 1)), F.lit(f" {units[k]}"))
        out = text if out is None else F.when(n < (scale << 10), text).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def without_project(comment: Column) -> Column:
    """A text without its leading project number: ``021-HS-6052A`` to ``HS-6052A``."""
    return F.regexp_replace(comment, r"^\d+-", "")


def instrument(identifier: Column) -> Column:
    """struct(tag_type, code): ``HS-6020A`` to ``HS`` and ``6020A``; ``?`` and the text where it has another form."""
    form = r"^([A-Za-z]+)[-_]?(\d\w*)$"
    fits = identifier.rlike(form)
    return F.struct(
        F.when(fits, F.regexp_extract(identifier, form, 1)).otherwise("?").alias("tag_type"),
        F.when(fits, F.regexp_extract(identifier, form, 2)).otherwise(identifier).alias("code"),
    )


def state_name(raw: Column) -> Column:
    """A state without its mark and quotes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^#+\s*", ""), r'^"+|"+$', ""))


def short_condition(condition: Column) -> Column:
    """A condition for a diagram: last part of block paths, no marks or quotes, ``!=``, blanks around operators."""
    c = F.regexp_replace(condition, r"#(\w+)", "$1")
    c = F.regexp_replace(c, r'"[^"]+"(?:\.\w+)?\.(\w+)', "$1")
    c = F.regexp_replace(c, r'"(\w+)"', "$1")
    c = F.replace(c, F.lit("<>"), F.lit("!="))
    c = F.regexp_replace(c, r"(\w)(!?=)(\w)", "$1 $2 $3")
    c = F.regexp_replace(F.trim(c), r"^\(\s*([^()]+)\s*\)$", "$1")
    # an operator with a name or bracket on at least one side and something on both
    c = F.regexp_replace(c, r"(?<=[\w)\s])(OR|AND)(?=[\w(])", " $1 ")
    c = F.regexp_replace(c, r"(?<=[\w)])(OR|AND)(?=\s)", " $1")
    return F.trim(F.regexp_replace(c, r"\s+", " "))
