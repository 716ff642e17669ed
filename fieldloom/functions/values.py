"""Bit slices, register decoding, checked arithmetic, durations and conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the slice letters X, B, W, D.
SLICE_BITS = {"X": 1, "B": 8, "W": 16, "D": 32}


def bit_slice(value: Column, kind: str, index: int) -> Column:
    """``%Xn %Bn %Wn %Dn`` of an integer; two's complement for a negative one; X gives a boolean."""
    width = SLICE_BITS[kind.upper()]
    part = F.shiftright(value.cast("long"), index * width).bitwiseAND(F.lit((1 << width) - 1))
    return part == 1 if width == 1 else part


def with_bit_slice(value: Column, kind: str, index: int, new: Column) -> Column:
    width = SLICE_BITS[kind.upper()]
    mask = ((1 << width) - 1) << (index * width)
    kept = value.cast("long").bitwiseAND(F.lit(~mask))
    return kept.bitwiseOR(F.shiftleft(new.cast("long").bitwiseAND(F.lit((1 << width) - 1)), index * width))


def int16(word: Column) -> Column:
    w = word.cast("long").bitwiseAND(F.lit(0xFFFF))
    return F.when(w >= 0x8000, w - 0x10000).otherwise(w)


def swap_word(word: Column) -> Column:
    w = word.cast("long").bitwiseAND(F.lit(0xFFFF))
    return F.shiftleft(w.bitwiseAND(F.lit(0xFF)), 8).bitwiseOR(F.shiftright(w, 8))


def bcd16(word: Column) -> Column:
    w = word.cast("long")
    return sum(
        (F.shiftright(w, 4 * i).bitwiseAND(F.lit(15)) * F.lit(10**i) for i in range(1, 4)), w.bitwiseAND(F.lit(15))
    )


def decode_register(reg: Column, kind: str, bit: int | None = None) -> Column:
    """uint16/word, int16, bool (any bit, or the one asked for), bcd."""
    if bit is not None:
        return bit_slice(reg, "X", bit)
    decoders = {
        "uint16": lambda r: r.cast("long").bitwiseAND(F.lit(0xFFFF)),
        "word": lambda r: r.cast("long").bitwiseAND(F.lit(0xFFFF)),
        "int16": int16,
        "bool": lambda r: r != 0,
        "bcd": bcd16,
    }
    return decoders[kind](reg)


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return a - b * F.floor(a / b)


def div_trunc(a: str, b: str) -> Column:
    """Integer division toward zero of two column names; raises on zero in ANSI mode."""
    return F.expr(f"`{a}` div `{b}`")


def checked_dint(op: str, a: Column, b: Column) -> Column:
    """32-bit ``add``, ``sub`` or ``mul`` that raises on overflow (ANSI mode)."""
    x, y = a.cast("int"), b.cast("int")
    return {"add": x + y, "sub": x - y, "mul": x * y}[op]


def array_read(values: Column, index: Column) -> Column:
    """struct(value, error): element ``index``; out of range gives the first and error."""
    bad = (index < 0) | (index >= F.size(values))
    return F.struct(F.when(bad, F.get(values, 0)).otherwise(F.get(values, index)).alias("value"), bad.alias("error"))


#: Unit to seconds.
UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "min": 60.0}


def duration_seconds(text: Column) -> Column:
    """``500ms``, ``2s``, ``1m``, ``1min`` or bare seconds; null where malformed."""
    t = F.lower(F.trim(text.cast("string")))
    p = r"^(\d+(?:\.\d+)?)\s*(ms|s|min|m)?$"
    n, unit = F.regexp_extract(t, p, 1).try_cast("double"), F.regexp_extract(t, p, 2)
    scale = F.lit(1.0)
    for name, value in UNITS.items():
        scale = F.when(unit == name, value).otherwise(scale)
    return n * scale


def time_literal_seconds(text: Column) -> Column:
    """``T#1d2h3m4s5ms``; components are integers, so a fraction's dot parts two of them."""
    body = F.lower(F.regexp_replace(text, r"(?i)^\s*(T|TIME|LT|LTIME)#", ""))
    total = F.lit(0.0)
    for unit, seconds in (("d", 86400.0), ("h", 3600.0), ("m(?!s)", 60.0), ("s", 1.0), ("ms", 0.001), ("us", 1e-6), ("ns", 1e-9)):
        n = F.regexp_extract(body, rf"(\d+){unit}", 1)
        total = total + F.when(n != "", n.cast("double") * seconds).otherwise(0.0)
    return total


def time_to_dint(seconds: Column) -> Column:
    return F.bround(seconds * 1000, 0).cast("long")


#: The built-in function table: name to an expression over its arguments.
BUILTINS = {
    **{k: (lambda x: x.cast("double")) for k in ("INT_TO_REAL", "DINT_TO_REAL", "INT_TO_LREAL", "DINT_TO_LREAL", "REAL_TO_LREAL", "LREAL_TO_REAL")},
    **{k: (lambda x: x.cast("double").cast("bigint")) for k in ("REAL_TO_INT", "REAL_TO_DINT", "LREAL_TO_INT", "LREAL_TO_DINT", "TRUNC")},
    **{k: (lambda x: x.cast("bigint")) for k in ("INT_TO_DINT", "DINT_TO_INT", "UINT_TO_UDINT", "UDINT_TO_INT", "BOOL_TO_INT", "BYTE_TO_INT", "BYTE_TO_WORD")},
    **{k: (lambda x: x.cast("bigint").bitwiseAND(F.lit(0xFF))) for k in ("INT_TO_USINT", "INT_TO_BYTE")},
    **{k: (lambda x: x.cast("bigint").bitwiseAND(F.lit(0xFFFF))) for k in ("INT_TO_UINT", "DINT_TO_WORD", "INT_TO_WORD")},
    "WORD_TO_INT": int16,
    "BYTE_TO_SINT": lambda x: F.when(x.bitwiseAND(F.lit(0x80)) != 0, x.bitwiseAND(F.lit(0xFF)) - 256).otherwise(x.bitwiseAND(F.lit(0xFF))),
    "SWAP_WORD": swap_word,
    "BCD16_TO_INT": bcd16,
    "ABS": F.abs,
    "SQR": lambda x: x * x,
    "SQRT": F.sqrt,
    "TIME_TO_DINT": time_to_dint,
    "DINT_TO_TIME": lambda x: x / 1000.0,
    "SIN": F.sin,
    "COS": F.cos,
    "TAN": F.tan,
    "ASIN": F.asin,
    "ACOS": F.acos,
    "ATAN": F.atan,
    "ATAN2": F.atan2,
    "LN": F.ln,
    "EXP": F.exp,
    "LOWER_BOUND": lambda a, dim=None: F.lit(0),
    "UPPER_BOUND": lambda a, dim=1: F.size(a) - 1 if dim == 1 else F.size(F.get(a, 0)) - 1,
    "DTL_TO_LDT": lambda ts: F.unix_micros(ts) * 1000,
    **{k: (lambda *_: F.lit(0)) for k in ("DIS_AIRT", "EN_AIRT", "RH_GETPRIMARYID", "DPWR_DAT", "DPRD_DAT", "LED", "DEVICESTATES", "MODULESTATES")},
}


def dtl(ts: Column) -> Column:
    """A timestamp as the controller's date struct; WEEKDAY 1 is Sunday."""
    return F.struct(
        F.year(ts).alias("YEAR"),
        F.month(ts).alias("MONTH"),
        F.day(ts).alias("DAY"),
        F.dayofweek(ts).alias("WEEKDAY"),
        F.hour(ts).alias("HOUR"),
        F.minute(ts).alias("MINUTE"),
        F.second(ts).alias("SECOND"),
        F.pmod(F.unix_micros(ts), F.lit(1_000_000)).__mul__(1000).alias("NANOSECOND"),
    )


def nested(json: Column, path: str) -> Column:
    """The value at a dotted path (``a.b[0].c``) of a JSON text, as text; null where a step is missing."""
    return F.get_json_object(json, f"$.{path}" if path else "$")
