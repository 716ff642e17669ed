"""Controller addresses and I/O type names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Areas of the file notation, to those of the controller.
IOL_AREAS = {"PEW": "IW", "PAW": "QW", "EW": "IW", "AW": "QW", "MW": "MW", "E": "I", "A": "Q", "M": "M"}
#: Areas of the controller, to those that files are written with.
S7_AREAS = {"I": "E", "Q": "A", "M": "M", "IW": "PEW", "QW": "PAW", "MW": "MW"}
#: Names of data types, lower case.
DATA_TYPES = {
    "bool": "Bool", "boolean": "Bool", "int": "Int", "integer": "Int", "dint": "DInt", "real": "Real", "float": "Real",
    "word": "Word", "dword": "DWord", "string": "String", "time": "Time", "date": "Date", "tod": "TOD", "dt": "DT",
}
#: Areas of device registers; those whose registers have bits come first.
REGISTER_AREAS = ("HOLDING", "INPUT", "COIL", "DISCRETE")
#: I/O categories in priority order.
CATEGORIES = ("SDI", "SDO", "SAI", "SAO", "DI", "DO", "AI", "AO")
#: Storage bits of elementary types.
TYPE_BITS = {
    "bool": 1, "byte": 8, "char": 8, "sint": 8, "usint": 8, "word": 16, "int": 16, "uint": 16, "wchar": 16, "date": 16,
    "dword": 32, "dint": 32, "udint": 32, "real": 32, "time": 32, "time_of_day": 32, "lword": 64, "lint": 64, "ulint": 64,
    "lreal": 64, "ltime": 64, "ldt": 64, "date_and_time": 64, "dtl": 96,
}


def _lookup(key: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


NUMBER = r"\s*([+-]?\d+)\s*"


def _address(text: Column, words: str, bits: str, areas: dict[str, str] | None = None) -> Column:
    """A word area and a number, else a bit area with ``byte.bit`` or a byte alone; null if neither."""

    def area(name: Column) -> Column:
        return _lookup(name, areas) if areas else name

    def found(pattern: str, bit: bool = False) -> Column:
        g = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)[: 2 + bit]]
        number = [x.try_cast("int") for x in g[1:]]
        last = number[1] if bit else F.lit(None).cast("int")
        whole = F.struct(area(g[0]).alias("address_type"), number[0].alias("byte_address"), last.alias("bit_address"))
        return F.when(text.rlike(pattern) & number[0].isNotNull(), whole)

    word = F.when(text.rlike(rf"^(?:{words})"), found(rf"^({words}){NUMBER}$"))
    bit = F.coalesce(found(rf"^({bits}){NUMBER}\.{NUMBER}$", True), found(rf"^({bits}){NUMBER}$"))
    return F.when(text.rlike(rf"^(?:{words})"), word).otherwise(bit)


def parse_s7(address: Column) -> Column:
    """``%I1.0``, ``%QW70``, ``%PIW3``, ``%I1`` to struct(address_type, byte_address, bit_address), else null."""
    return _address(F.regexp_replace(F.upper(F.trim(address)), "^%+", ""), "IW|QW|MW|PIW|PQW", "[IQM](?![WD])")


def parse_iol(address: Column) -> Column:
    """``E 1.0``, ``PEW 100``, ``A2.1``, ... to the same struct."""
    return _address(F.upper(F.trim(address)), "PEW|PAW|EW|AW|MW", "[EAM]", IOL_AREAS)


def in_range(address: Column) -> Column:
    """A strict check that parsing leaves out: no negative byte, a bit from 0 to 7."""
    return (address["byte_address"] >= 0) & F.coalesce(address["bit_address"].between(0, 7), F.lit(True))


def format_s7(address: Column) -> Column:
    return F.concat(
        F.lit("%"),
        address["address_type"],
        address["byte_address"].cast("string"),
        F.coalesce(F.concat(F.lit("."), address["bit_address"].cast("string")), F.lit("")),
    )


def format_iol(address: Column) -> Column:
    return F.concat(
        F.coalesce(_lookup(address["address_type"], S7_AREAS), address["address_type"]),
        F.lit(" "),
        address["byte_address"].cast("string"),
        F.coalesce(F.concat(F.lit("."), address["bit_address"].cast("string")), F.lit("")),
    )


def data_type(value: Column) -> Column:
    """Canonical type name; Bool where unknown."""
    return F.coalesce(_lookup(F.lower(F.trim(value)), DATA_TYPES), F.lit("Bool"))


def io_category(mnemonic: Column) -> Column:
    """DI, DO, AI, AO or a safety variant from the text before the first ``_``, else null."""
    got = F.regexp_extract(F.upper(mnemonic), r"^(S?[DA][IO])_", 1)
    return F.when(got != "", got)


def is_safety(mnemonic: Column) -> Column:
    return F.coalesce(io_category(mnemonic).startswith("S"), F.lit(False))


def type_bits(name: Column) -> Column:
    return _lookup(F.lower(F.trim(name)), TYPE_BITS)


def register_address(spec: Column) -> Column:
    """``AREA:N`` or ``AREA:N/B`` to struct(area, address, bit); null where malformed.

    Bits are 0 to 15 and only those of holding and input registers.
    """
    p = r"^([A-Z]+):(\d+)(?:/(\d+))?$"
    s = F.trim(spec)
    area, n, b = F.regexp_extract(s, p, 1), F.regexp_extract(s, p, 2).try_cast("long"), F.regexp_extract(s, p, 3)
    bit = b.try_cast("int")
    ok = area.isin(*REGISTER_AREAS) & n.isNotNull() & ((b == "") | (bit.between(0, 15) & area.isin(*REGISTER_AREAS[:2])))
    return F.when(ok, F.struct(area.alias("area"), n.alias("address"), bit.alias("bit")))
