"""Measures and rules over program text, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that open one more path through a block.
BRANCHES = ("if", "elsif", "for", "while", "repeat", "and", "or")
OPENERS = r"(?i)^\s*(IF|CASE|FOR|WHILE|REPEAT|REGION)\b"
CLOSERS = r"(?i)^\s*(END_IF|END_CASE|END_FOR|END_WHILE|UNTIL|END_REGION)\b"


def without_comments(text: Column) -> Column:
    """Block comments and line comments dropped, line feeds inside them kept out of nothing."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\(\*.*?\*\)", " "), r"//[^\n]*", "")


def line_counts(text: Column) -> list[Column]:
    """``total_lines`` and ``code_lines``, lines that aren't blank."""
    lines = F.split(text, "\n")
    return [
        F.size(lines).cast("long").alias("total_lines"),
        F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("code_lines"),
    ]


def keyword_complexity(text: Column) -> Column:
    """1 and the branch words of a text."""
    return (F.lit(1) + F.regexp_count(text, F.lit(rf"(?i)\b({'|'.join(BRANCHES)})\b"))).cast("long")


def complexity(text: Column) -> Column:
    """Cyclomatic complexity of controller code: branch words, and case labels but one, comments left out."""
    code = without_comments(text)
    labels = F.regexp_count(code, F.lit(r"(?m)^\s*[\w#\".]+(?:\s*(?:,|\.\.)\s*[\w#\".]+)*\s*:(?!=)"))
    inside = code.rlike(r"(?i)\bCASE\b")
    return keyword_complexity(code) + F.when(inside, F.greatest(labels - 1, F.lit(0))).otherwise(0)


def nesting_depth(text: Column) -> Column:
    """Deepest nesting: a fold over lines that never goes below zero, which a running sum can't."""
    return F.aggregate(
        F.split(without_comments(text), "\n"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")),
        lambda acc, line: F.when(
            line.rlike(CLOSERS), F.struct(F.greatest(acc["d"] - 1, F.lit(0)).alias("d"), acc["m"].alias("m"))
        )
        .when(line.rlike(OPENERS), F.struct((acc["d"] + 1).alias("d"), F.greatest(acc["m"], acc["d"] + 1).alias("m")))
        .otherwise(acc),
        lambda acc: acc["m"],
    )


def unbalanced(texts: DataFrame, key: str, text: Column, opened: str, closed: str) -> DataFrame:
    """``(key, opened, closed)`` of texts in which two patterns differ in number."""
    o, c = F.regexp_count(text, F.lit(opened)).cast("long"), F.regexp_count(text, F.lit(closed)).cast("long")
    return texts.select(key, o.alias("opened"), c.alias("closed")).where("opened <> closed")


#: Rules of balanced keywords.
BALANCE = {
    "S001": (r"(?im)^\s*REGION\b", r"(?im)^\s*END_REGION\b"),
    "S002": (r"(?i)(?<![_\w])IF\b", r"(?i)\bEND_IF\b"),
    "S003": (r"(?i)(?<![_\w])CASE\b", r"(?i)\bEND_CASE\b"),
}
#: Functions that have a newer form.
DEPRECATED = ("ADD_TIME", "SUB_TIME", "CONCAT")


def rule_violations(blocks: DataFrame) -> DataFrame:
    """``VIOLATIONS`` rows of blocks (block, block_type, text): size, structure, numbers, defaults.

    Every rule is an expression over one pass of the table.
    """
    code = without_comments(F.col("text"))
    c, n = complexity(F.col("text")), nesting_depth(F.col("text"))
    lines = F.size(F.filter(F.split(code, "\n"), lambda x: F.trim(x) != ""))
    magic = F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?::=|[<>=+*/-])\s*(\d{2,}(?:\.\d+)?)\b"), F.lit(1)))

    def hit(code_: str, severity: str, when: Column, message: Column | str) -> Column:
        m = F.lit(message) if isinstance(message, str) else message
        return F.when(when, F.struct(F.lit(code_).alias("rule_code"), F.lit(severity).alias("severity"), m.alias("message")))

    rules = [
        hit("C001", "WARNING", c > 10, F.concat(F.lit("complexity "), c.cast("string"))),
        hit("C002", "WARNING", n > F.when(F.col("block_type") == "ORGANIZATION_BLOCK", 7).otherwise(4), F.concat(F.lit("nesting "), n.cast("string"))),
        hit("C003", "WARNING", lines > 500, F.concat(F.lit("code lines "), lines.cast("string"))),
        hit("B001", "INFO", F.size(magic) > 0, F.concat(F.lit("numbers "), F.array_join(magic, ","))),
        hit("B004", "WARNING", code.rlike(r"(?i)\bCASE\b") & ~code.rlike(r"(?im)^\s*ELSE\b"), "CASE without ELSE"),
        hit("B006", "WARNING", code.rlike(rf"(?i)\b({'|'.join(DEPRECATED)})\b"), "deprecated function"),
        hit("N003", "WARNING", F.col("block_type").isin("FUNCTION", "FUNCTION_BLOCK") & ~F.col("block").rlike(r"^[A-Z][A-Za-z0-9]*$"), "name is not PascalCase"),
    ]
    for rule, (opened, closed) in BALANCE.items():
        rules.append(
            hit(rule, "ERROR", F.regexp_count(code, F.lit(opened)) != F.regexp_count(code, F.lit(closed)), "unbalanced keywords")
        )
    found = blocks.select(F.col("block").alias("subject"), F.inline(F.filter(F.array(*rules), lambda x: x.isNotNull())))
    return found.select("rule_code", "severity", "subject", "message", F.lit(None).cast("int").alias("line"))


def byte_findings(files: DataFrame) -> DataFrame:
    """``(path, rule_code)`` of binary contents: no byte-order mark, bare line feeds, not UTF-8."""
    h = F.hex("content")
    rules = F.array(
        F.when(~h.startswith("EFBBBF"), "F001"),
        F.when(h.rlike(r"^(?:..)*?(?<!0D)0A"), "F002"),
        F.when(~F.is_valid_utf8(F.col("content").cast("string")), "F003"),
    )
    return files.select("path", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule_code"))


#: A reference to a field of a data block.
DB_REF = r'"([A-Za-z_]\w*)"((?:\.(?:"[^"]+"|\w+)(?:\[[^\]]*\])?)+)'


def db_references(blocks: DataFrame) -> DataFrame:
    """``(block_name, db_name, field_path, full_reference, line_number, is_write)``.

    One row a block and reference, at its first line; a reference that is
    assigned anywhere in a block counts as written only.
    """
    lines = blocks.select("block", F.posexplode(F.split(without_comments(F.col("text")), "\n")).alias("i", "line"))
    refs = lines.select("block", "i", "line", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(DB_REF), F.lit(0)))).alias("ref"))
    ref = F.regexp_replace("ref", r"\s+", "")
    written = F.trim("line").startswith(F.col("ref")) & F.regexp_replace(F.substr(F.trim("line"), F.length("ref") + 1), r"\s", "").startswith(":=")
    grouped = refs.groupBy("block", ref.alias("full_reference")).agg(
        (F.min("i") + 1).alias("line_number"), F.bool_or(written).alias("is_write")
    )
    return grouped.select(
        F.col("block").alias("block_name"),
        F.regexp_extract("full_reference", r'^"([^"]+)"', 1).alias("db_name"),
        F.regexp_extract("full_reference", r'^"[^"]+"\.(.*)$', 1).alias("field_path"),
        "full_reference",
        "line_number",
        "is_write",
    )


#: Families of call patterns, first wins.
CALL_PATTERNS = (
    ("instance_db", r'"([A-Za-z_]\w*)"\s*\('),
    ("instance", r"#([A-Za-z_]\w*)\s*\("),
    ("function", r"(?<![\w#\".])([A-Za-z_]\w*)\s*\("),
)
#: Words before a parenthesis that are no calls.
NOT_CALLS = ("IF", "ELSIF", "WHILE", "UNTIL", "CASE", "FOR", "AND", "OR", "NOT", "XOR", "MOD", "RETURN", "TO", "OF", "BY", "DO", "THEN")


def calls(blocks: DataFrame) -> DataFrame:
    """``(caller, callee, call_type, line_number)``, one row a pair, by the first family that finds it."""
    lines = blocks.select("block", F.posexplode(F.split(without_comments(F.col("text")), "\n")).alias("i", "line"))
    found = None
    for rank, (kind, pattern) in enumerate(CALL_PATTERNS):
        part = lines.select(
            F.col("block").alias("caller"),
            F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(1))).alias("callee"),
            F.lit(kind).alias("call_type"),
            F.lit(rank).alias("rank"),
            (F.col("i") + 1).alias("line_number"),
        )
        found = part if found is None else found.union(part)
    found = found.where(~F.upper("callee").isin(*NOT_CALLS))
    best = found.groupBy("caller", "callee").agg(F.min(F.struct("rank", "line_number", "call_type")).alias("b"))
    return best.select("caller", "callee", "b.call_type", "b.line_number")


#: Endings of instance names, tried in this order.
INSTANCE_ENDINGS = ("Instance", "Data", "Inst", "DB")


def resolve_callees(found: DataFrame, known: DataFrame) -> DataFrame:
    """Calls with ``resolved``: the callee, or it without an instance ending, if that is a known block (block)."""
    names_ = [F.struct(F.lit(0).alias("rank"), F.col("callee").alias("name"))]
    for i, end in enumerate(INSTANCE_ENDINGS):
        stem = F.expr(f"substring(callee, 1, length(callee) - {len(end)})")
        names_.append(F.when(F.col("callee").endswith(end), F.struct(F.lit(i + 1).alias("rank"), stem.alias("name"))))
    tried = found.select("caller", "callee", F.inline(F.filter(F.array(*names_), lambda x: x.isNotNull())))
    hits = tried.join(known.select(F.col("block").alias("name")), "name").groupBy("caller", "callee").agg(F.min_by("name", "rank").alias("resolved"))
    return found.join(hits, ["caller", "callee"], "left")


def layout_offsets(members: DataFrame, key: str = "block") -> DataFrame:
    """``(block, path, byte_offset, bit_offset, size_bits)`` of members (ord, path, size_bits) of standard access.

    Bits pack into a byte; bytes follow the last started one; anything of two
    bytes or more starts at an even byte.  An ordered fold a block.
    """
    rows = members.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "path", "size_bits"))).alias("m"))
    state = "struct<at:int,out:array<struct<path:string,byte_offset:int,bit_offset:int,size_bits:int>>>"

    def step(acc: Column, x: Column) -> Column:
        bits = x["size_bits"]
        byte_up = (F.ceil(acc["at"] / 8) * 8).cast("int")
        word_up = (F.ceil(acc["at"] / 16) * 16).cast("int")
        at = F.when(bits == 1, acc["at"]).when(bits <= 8, byte_up).otherwise(word_up)
        item = F.struct(
            x["path"].alias("path"), F.floor(at / 8).cast("int").alias("byte_offset"), (at % 8).cast("int").alias("bit_offset"), bits.cast("int").alias("size_bits")
        )
        return F.struct((at + bits).cast("int").alias("at"), F.concat(acc["out"], F.array(item)).alias("out")).cast(state)

    start = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(state)
    return rows.select(key, F.inline(F.aggregate("m", start, step)["out"]))
