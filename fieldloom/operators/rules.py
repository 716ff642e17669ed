"""Quality rules over fact tables, and roll-ups of what they find.

Variables are rows (block, section, is_constant, name, data_type, line), blocks
(block, block_type, text, networks), regions (block, region, content,
has_nested, line), headers (block, block_type, has_header, title, description,
changelog, author).  Every rule is an expression over one pass of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import names

#: Forms of names, bounds of numbers.
CAMEL, PASCAL, TYPE_NAME = r"^[a-z][a-zA-Z0-9]*$", r"^[A-Z][a-zA-Z0-9]*$", r"^type[A-Z][a-zA-Z0-9]*$"
SCREAMING = r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"
MOST_VARIABLES, MOST_PARAMETERS = 30, 10
PARAMETER_SECTIONS = ("VAR_INPUT", "VAR_OUTPUT", "VAR_IN_OUT")
#: Types that are no instance of a block.
PRIMITIVE = (
    "Bool", "Int", "UInt", "SInt", "USInt", "DInt", "UDInt", "LInt", "ULInt", "Real", "LReal", "Byte", "Word", "DWord", "LWord",
    "Char", "WChar", "String", "WString", "Time", "LTime", "Date", "DTL", "Struct",
)


def _hit(code: str, severity: str, when: Column, message: Column | str) -> Column:
    m = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(code).alias("rule_code"), F.lit(severity).alias("severity"), m.alias("message")))


def _rows(df: DataFrame, rules: list[Column], line: Column | None = None) -> DataFrame:
    found = F.inline(F.filter(F.array(*rules), lambda x: x.isNotNull()))
    at = F.lit(None).cast("int") if line is None else line
    out = df.select(F.col("block").alias("subject"), at.alias("line"), found)
    return out.select("rule_code", "severity", "subject", "message", "line")


def variable_rules(variables: DataFrame) -> DataFrame:
    """N001 camelCase, N004 constants, N005 instances; ``VIOLATIONS`` rows."""
    constant = F.col("is_constant") | (F.col("section") == "VAR_CONSTANT")
    kind = F.col("data_type")
    instance = (F.col("section") == "VAR") & (kind.rlike(r"^[A-Z]") | kind.startswith("_.") | kind.contains("Array")) & ~kind.isin(*PRIMITIVE)
    text = lambda what: F.concat(F.lit(f"{what} '"), "name", F.lit("'"))
    return _rows(
        variables,
        [
            _hit("N001", "WARNING", ~constant & ~F.col("name").rlike(CAMEL), text("not camelCase: variable")),
            _hit("N004", "WARNING", constant & ~F.col("name").rlike(SCREAMING), text("not SCREAMING_SNAKE_CASE: constant")),
            _hit("N005", "WARNING", F.coalesce(instance, F.lit(False)) & ~F.col("name").rlike(CAMEL), text("not camelCase: instance")),
        ],
        F.col("line"),
    )


def block_name_rules(blocks: DataFrame) -> DataFrame:
    """N002 names of types, N003 names of functions."""
    name, kind = F.col("block"), F.col("block_type")
    return _rows(
        blocks,
        [
            _hit("N002", "WARNING", (kind == "TYPE") & ~name.rlike(TYPE_NAME), "type without the prefix type"),
            _hit("N003", "WARNING", kind.isin("FUNCTION", "FUNCTION_BLOCK") & ~name.rlike(PASCAL), "name is not PascalCase"),
        ],
    )


def suggested_type(name: Column) -> Column:
    bare = F.when(F.lower(name).startswith("type"), F.substr(name, F.lit(5))).otherwise(name)
    parts = F.transform(F.split(F.lower(bare), "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    first = F.concat(F.upper(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2)))
    return F.concat(F.lit("type"), F.when(bare.contains("_"), F.array_join(parts, "")).otherwise(first))


def count_rules(variables: DataFrame) -> DataFrame:
    """C004 too many variables, C005 too many parameters of a block."""
    n, p = F.col("variables"), F.col("parameters")
    counted = variables.groupBy("block").agg(F.count("*").alias("variables"), F.count_if(F.col("section").isin(*PARAMETER_SECTIONS)).alias("parameters"))
    return _rows(
        counted,
        [
            _hit("C004", "INFO", n > MOST_VARIABLES, F.concat(n.cast("string"), F.lit(" variables"))),
            _hit("C005", "WARNING", p > MOST_PARAMETERS, F.concat(p.cast("string"), F.lit(" parameters"))),
        ],
    )


def header_rules(headers: DataFrame) -> DataFrame:
    """D001 to D005; types have no header."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    has = F.coalesce(F.col("has_header"), F.lit(False))
    return _rows(
        headers.where("block_type <> 'TYPE'"),
        [
            _hit("D001", "ERROR", ~has, "no block info header"),
            _hit("D002", "ERROR", has & blank("title"), "header without a title"),
            _hit("D003", "WARNING", blank("description"), "no description"),
            _hit("D004", "INFO", has & blank("changelog"), "header without a changelog"),
            _hit("D005", "INFO", has & blank("author"), "header without an author"),
        ],
    )


def region_rules(regions: DataFrame) -> DataFrame:
    """B005 empty regions, D006 an empty description."""
    name = F.lower("region")
    empty = F.regexp_replace("content", r"""S7_MLC|:=|[{}"']""", "").rlike(r"^\s*$")
    bare = F.coalesce("content", F.lit("")).rlike(r"^\s*$")
    described = name.isin("block info header", "description")
    return _rows(
        regions,
        [
            _hit("B005", "INFO", ~described & bare & ~F.col("has_nested"), F.concat(F.lit("empty region "), F.col("region"))),
            _hit("D006", "WARNING", (name == "description") & F.coalesce(empty, F.lit(True)), "empty description region"),
        ],
        F.col("line"),
    )


def section_rules(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """S004 blocks (networks) without a network, S005 sections (block, section, variables) without a variable."""
    nets = _rows(blocks, [_hit("S004", "WARNING", (F.col("block_type") != "TYPE") & (F.col("networks") == 0), "no NETWORK section")])
    empty = _rows(sections, [_hit("S005", "INFO", F.col("variables") == 0, F.concat(F.lit("empty "), "section"))])
    return nets.union(empty)


def unused_variables(variables: DataFrame, blocks: DataFrame) -> DataFrame:
    """B002: variables that the text of their block never names; outputs and constants may be unused.

    Words of a text are taken once, so a block's variables are looked up by an equi-join.
    """
    words = blocks.select("block", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("name"))
    asked = variables.where(~F.col("is_constant") & ~F.col("section").isin("VAR_CONSTANT", "VAR_OUTPUT"))
    unused = asked.join(words, ["block", "name"], "left_anti")
    return _rows(unused, [_hit("B002", "WARNING", F.lit(True), F.concat(F.lit("never used: "), "name"))], F.col("line"))


def hardcoded_indices(blocks: DataFrame) -> DataFrame:
    """B003: each number but 1 that stands as an index, once a block."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\s*(\d+)\s*\]"), F.lit(1)))
    rows = blocks.select("block", F.explode(found).alias("index")).where("index <> '1'")
    return _rows(rows, [_hit("B003", "INFO", F.lit(True), F.concat(F.lit("hardcoded index "), "index"))])


def violation_counts(violations: DataFrame, by: str = "rule_code") -> DataFrame:
    """``(by, violations, subjects)``."""
    return violations.groupBy(by).agg(F.count("*").alias("violations"), F.count_distinct("subject").alias("subjects"))


def violation_summary(violations: DataFrame) -> DataFrame:
    """One row: total, errors, warnings, infos, subjects with errors; ``violation_counts`` has the counts by rule."""
    s = F.col("severity")
    return violations.agg(
        F.count("*").alias("total"),
        *[F.count_if(s == k).alias(a) for k, a in (("ERROR", "errors"), ("WARNING", "warnings"), ("INFO", "infos"))],
        F.count_distinct(F.when(s == "ERROR", F.col("subject"))).alias("subjects_with_errors"),
    )


def filter_violations(violations: DataFrame, severity: str | None = None, rule: str | None = None, subject: str | None = None) -> DataFrame:
    for column, value in (("severity", severity), ("rule_code", rule), ("subject", subject)):
        if value is not None:
            violations = violations.where(F.col(column) == value)
    return violations


def passed(subjects: DataFrame, violations: DataFrame, key: str = "block") -> DataFrame:
    """``(key, passed)``: no violation of severity ERROR."""
    bad = violations.where("severity = 'ERROR'").select(F.col("subject").alias(key)).distinct().withColumn("_bad", F.lit(True))
    return subjects.select(key).join(bad, key, "left").select(key, F.col("_bad").isNull().alias("passed"))


#: Instructions that are written without quotes.
SYSTEM_INSTRUCTIONS = (
    "Add", "Sub", "Mul", "Div", "Mod", "Move", "Neg", "Abs", "Coil", "Contact", "SetCoil", "ResetCoil", "JumpCoil", "Label",
    "RD_ARRAY_DI", "WR_ARRAY_DI", "RD_ARRAY_I", "WR_ARRAY_I",
    "GT_Contact", "LT_Contact", "GE_Contact", "LE_Contact", "EQ_Contact", "NE_Contact",
)
SECTION = r"^\s*(VAR_INPUT|VAR_OUTPUT|VAR_IN_OUT|VAR_TEMP|VAR|END_VAR)\s*$"


def safety_findings(files: DataFrame) -> DataFrame:
    """``(path, line, code, severity)`` of texts (path, text): S001 S002 S003 S007 S008 S009, by line, then code."""
    safety = F.col("text").rlike(r'(?i)S7_Safety\s*:=\s*"TRUE"')
    lines = files.select("path", safety.alias("safety"), F.posexplode(F.split("text", "\r?\n")).alias("i", "line"))
    # the section a line is in: that of the last section line above it in its file
    marked = files.select("path", F.split("text", "\r?\n").alias("l"))
    inside = F.aggregate(
        "l",
        F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("all")),
        lambda acc, x: F.struct(
            F.when(x.rlike(SECTION), F.regexp_extract(x, SECTION, 1)).otherwise(acc["now"]).alias("now"),
            F.concat(acc["all"], F.array(acc["now"])).alias("all"),
        ),
        lambda acc: acc["all"],
    )
    sections = marked.select("path", F.posexplode(inside).alias("i", "section"))
    x = lines.join(sections, ["path", "i"])
    line, section = F.col("line"), F.col("section")
    call = r'^\s*("?)([A-Za-z_]\w*)\1\(\s*$'
    unquoted = line.rlike(call) & (F.regexp_extract(line, call, 1) == "") & ~F.regexp_extract(line, call, 2).isin(*SYSTEM_INSTRUCTIONS)
    rules = F.array(
        F.when(line.rlike(r"^\s*TITLE\s*="), F.struct(F.lit("S001").alias("code"), F.lit("ERROR").alias("severity"))),
        F.when(
            ~section.isin("", "END_VAR") & line.rlike(r"^\s+\w+\s*:\s*(?:DInt|Int|DWord|Word|Bool|Time|Real)\s*:="),
            F.struct(F.lit("S002").alias("code"), F.lit("ERROR").alias("severity")),
        ),
        F.when(F.col("safety") & line.rlike(r":\s*Struct\b"), F.struct(F.lit("S003").alias("code"), F.lit("ERROR").alias("severity"))),
        F.when(unquoted, F.struct(F.lit("S007").alias("code"), F.lit("WARNING").alias("severity"))),
        F.when(
            line.rlike(r"^\s+\w+\s*:\s*Array\[\*\]") & (section != "VAR_IN_OUT"), F.struct(F.lit("S009").alias("code"), F.lit("ERROR").alias("severity"))
        ),
    )
    by_line = x.select("path", (F.col("i") + 1).alias("line"), F.inline(F.filter(rules, lambda r: r.isNotNull())))
    both = read_and_written(files.where(safety)).select("path", F.lit(None).cast("int").alias("line"), F.lit("S008").alias("code"), F.lit("ERROR").alias("severity"))
    return by_line.union(both).orderBy("path", F.coalesce("line", F.lit(0)), "code")


def read_and_written(files: DataFrame) -> DataFrame:
    """``(path, operand)`` of operands that a text both reads and writes."""

    def operands(pattern: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        return F.transform(found, lambda m: F.concat(F.regexp_extract(m, r'"(\w+)"\.(\w+)', 1), F.lit("."), F.regexp_extract(m, r'"(\w+)"\.(\w+)', 2)))

    read, written = operands(r'(?::=\s*|Contact\(\s*)"\w+"\.\w+'), operands(r'(?:=>\s*|Coil\(\s*)"\w+"\.\w+')
    return files.select("path", F.explode(F.array_sort(F.array_intersect(read, written))).alias("operand"))


def resource_pairs(pairs: DataFrame) -> DataFrame:
    """``(path, code, severity, id)`` of blocks and their texts (path, block_text, res_text): S005, S006."""
    used = F.array_distinct(F.regexp_extract_all("block_text", F.lit(r'S7_(?:BlockTitle|NetworkTitle|NetworkComment|BlockComment)\s*:=\s*"(MLC_\w+)"'), F.lit(1)))
    lines = F.split(F.coalesce("res_text", F.lit("")), "\r?\n")
    declaration = r"^\s*-\s*id:\s*(MLC_\w+)\s*$"
    declared = F.array_distinct(F.transform(F.filter(lines, lambda x: x.rlike(declaration)), lambda x: F.regexp_extract(x, declaration, 1)))
    loose = F.filter(lines, lambda x: ~x.rlike(declaration) & F.regexp_extract(x, r"^\s*[\w-]+:\s*(.*)$", 1).contains(": ") & ~F.regexp_extract(x, r"^\s*[\w-]+:\s*(.*)$", 1).startswith('"'))
    without = F.col("res_text").isNull()
    item = lambda code, severity: lambda x: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), x.alias("id"))
    none = F.array().cast("array<struct<code:string,severity:string,id:string>>")
    missing = F.when(without, F.when(F.size(used) > 0, F.array(item("S005", "ERROR")(F.lit("no file")))).otherwise(none)).otherwise(
        F.concat(
            F.transform(loose, item("S006", "ERROR")),
            F.transform(F.array_sort(F.array_except(used, declared)), item("S005", "ERROR")),
            F.transform(F.array_sort(F.array_except(declared, used)), item("S005", "WARNING")),
        )
    )
    return pairs.select("path", F.inline(missing))
