"""Import checks of program and tag files: form of the bytes, header of the block, tag tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import corpus, rules

KINDS = "FUNCTION_BLOCK|FUNCTION|ORGANIZATION_BLOCK|DATA_BLOCK|TYPE"
CODE_KINDS = ("FUNCTION_BLOCK", "FUNCTION", "ORGANIZATION_BLOCK")
FINDINGS = "array<struct<line:int,code:string,severity:string>>"


def masked(text: Column) -> Column:
    """Comments and quoted texts as blanks of the same length, line feeds kept.

    A fold over the pieces that a scan from the left finds: quoted text,
    comments, and what stands between them.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"""(?s)'[^']*(?:'|$)|"[^"]*(?:"|$)|//[^\n]*|\(\*.*?(?:\*\)|$)|[^'"/(]+|."""), F.lit(0))
    hidden = lambda x: x.rlike(r"""^(?:'|"|//|\(\*)""")
    return F.array_join(F.transform(pieces, lambda x: F.when(hidden(x), F.regexp_replace(x, r"[^\n]", " ")).otherwise(x)), "")


def _line(before: Column) -> Column:
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def headers(files: DataFrame) -> DataFrame:
    """``(path, text, masked, blocks, kind, name, line, second_line, pragma)`` of texts (path, text).

    ``kind`` is null without a block.  Keywords in comments or quoted texts
    don't count; a type's name is that before ``: STRUCT``.
    """
    m = files.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("masked", masked(F.col("text")))
    # the masked text cut before each keyword; the pieces' lengths give the places
    parts = F.split("masked", rf"(?m)(?=^[ \t]*(?:{KINDS})\b)")
    ends = F.aggregate(
        parts,
        F.array().cast("array<int>"),
        lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + F.length(x))),
    )
    m = m.select("*", parts.alias("_p"), ends.alias("_e"))
    begins = F.transform(
        "_p", lambda x, i: F.when(x.rlike(rf"^[ \t]*(?:{KINDS})\b"), F.get("_e", i) - F.length(x))
    )
    m = m.select("path", "text", "masked", F.filter(begins, lambda x: x.isNotNull()).alias("_s"))
    # blank lines above a keyword belong to it
    above = lambda i: F.regexp_replace(F.col("text").substr(F.lit(1), F.get("_s", i)), r"(^|\n)\s*\z", "$1")
    first = F.get("_s", 0)
    rest, plain = F.col("text").substr(first + 1, F.length("text")), F.col("masked").substr(first + 1, F.length("text"))
    start = rf'^\s*({KINDS})\b\s*(?:"([^"]+)"|([A-Za-z_]\w*))?'
    kind = F.regexp_extract(rest, start, 1)
    quoted, bare = F.regexp_extract(rest, start, 2), F.regexp_extract(rest, start, 3)
    struct = F.regexp_extract(plain, r"(?m)^\s*([A-Za-z_]\w*)\s*:\s*STRUCT\b", 1)
    name = F.when((kind == "TYPE") & (struct != ""), struct).when(quoted != "", quoted).otherwise(bare)
    pragma = F.regexp_extract_all(above(0), F.lit(r'(S7_\w+)\s*:=\s*"[^"]*"'), F.lit(1))
    return m.select(
        "path",
        "text",
        "masked",
        F.size("_s").alias("blocks"),
        F.when(first.isNotNull(), kind).alias("kind"),
        F.when(first.isNotNull(), name).alias("name"),
        _line(above(0)).alias("line"),
        _line(above(1)).alias("second_line"),
        F.coalesce(pragma, F.array().cast("array<string>")).alias("pragma"),
    )


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def text_findings(files: DataFrame) -> DataFrame:
    """``(path, line, code, severity)``: F010 alone, else F011 F012 F020 F021, of texts (path, text)."""
    h = headers(files)
    outside = F.col("masked").rlike(r"(?m)^\s*TITLE\s*=") | F.col("masked").rlike(r"(?m)^\s*BEGIN\s*$") | F.col("masked").rlike(r"\{[^}]*S7_Optimized_Access[^}]*\}")
    has = lambda key: F.array_contains("pragma", key)
    none = F.lit(None).cast("int")

    def finding(when: Column, code: str, severity: str, line: Column) -> Column:
        return F.when(when, F.struct(line.alias("line"), F.lit(code).alias("code"), F.lit(severity).alias("severity")))

    there = F.col("kind").isNotNull()
    inside = F.array(
        finding(F.col("blocks") > 1, "F011", "ERROR", F.col("second_line")),
        finding(there & (F.col("name") != "") & (F.col("name") != stem(F.col("path"))), "F012", "ERROR", F.col("line")),
        finding(F.col("kind").isin(*CODE_KINDS) & ~has("S7_EditorMode") & ~has("S7_PreferredLanguage"), "F020", "ERROR", F.col("line")),
        finding((F.col("kind") == "DATA_BLOCK") & ~has("S7_StandardRetain"), "F020", "ERROR", F.col("line")),
        finding(there & (F.col("kind") != "TYPE") & ~has("S7_Optimized"), "F021", "WARNING", F.col("line")),
    )
    alone = F.array(finding(F.lit(True), "F010", "ERROR", none))
    found = F.filter(F.when(outside, alone).otherwise(inside), lambda x: x.isNotNull())
    return h.select("path", F.inline(found.cast(FINDINGS)))


def xml_findings(files: DataFrame) -> DataFrame:
    """``(path, line, code, severity)``: F030 and F031 of XML texts (path, text).

    A file below a folder ``PLC tags`` has to be a tag table; a tag table needs
    the version of its ``Engineering`` element.  Both are known by their tags in
    the text, as XPath functions raise on malformed texts.
    """
    parsed = F.from_xml(F.regexp_replace("text", r"^\s*<\?xml.*?\?>", ""), "_bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    x = files.select("path", "text", F.exists(F.split("path", "/"), lambda p: F.lower(p) == "plc tags").alias("under"), parsed.alias("_x"))
    broken = F.col("_x").isNull() | F.col("_x._bad").isNotNull()
    table = F.col("text").rlike(r"<SW\.Tags\.PlcTagTable[\s/>]")
    version = F.col("text").rlike(r"""<Engineering\s(?:[^>]*\s)?version\s*=\s*(?:"[^"]|'[^'])""")
    bad = broken | ~table | ~version
    hard = F.col("under") | (~broken & table)
    return x.where(bad).select(
        "path",
        F.lit(None).cast("int").alias("line"),
        F.when(hard, "F030").otherwise("F031").alias("code"),
        F.when(hard, "ERROR").otherwise("WARNING").alias("severity"),
    )


def file_findings(files: DataFrame) -> DataFrame:
    """``(path, line, code, severity)`` of all checks of binary files (path, content).

    Bytes that aren't UTF-8 (F003) end a file's checks.  ``.s7res`` files are
    only read as the companions of blocks.
    """
    shown = files.where(~F.col("path").endswith(".s7res"))
    raw = corpus.byte_findings(shown)
    unreadable = raw.where("rule_code = 'F003'").select("path")
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", "")
    # the first line that ends without a carriage return
    where = shown.select("path", _line(F.regexp_extract(text, r"(?s)^(.*?)(?<!\r)\n", 1)).alias("_first"))
    by_bytes = raw.join(where, "path").select(
        "path", F.when(F.col("rule_code") == "F002", F.col("_first")).alias("line"), F.col("rule_code").alias("code"), F.lit("ERROR").alias("severity")
    )
    readable = files.join(unreadable, "path", "left_anti").select("path", text.alias("text"))
    xml = F.lower("path").endswith(".xml")
    blocks = readable.where(~xml & ~F.col("path").endswith(".s7res"))
    texts = readable.where(F.col("path").endswith(".s7res")).select(F.regexp_replace("path", r"\.s7res$", "").alias("_stem"), F.col("text").alias("res_text"))
    pairs = blocks.select("path", F.col("text").alias("block_text"), F.regexp_replace("path", r"\.[^./]*$", "").alias("_stem")).join(texts, "_stem", "left")
    resources = rules.resource_pairs(pairs).select("path", F.lit(None).cast("int").alias("line"), "code", "severity")
    return (
        by_bytes.unionByName(xml_findings(readable.where(xml)))
        .unionByName(text_findings(blocks))
        .unionByName(rules.safety_findings(blocks))
        .unionByName(resources)
    )
