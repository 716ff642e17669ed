"""Headers of blocks: keys, change log and description, from comments or from text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANGES = "array<struct<version:string,date:string,author:string,changes:string>>"
#: Keys of a header and the field that each fills.
KEYS = {
    "title": ("title",),
    "comment": ("comment", "function", "comment/function"),
    "library": ("library", "family", "library/family"),
    "author": ("author",),
    "copyright": ("copyright",),
}


def with_header(rows: DataFrame, content: Column, resource: bool = False) -> DataFrame:
    """Rows with ``title, comment, library, author, copyright, changelog`` of a header's text.

    Of a repeated key the last one stays.  Without the key, the copyright is
    that of a line ``company / (c)Copyright year``.  In a text file lines don't
    begin with ``//`` and values end at a dash.  A null text gives empty fields.
    """
    # columns of their own, so that the lines are cut once and not for each field
    split = F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " ")))
    mark = "" if resource else r"//\s*"
    separator = r"^[-+|]+$" if resource else r"^//\s*[-+]+$"
    heading = lambda x: x.contains("Change log") | x.contains("Changelog")
    staged = rows.withColumn("_header_lines", split)
    staged = staged.withColumn("_header_kept", F.filter("_header_lines", lambda x: ~x.rlike(separator) & ~heading(x)))
    lines, kept = F.col("_header_lines"), F.col("_header_kept")
    key = rf"^{mark}([\w/]+):\s*" + ("([^-]+)" if resource else "(.*)")
    out = []
    for field, names in KEYS.items():
        wanted = "^(?:" + "|".join(names) + ")$"
        hits = F.filter(kept, lambda x: F.lower(F.regexp_extract(x, key, 1)).rlike(wanted))  # noqa: B023
        out.append(F.coalesce(F.trim(F.regexp_extract(F.get(hits, F.size(hits) - 1), key, 2)), F.lit("")).alias(field))
    owner = rf"^{mark}(.+?)\s*/\s*\(?c\)?[Cc]opyright\s*(\d+)"
    owners = F.get(F.filter(kept, lambda x: x.rlike(owner)), 0)
    said = F.concat(F.lit("(c) "), F.regexp_extract(owners, owner, 2), F.lit(" "), F.trim(F.regexp_extract(owners, owner, 1)))
    out[-1] = F.when(out[-1] != "", out[-1]).otherwise(F.coalesce(said, F.lit(""))).alias("copyright")

    # rows of the change log: below its heading, in comments up to a line that isn't one
    piped, bare = r"^//\s*\|\s*([^|]+)\s*\|\s*([^|]+)\s*\|\s*([^|]+)\s*\|\s*([^|]+)", rf"^{mark}([^|]+)\s*\|\s*([^|]+)\s*\|\s*([^|]+)\s*\|\s*(.+)"
    cell = lambda x, i: F.trim(F.when(x.rlike(piped) & F.lit(not resource), F.regexp_extract(x, piped, i)).otherwise(F.regexp_extract(x, bare, i)))

    def step(acc: Column, x: Column) -> Column:
        row = F.struct(*[cell(x, i).alias(n) for i, n in enumerate(("version", "date", "author", "changes"), 1)])
        is_row = x.rlike(bare) if resource else x.rlike(piped) | x.rlike(bare)
        wanted = is_row & ~F.lower(row["version"]).isin("version", "ver.") & ~row["version"].rlike(r"^[-+ ]*$")
        ends = F.lit(False) if resource else ~is_row & (x != "") & ~x.startswith("//")
        return (
            F.when(heading(x), F.struct(F.lit(True).alias("on"), acc["rows"].alias("rows")))
            .when(x.rlike(separator) | ~acc["on"], acc)
            .when(ends, F.struct(F.lit(False).alias("on"), acc["rows"].alias("rows")))
            .when(wanted, F.struct(F.lit(True).alias("on"), F.concat(acc["rows"], F.array(row)).cast(CHANGES).alias("rows")))
            .otherwise(acc)
        )

    start = F.struct(F.lit(False).alias("on"), F.array().cast(CHANGES).alias("rows"))
    log = F.when(F.exists(lines, heading), F.aggregate(lines, start, step, lambda acc: acc["rows"])).otherwise(F.array().cast(CHANGES))
    return staged.select("*", *out, log.alias("changelog")).drop("_header_lines", "_header_kept")


def region(text: Column, name: str) -> Column:
    """What stands in the first region of a name, null without one; regions inside it stay as text."""
    found = F.regexp_extract(text, rf"(?is)^[ \t]*REGION[ \t]+{name}[ \t]*\r?\n(.*?)^[ \t]*END_REGION\b".replace("(?is)", "(?ism)"), 1)
    return F.when(found != "", found)


def description(content: Column) -> Column:
    """A description without its comment marks: of a block comment the common indent goes, of others each line's."""
    inner = F.regexp_extract(F.trim(content), r"(?s)^\s*\(\*(.*)\*\)\s*$", 1)
    lines = F.split(inner, "\n")
    later = F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: x.rlike(r"\S"))
    indent = F.coalesce(F.array_min(F.transform(later, lambda x: F.length(F.regexp_extract(x, r"^(\s*)", 1)))), F.lit(0))
    cut = F.transform(lines, lambda x, i: F.when(i == 0, F.trim(x)).when(x.rlike(r"\S"), x.substr(indent + 1, F.length(x))).otherwise(""))
    block = F.regexp_replace(F.array_join(cut, "\n"), r"^\s+|\s+\z", "")
    plain = F.filter(F.transform(F.split(content, "\n"), F.trim), lambda x: x != "")
    each = F.array_join(F.transform(plain, lambda x: F.when(x.startswith("//"), F.trim(x.substr(F.lit(3), F.length(x)))).otherwise(x)), "\n")
    return F.when(F.trim(content).rlike(r"(?s)^\s*\(\*.*\*\)\s*$"), block).otherwise(each)


def block_headers(blocks: DataFrame) -> DataFrame:
    """Blocks (path, text) with the header fields, ``description`` and ``has_header`` of their regions."""
    own, told = F.col("_header"), F.col("_told")
    found = blocks.select("*", region(F.col("text"), "Block info header").alias("_header"), region(F.col("text"), "Description").alias("_told"))
    named = with_header(found, own)
    return named.select("*", F.coalesce(description(told), F.lit("")).alias("description"), own.isNotNull().alias("has_header")).drop("_header", "_told")


def resource_headers(texts: DataFrame) -> DataFrame:
    """``(path, title, ..., changelog, description)`` of text files (path, ord, text).

    The text after one that reads ``Block info header`` or ``Description`` is
    that part; of several the last one.
    """
    w = Window.partitionBy("path").orderBy("ord")
    after = texts.select("path", "ord", F.lower("text").alias("_mark"), F.lead("text").over(w).alias("_next")).where("_next is not null")
    pick = lambda mark: F.max_by(F.when(F.col("_mark") == mark, F.col("_next")), F.when(F.col("_mark") == mark, F.col("ord")))
    parts = after.groupBy("path").agg(pick("block info header").alias("_h"), pick("description").alias("_d"))
    named = with_header(parts, F.col("_h"), True)
    return named.withColumn("description", F.coalesce(F.trim("_d"), F.lit(""))).drop("_h", "_d")
