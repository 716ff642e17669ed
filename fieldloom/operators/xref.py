"""Cross-references: who reads and writes what, audits, path joins, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import names


def readers_writers(accesses: DataFrame, var: str, block: str, is_write: Column) -> DataFrame:
    """``(var, writers, readers)``: distinct blocks on either side."""
    return accesses.groupBy(F.col(var).alias("var")).agg(
        F.count_distinct(F.when(is_write, F.col(block))).alias("writers"),
        F.count_distinct(F.when(~is_write, F.col(block))).alias("readers"),
    )


def audit(rw: DataFrame) -> DataFrame:
    """``(rule, var)``: several writers, written only, read only; one pass over the roll-up."""
    rules = F.array(
        F.when(F.col("writers") > 1, F.lit("GV001")),
        F.when((F.col("writers") > 0) & (F.col("readers") == 0), F.lit("GV003")),
        F.when((F.col("readers") > 0) & (F.col("writers") == 0), F.lit("GV004")),
    )
    return rw.select(F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"), "var")


def repeated_writes(accesses: DataFrame, var: str, block: str, is_write: Column) -> DataFrame:
    return (
        accesses.where(is_write)
        .groupBy(F.col(var).alias("var"), F.col(block).alias("block"))
        .agg(F.count("*").alias("writes"))
        .where("writes > 1")
    )


def tag_verdicts(tags: DataFrame, key: str, accesses: DataFrame, access_key: str, is_write: Column) -> DataFrame:
    """``(key, verdict)``: used, read-only, write-only, untouched.  Accesses are rolled up before the join."""
    flags = accesses.groupBy(F.col(access_key).alias(key)).agg(F.bool_or(is_write).alias("w"), F.bool_or(~is_write).alias("r"))
    verdict = (
        F.when(F.col("w") & F.col("r"), "used").when(F.col("r"), "read-only").when(F.col("w"), "write-only").otherwise("untouched")
    )
    return tags.select(key).join(flags, key, "left").select(key, verdict.alias("verdict"))


def undeclared(accesses: DataFrame, access_key: str, tags: DataFrame, key: str) -> DataFrame:
    return accesses.select(F.col(access_key).alias(key)).distinct().join(tags.select(key), key, "left_anti")


def silent_prefixes(tags: DataFrame, key: str, prefix: Column, touched: DataFrame, least: int = 3) -> DataFrame:
    """``(prefix, members)``: prefixes with enough members, none of them touched."""
    seen = touched.select(F.col(touched.columns[0]).alias("_k")).distinct()
    joined = tags.select(F.col(key), prefix.alias("prefix")).join(seen, F.col(key) == F.col("_k"), "left")
    out = joined.groupBy("prefix").agg(F.count("*").alias("members"), F.count("_k").alias("n"))
    return out.where(f"members >= {int(least)} and n = 0").select("prefix", "members")


def children_of_prefixes(parents: DataFrame, children: DataFrame, separator: str = "/") -> DataFrame:
    """``(parent, child)`` where a child's path starts with the parent's: an equi-join on its ancestors."""
    cut = children.select("child", F.explode(names.ancestors(F.col("child"), separator)).alias("parent"))
    return cut.join(parents.select("parent"), "parent").select("parent", "child")


def propagate_struct_refs(refs: DataFrame, separator: str = ".") -> DataFrame:
    """``(path, block, kind)`` with accesses of a parent struct moved to the children that are there."""
    paths = refs.select("path").distinct()
    cut = paths.select(F.col("path").alias("child"), F.explode(names.ancestors(F.col("path"), separator)).alias("parent"))
    moved = cut.join(refs.withColumnRenamed("path", "parent"), "parent").select(F.col("child").alias("path"), "block", "kind")
    parents = cut.join(paths.withColumnRenamed("path", "parent"), "parent", "left_semi").select(F.col("parent").alias("path")).distinct()
    return refs.select("path", "block", "kind").union(moved).distinct().join(parents, "path", "left_anti")


def longest_suffix(paths: DataFrame, id_col: str, path: Column, dictionary: DataFrame, separator: str = "/") -> DataFrame:
    """``(id, hit)``: the longest suffix of a path that the dictionary (suf) has."""
    cut = paths.select(id_col, F.posexplode(names.suffixes(path, separator)).alias("cut", "suf")).where("suf <> ''")
    return cut.join(dictionary.select("suf").distinct(), "suf").groupBy(id_col).agg(F.min_by("suf", "cut").alias("hit"))


def resolve_as_of(uses: DataFrame, assigns: DataFrame) -> DataFrame:
    """``uses`` (block, var, line) with ``resolved``: the latest value assigned above the line.

    A sort of both sides by block, variable and line, and the last assignment
    carried forward; a line's own assignment doesn't count.
    """
    a = assigns.select("block", "var", "line", F.col("value").alias("_v"), F.lit(1).alias("_k"))
    u = uses.select("block", "var", "line", F.lit(None).cast(assigns.schema["value"].dataType).alias("_v"), F.lit(0).alias("_k"))
    w = Window.partitionBy("block", "var").orderBy("line", "_k").rowsBetween(Window.unboundedPreceding, -1)
    both = u.unionByName(a).withColumn("resolved", F.last("_v", ignorenulls=True).over(w))
    return both.where("_k = 0").select("block", "var", "line", "resolved")


def occurrences(blocks: DataFrame, text_col: str, *needles: str) -> DataFrame:
    """``(block, line_number, line)`` of the lines that hold all needles."""
    lines = blocks.select("block", F.posexplode(F.split(text_col, "\r?\n")).alias("_i", "line"))
    for n in needles:
        lines = lines.where(F.col("line").contains(n))
    return lines.select("block", (F.col("_i") + 1).alias("line_number"), "line")


def by_priority(candidates: DataFrame, key: str, priority: str, value: str) -> DataFrame:
    """The value of the first candidate of each key."""
    return candidates.groupBy(key).agg(F.min_by(value, priority).alias(value))


def boundary_edges(edges: DataFrame, nodes: DataFrame, key: str, flag: Column) -> DataFrame:
    """``(rule, src, dst)`` of edges whose ends differ in a flag; F002 leaves the flagged side, F001 enters it."""
    n = nodes.select(F.col(key).alias("_k"), flag.alias("_f"))
    a, b = n.toDF("src", "_fa"), n.toDF("dst", "_fb")
    crossing = edges.join(a, "src").join(b, "dst").where("_fa <> _fb")
    return crossing.select(F.when(F.col("_fa"), "F002").otherwise("F001").alias("rule"), "src", "dst")
