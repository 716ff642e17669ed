"""Program sources as tables: one row a file, and the facts that parsing finds.

Parsing is the one hop to Python; each file is parsed once for all facts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_blocks(spark: SparkSession, path: str, pattern: str = "*.s7dcl") -> DataFrame:
    """``(path, category, text)`` of the files below a folder; a byte-order mark is dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    text = F.regexp_replace(F.decode("content", "utf-8"), "^﻿", "")
    folders = F.split("path", "/")
    return files.select("path", F.get(folders, F.size(folders) - 2).alias("category"), text.alias("text"))


FACTS = (
    "path string, block string, block_type string, error string, networks int, unread int,"
    "variables array<struct<section:string,name:string,data_type:string,default_value:string,parent:string,constant:boolean,line:int>>,"
    "accesses array<struct<path:string,kind:string,line:int,statement:string,expression:string,element:string>>,"
    "calls array<struct<callee:string,call_type:string,line:int>>,"
    "assignments array<struct<target:string,expression:string,condition:string,line:int>>,"
    "states array<struct<name:string,value:string>>,"
    "transitions array<struct<from_state:string,to_state:string,condition:string>>,"
    "statements array<struct<line:int,text:string>>"
)


def facts(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``FACTS`` of each file; a file that can't be parsed has ``error`` and no facts."""

    def one(path: str, text: str | None) -> tuple:
        from fieldloom.lang import facts as f
        from fieldloom.lang import parser as p

        try:
            b = p.parse_block(text or "")
        except (p.Stop, IndexError, RecursionError) as e:
            return (path, None, None, str(e), 0, 0, [], [], [], [], [], [], [])
        states, moves = f.state_machine(b)
        return (
            path, b.name, b.kind, None, b.networks, f.unread_tokens(b),
            [(v.section, v.name, v.data_type, v.default, v.parent, v.constant, v.line) for v in b.variables],
            [(a.path, a.kind, a.line, a.statement, a.expression, a.element) for a in f.accesses(b)],
            f.calls(b), f.assignments(b), states, moves, f.flat_statements(b),
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.name for x in schema]
        for batch in batches:
            rows = [one(a, b) for a, b in zip(batch["path"], batch["text"])]
            out = pd.DataFrame(rows, columns=names)
            for column in names[6:]:
                keys = [x.name for x in schema[column].dataType.elementType]
                out[column] = [[dict(zip(keys, item)) for item in items] for items in out[column]]
            yield out

    from pyspark.sql import types as T

    schema = T._parse_datatype_string(FACTS)
    return files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def exploded(found: DataFrame, column: str) -> DataFrame:
    """One row a fact of one kind, with its block."""
    return found.select(F.col("block").alias("block_name"), F.inline(column))


def tokens(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(path, seq, type, value, line, column)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from fieldloom.lang.lexer import tokenize

        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                found = tokenize(text or "")
                if found:
                    out = pd.DataFrame(found, columns=["type", "value", "line", "column"])
                    yield out.assign(path=path, seq=range(len(out)))[["path", "seq", "type", "value", "line", "column"]]

    return files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInPandas(
        run, "path string, seq int, type string, value string, line int, column int"
    )


def conformance(found: DataFrame) -> DataFrame:
    """One row: blocks, failed, networks, statements, unread tokens."""
    return found.agg(
        F.count("*").alias("blocks"),
        F.count("error").alias("failed"),
        F.sum("networks").alias("networks"),
        F.sum(F.size("statements")).alias("statements"),
        F.sum("unread").alias("unread"),
    )


def diff_interfaces(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(block_name, section, name, change)`` of two versions' variables."""
    key = ["block_name", "section", "name"]
    a = exploded(old, "variables").select(*key, F.struct("data_type", "default_value").alias("a"))
    b = exploded(new, "variables").select(*key, F.struct("data_type", "default_value").alias("b"))
    both = a.join(b, key, "full_outer")
    change = (
        F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    )
    return both.select(*key, change.alias("change")).where("change is not null")


def diff_bodies(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(block, line, change, text)``: statements that a sequence comparison finds removed or added."""

    def run(key: tuple[str, ...], left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import difflib

        def lines(pdf: pd.DataFrame) -> list[tuple[int, str]]:
            return [(s["line"], s["text"]) for s in (pdf["statements"].iloc[0] if len(pdf) else [])]

        a, b, out = lines(left), lines(right), []
        matcher = difflib.SequenceMatcher(None, [t for _, t in a], [t for _, t in b], autojunk=False)
        for op, i, j, k, m in matcher.get_opcodes():
            if op != "equal":
                out += [(key[0], n, "removed", t) for n, t in a[i:j]] + [(key[0], n, "added", t) for n, t in b[k:m]]
        return pd.DataFrame(out, columns=["block", "line", "change", "text"])

    pick = lambda df: df.where("block is not null").select("block", "statements").groupBy("block")
    return pick(old).cogroup(pick(new)).applyInPandas(run, "block string, line int, change string, text string")
