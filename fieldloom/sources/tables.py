"""Readers and writers of point tables, tag files, test results and recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions import addresses, names
from fieldloom.schemas import IO_POINTS


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The point table of a CSV file; empty is null; of a repeated mnemonic the last row in file order stays."""
    raw = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in IO_POINTS])).csv(
        path, header=True, nullValue="", mode="PERMISSIVE", multiLine=True
    )
    rows = raw.withColumn("_n", F.monotonically_increasing_id()).where("mnemonic is not null")
    last = rows.groupBy("mnemonic").agg(F.max_by(F.struct(*raw.columns), "_n").alias("r")).select("r.*")
    return last.select(*[last[f.name].try_cast(f.dataType).alias(f.name) for f in IO_POINTS])


def write_points(points: DataFrame, path: str) -> None:
    """A CSV folder sorted by mnemonic; null is empty."""
    cols = [F.col(f.name).cast("string").alias(f.name) for f in IO_POINTS]
    points.select(*cols).orderBy("mnemonic").write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


_TEXT = "struct<AttributeList:struct<Culture:string,Text:string>>"
TAG_XML = (
    "AttributeList struct<Name:string,DataTypeName:string,LogicalAddress:string>, "
    f"ObjectList struct<MultilingualText:struct<ObjectList:struct<MultilingualTextItem:array<{_TEXT}>>>>"
)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """``TAGS`` of the tag-table XML files at a path; comment: en-US if there, else the first that isn't empty."""
    raw = spark.read.schema(TAG_XML).option("rowTag", "SW.Tags.PlcTag").format("xml").load(path)
    texts = F.filter(
        F.transform("ObjectList.MultilingualText.ObjectList.MultilingualTextItem", lambda x: x["AttributeList"]),
        lambda x: F.coalesce(x["Text"], F.lit("")) != "",
    )
    english = F.get(F.filter(texts, lambda x: x["Culture"] == "en-US"), 0)["Text"]
    name = F.col("AttributeList.Name")
    category = addresses.io_category(name)
    return raw.select(
        name.alias("name"),
        F.col("AttributeList.LogicalAddress").alias("address"),
        F.coalesce(addresses.data_type(F.col("AttributeList.DataTypeName")), F.lit("Bool")).alias("data_type"),
        F.coalesce(english, F.get(texts, 0)["Text"]).alias("comment"),
        category.alias("category"),
        F.when(category.endswith("I"), "input").when(category.endswith("O"), "output").alias("direction"),
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"),
    )


def points_of_tags(tags: DataFrame) -> DataFrame:
    """Tags as points; of a name in several files the last file by name stays."""
    last = tags.groupBy("name").agg(F.max_by(F.struct(*tags.columns), "source_file").alias("r")).select("r.*")
    return last.select(
        F.col("name").alias("mnemonic"),
        names.signal_name(F.col("name")).alias("signal_name"),
        F.col("category").alias("io_category"),
        "data_type",
        F.col("address").alias("plc_address"),
        addresses.is_safety(F.col("name")).alias("is_safety"),
        F.col("source_file").alias("xml_source"),
    )


def tag_xml_rows(points: DataFrame, group: str = "functional_group") -> DataFrame:
    """Points as they stand in tag files: (group, xml_id, mnemonic, ...), ids 1, 4, 7, ... within a group."""
    w = Window.partitionBy(group).orderBy("mnemonic")
    return points.withColumn("xml_id", 1 + 3 * (F.row_number().over(w) - 1))


JUNIT = "_name string, _classname string, _time double, failure struct<_message:string,_VALUE:string>, error struct<_message:string>, skipped struct<_message:string>"


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """``(name, class_name, outcome, duration, failure_message)`` of JUnit files."""
    raw = spark.read.schema(JUNIT).option("rowTag", "testcase").format("xml").load(path)
    outcome = (
        F.when(F.col("error").isNotNull(), "ERROR").when(F.col("failure").isNotNull(), "FAILED").when(F.col("skipped").isNotNull(), "SKIPPED").otherwise("PASSED")
    )
    return raw.select(
        F.col("_name").alias("name"),
        F.col("_classname").alias("class_name"),
        outcome.alias("outcome"),
        F.coalesce("_time", F.lit(0.0)).alias("duration"),
        F.coalesce("failure._message", "error._message", "skipped._message").alias("failure_message"),
    )


def register_block(registers: DataFrame, area: str, start: int, count: int, decode: str = "uint16") -> DataFrame:
    """``(spec, value)`` of consecutive registers (area, address, value)."""
    from fieldloom.functions.values import decode_register

    rows = registers.where((F.col("area") == area) & F.col("address").between(start, start + count - 1))
    return rows.select(F.concat_ws(":", "area", F.col("address").cast("string")).alias("spec"), decode_register(F.col("value"), decode).alias("value"))


#: Patterns of instance parameters that are left out where a sibling field has a value.
def filter_params(params: DataFrame, scope: str, field: str, equals: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Parameters (qualified_path, value, ...) without those of scope instances whose ``field`` equals a value.

    ``scope`` is a path with ``[*]``; ``skip`` names prefixes below it, all if empty.
    """
    import re

    pattern = "^(.*?" + re.escape(scope).replace(r"\[\*\]", r"\[[0-9]+\]") + r")\.(.*)$"
    cut = params.select("*", F.regexp_extract("qualified_path", pattern, 1).alias("_s"), F.regexp_extract("qualified_path", pattern, 2).alias("_r"))
    off = cut.where((F.col("_r") == field) & (F.col("value") == equals)).select(F.col("_s").alias("_off")).distinct()
    below = F.lit(not skip)
    for prefix in skip:
        below = below | F.col("_r").startswith(prefix)
    marked = cut.join(off, cut["_s"] == off["_off"], "left")
    return marked.where(~(F.col("_off").isNotNull() & below)).select(*params.columns)
