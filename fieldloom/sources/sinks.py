"""Writers: schema, backups, result reports, recordings, caches, coverage shards, tag files.

Text is put together by column expressions and written by Spark, in one file
where the format is one document; a document of results is bounded by the
suite it reports on.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import names
from fieldloom.schemas import IO_POINTS

#: What the columns of the point table hold (field, type, required, description).
POINT_SCHEMA = (
    ("id", "string", "Yes", "Unique identifier (8-char UUID)"),
    ("mnemonic", "string", "Yes", "PLC tag name (e.g., DI_LCP_PUMP_START)"),
    ("signal_name", "string", "Yes", "Human-readable description"),
    ("customer_tag", "string", "No", "Customer's tag ID (e.g., 021-HS-6001)"),
    ("functional_group", "enum", "No", "COMMON, GROUP1, GROUP2, etc."),
    ("io_category", "enum", "No", "DI, DO, AI, AO, SDI, SDO"),
    ("physical_type", "string", "No", "Push button, Switch, Transmitter, etc."),
    ("data_type", "string", "No", "Bool, Int, Real"),
    ("hw_address", "string", "No", "IOL format (E, A, PEW, PAW)"),
    ("plc_address", "string", "No", "S7 format (%I, %Q, %IW, %QW)"),
    ("is_safety", "boolean", "No", "Safety-related flag"),
    ("circuit_ref", "string", "No", "Electrical diagram reference"),
    ("control_unit", "string", "No", "Control panel unit assignment"),
    ("control_light", "string", "No", "Control panel light assignment"),
    ("is_intrinsically_safe", "boolean", "No", "Intrinsic safety flag"),
    ("xml_source", "string", "No", "Source XML filename"),
)


def point_schema(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POINT_SCHEMA, "field string, type string, required string, description string")


def write_schema(spark: SparkSession, path: str) -> None:
    point_schema(spark).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_backup(points: DataFrame, folder: str, stamp: str) -> str:
    """A copy of the point table in a folder of its own for each time stamp; returns its path."""
    at = f"{folder}/io_points_{stamp}"
    points.select(*[F.col(f.name).cast("string").alias(f.name) for f in IO_POINTS]).orderBy("mnemonic").write.csv(at, header=True, emptyValue="")
    return at


def escaped(text: Column) -> Column:
    """Text inside an XML attribute or element; characters XML can't hold are dropped."""
    out = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def junit_xml(steps: DataFrame) -> DataFrame:
    """One row ``value``, a JUnit document of step results.

    Steps are (scenario, ord, description, step_type, outcome, error_message,
    duration_s); a scenario that was skipped whole is one row with a null ord.
    """
    attr = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    seconds = lambda c: F.format_string("%.3f", F.coalesce(c, F.lit(0.0)))
    text = F.col("error_message")
    name = F.coalesce("description", F.concat(F.lit("Step "), (F.col("ord") + 1).cast("string"), F.lit(": "), "step_type"), "scenario")
    body = (
        F.when(F.col("ord").isNull(), F.concat(F.lit("<skipped"), attr("message", escaped(F.coalesce(text, F.lit("no reason given")))), F.lit(" />")))
        .when(
            F.col("outcome") == "FAILED",
            F.concat(F.lit("<failure"), attr("message", escaped(F.coalesce(text, F.lit("Assertion failed")))), F.lit(' type="AssertionError">'), escaped(text), F.lit("</failure>")),
        )
        .when(
            F.col("outcome") == "ERROR",
            F.concat(F.lit("<error"), attr("message", escaped(F.coalesce(text, F.lit("Execution error")))), F.lit(' type="RuntimeError">'), escaped(text), F.lit("</error>")),
        )
        .when(F.col("outcome") == "WARNING", F.concat(F.lit("<system-out>WARNING: "), escaped(F.coalesce(text, F.lit("Timing jitter detected"))), F.lit("</system-out>")))
        .when(F.col("outcome") == "SKIPPED", F.lit('<skipped message="Skipped due to previous failure" />'))
        .otherwise("")
    )
    case = F.concat(F.lit("<testcase"), attr("name", escaped(name)), attr("classname", escaped(F.col("scenario"))), attr("time", seconds(F.col("duration_s"))), F.lit(">"), body, F.lit("</testcase>"))
    failed = F.col("outcome").isin("FAILED", "ERROR") & F.col("ord").isNotNull()
    suites = steps.groupBy("scenario").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("ord", F.lit(-1)).alias("o"), case.alias("x")))).alias("cases"),
        F.count("*").alias("n"),
        F.count_if(F.col("ord").isNotNull()).alias("steps"),
        F.count_if(failed).alias("failed"),
        F.sum("duration_s").alias("s"),
    )
    suite = F.concat(
        F.lit("<testsuite"), attr("name", escaped(F.col("scenario"))), attr("tests", F.col("n").cast("string")), attr("failures", F.col("failed").cast("string")),
        attr("time", seconds(F.col("s"))), F.lit(">"), F.array_join(F.transform("cases", lambda c: c["x"]), ""), F.lit("</testsuite>"),
    )
    whole = suites.agg(
        F.array_sort(F.collect_list(F.struct("scenario", suite.alias("x")))).alias("suites"),
        F.coalesce(F.sum("steps"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
        F.sum("s").alias("s"),
    )
    return whole.select(
        F.concat(
            F.lit("<?xml version='1.0' encoding='us-ascii'?>\n<testsuites"), attr("tests", F.col("n").cast("string")), attr("failures", F.col("failed").cast("string")),
            attr("time", seconds(F.col("s"))), F.lit(">"), F.array_join(F.transform("suites", lambda c: c["x"]), ""), F.lit("</testsuites>"),
        ).alias("value")
    )


def write_text(document: DataFrame, path: str) -> None:
    """The column ``value`` as one text file in a folder."""
    document.select("value").coalesce(1).write.mode("overwrite").text(path)


def markdown_table(rows: DataFrame, title: str, *order: str) -> DataFrame:
    """One row ``value``: a heading and a table of all columns."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit(r"\|")), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |"))
    body = rows.agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("x"))
    head = f"# {title}\n\n| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    return body.select(F.concat(F.lit(head), F.array_join(F.transform("x", lambda c: c["line"]), "\n"), F.lit("\n")).alias("value"))


def write_recording(rows: DataFrame, path: str, meta: dict) -> None:
    """Rows of a trace (t_rel_s, sample_cycles, fields) as CSV, and its description as JSON beside it."""
    fields = [c for c in rows.columns if c not in ("t_rel_s", "sample_cycles")]
    rows.select("t_rel_s", "sample_cycles", *fields).orderBy("sample_cycles").coalesce(1).write.mode("overwrite").csv(path, header=True)
    spark = rows.sparkSession
    write_text(spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string"), f"{path}.meta.json")


def write_capture(samples: DataFrame, path: str) -> None:
    """Samples as JSON lines, a file a task."""
    samples.write.mode("overwrite").json(path)


def merge_results_cache(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """The latest entry of each key, by key."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), at).alias("r")).select("r.*").orderBy(key)


def merge_coverage(shards: DataFrame) -> DataFrame:
    """``(block, lines)`` of line coverage that processes wrote (block, line)."""
    return shards.groupBy("block").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def tag_document(points: DataFrame, group_by: str = "functional_group") -> DataFrame:
    """``(file, value)``: a tag table for each group, ids three apart, tags by name."""
    group = F.coalesce(group_by, F.lit("default"))
    item = F.struct(F.col("mnemonic").alias("m"), F.col("data_type").alias("t"), F.col("plc_address").alias("a"), F.col("signal_name").alias("s"))
    rows = points.groupBy(names.file_name(group).alias("file")).agg(F.array_sort(F.collect_list(item)).alias("x"))

    def tag(x: Column, i: Column) -> Column:
        element = lambda n, v: F.concat(F.lit(f"<{n}>"), escaped(v), F.lit(f"</{n}>"))
        attributes = F.concat(element("DataTypeName", x["t"]), element("LogicalAddress", x["a"]), element("Name", x["m"]))
        text = F.concat(element("Culture", F.lit("en-US")), element("Text", x["s"]))
        number = lambda k: F.conv((i * 3 + k).cast("string"), 10, 16)
        return F.concat(
            F.lit('<SW.Tags.PlcTag ID="'), number(1), F.lit('" CompositionName="Tags"><AttributeList>'), attributes, F.lit('</AttributeList><ObjectList><MultilingualText ID="'), number(2),
            F.lit('" CompositionName="Comment"><ObjectList><MultilingualTextItem ID="'), number(3), F.lit('" CompositionName="Items"><AttributeList>'), text,
            F.lit("</AttributeList></MultilingualTextItem></ObjectList></MultilingualText></ObjectList></SW.Tags.PlcTag>"),
        )

    body = F.array_join(F.transform("x", tag), "")
    table = F.concat(F.lit('<Document><SW.Tags.PlcTagTable ID="0"><AttributeList><Name>'), F.col("file"), F.lit("</Name></AttributeList><ObjectList>"), body, F.lit("</ObjectList></SW.Tags.PlcTagTable></Document>"))
    return rows.select("file", table.alias("value"))


def write_tag_files(points: DataFrame, path: str, group_by: str = "functional_group") -> None:
    """A folder ``file=NAME`` for each group with its document."""
    tag_document(points, group_by).write.mode("overwrite").partitionBy("file").text(path)
