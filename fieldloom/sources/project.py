"""Files of a project beside its program: texts, libraries, scenarios, caches, parameters, tag groups.

YAML is read by PyYAML where it is there.  A file that can't be read gives no
rows, or one row with ``error`` where that is said.
"""

from __future__ import annotations

import itertools
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import values
from fieldloom.lang.start import literal_value, put, zero_value
from fieldloom.sources import tables


def read_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(path, text)`` of the files below a folder; a byte-order mark is dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.regexp_replace(text, "^﻿", "").alias("text"))


def _each(files: DataFrame, schema: str, rows: Callable[[str, str], list[tuple]]) -> DataFrame:
    names = [part.split()[0] for part in re.split(r", (?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [row for path, text in zip(batch["path"], batch["text"]) for row in rows(path, text or "")]
            yield pd.DataFrame(out, columns=names, dtype=object)

    return files.select("path", "text").mapInPandas(run, schema)


def _yaml(text: str) -> Any:
    import yaml

    try:
        return yaml.safe_load(text)
    except yaml.YAMLError:
        return None


def resource_texts(files: DataFrame) -> DataFrame:
    """``(path, ord, id, text)`` of multilingual text files; scalars of any type become text, no text is empty."""

    def rows(path: str, text: str) -> list[tuple]:
        data = _yaml(text)
        entries = (data.get("MultiLingualTexts") if isinstance(data, dict) else None) or []
        shown = lambda v: "" if v is None else str(v)
        return [(path, i, shown(e.get("id")), shown(e.get("en-US"))) for i, e in enumerate(entries) if isinstance(e, dict)]

    return _each(files, "path string, ord int, id string, text string", rows)


def library_info(files: DataFrame) -> DataFrame:
    """``(path, guid, version_number, author, is_default)``; empty and default where a file says nothing."""

    def rows(path: str, text: str) -> list[tuple]:
        data = _yaml(text)
        data = data if isinstance(data, dict) else {}
        kind, version = data.get("LibraryType") or {}, data.get("LibraryVersion") or {}
        said = [kind.get("Guid", ""), version.get("VersionNumber", ""), version.get("Author", "")]
        return [(path, *map(str, said), bool(version.get("IsDefault", True)))]

    return _each(files, "path string, guid string, version_number string, author string, is_default boolean", rows)


def library_interface(files: DataFrame) -> DataFrame:
    """``(path, guid, document_hash, dependencies)``, the last two as JSON."""

    def rows(path: str, text: str) -> list[tuple]:
        data = _yaml(text)
        data = data if isinstance(data, dict) else {}
        version = data.get("LibraryVersion") or {}
        return [(path, str(version.get("Guid", "")), json.dumps(data.get("DocumentHash", []), default=str), json.dumps(version.get("DependsOn", []), default=str))]

    return _each(files, "path string, guid string, document_hash string, dependencies string", rows)


#: Scenario files are found by these names.
SCENARIO_FILES = "{test_,EFAT_}*.{yaml,yml}"
SCENARIOS = (
    "path string, name string, description string, tags array<string>, timeout string, skip boolean, skip_reason string, "
    "preconditions array<struct<path:string,value:string>>, steps array<struct<step:string,arguments:string>>, "
    "cleanup array<struct<step:string,arguments:string>>, error string"
)


def truth(value: Any) -> bool:
    """A quoted ``false``, ``no``, ``off``, ``0`` or empty text is false, as the unquoted one."""
    return value.strip().lower() not in ("", "false", "no", "off", "0") if isinstance(value, str) else bool(value)


def scenarios(files: DataFrame, known: tuple[str, ...] | None = None) -> DataFrame:
    """``SCENARIOS`` of files and ``timeout_s``; arguments of steps are JSON.

    A file without a scenario, or with a step that isn't among ``known``, has
    ``error`` and its path alone.
    """

    def steps(raw: list[dict] | None) -> list[dict]:
        found = [{"step": str(s.get("step", "")).lower(), "arguments": json.dumps({k: v for k, v in s.items() if k != "step"}, default=str)} for s in raw or []]
        for s in found:
            if known is not None and s["step"] not in known:
                raise ValueError(f"unknown step type: {s['step']}")
        return found

    def rows(path: str, text: str) -> list[tuple]:
        data = _yaml(text)
        try:
            if not isinstance(data, dict) or not isinstance(data.get("scenario"), dict):
                raise ValueError("no scenario")
            s = data["scenario"]
            before = [{"path": str(p["path"]), "value": json.dumps(p["value"], default=str)} for p in s.get("preconditions") or []]
            stem = re.sub(r"(?<=.)\.[^.]*$", "", path.rsplit("/", 1)[-1])
            reason = s.get("skip_reason")
            return [(
                path, str(s.get("name", stem)), str(s.get("description", "")), [str(t) for t in s.get("tags") or []], str(s.get("timeout", "60s")),
                truth(s.get("skip", False)), "" if reason is None else str(reason), before, steps(s.get("steps")), steps(s.get("cleanup")), None,
            )]
        except (KeyError, TypeError, AttributeError, ValueError) as e:
            return [(path, *[None] * 9, str(e))]

    return _each(files, SCENARIOS, rows).withColumn("timeout_s", values.duration_seconds(F.col("timeout"))).drop("timeout")


def suite_setup(files: DataFrame) -> DataFrame:
    """``(path, description, settle_s, post_settle_s, values, post_values)`` of ``setup.yaml`` or ``setup.yml``, the first if both are there."""

    def rows(path: str, text: str) -> list[tuple]:
        data = _yaml(text)
        if not isinstance(data, dict) or not isinstance(data.get("setup"), dict):
            return []
        s = data["setup"]
        shown = [json.dumps(s.get(k) or {}, default=str) for k in ("values", "post_values")]
        return [(path, str(s.get("description", "")), str(s.get("settle_time", "1s")), str(s.get("post_settle_time", "1s")), *shown)]

    named = files.where(F.col("path").rlike(r"(^|/)setup\.ya?ml$")).orderBy("path").limit(1)
    got = _each(named, "path string, description string, settle string, post string, values string, post_values string", rows)
    seconds = [values.duration_seconds(F.col(c)).alias(a) for c, a in (("settle", "settle_s"), ("post", "post_settle_s"))]
    return got.select("path", "description", *seconds, "values", "post_values")


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ``**`` any folders, ``*`` and ``?`` within a name."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob[i] in "*?":
            out, i = out + ("[^/]*" if glob[i] == "*" else "[^/]"), i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def baseline_sources(spark: SparkSession, root: str, globs: list[str]) -> DataFrame:
    """``(path, relative)`` of files below a root that match any glob, each once, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    relative = F.regexp_replace("path", "^.*?" + re.escape(base), "")
    pattern = "^(?:" + "|".join(glob_pattern(g) for g in globs) + ")$" if globs else "(?!)"
    return files.select("path", relative.alias("relative")).where(F.col("relative").rlike(pattern)).distinct().orderBy("path")


RESULT = "struct<name:string,source_file:string,outcome:string,duration_s:double,error_message:string,executed_at:string>"


def results_cache(spark: SparkSession, path: str) -> DataFrame:
    """``(baseline, key, name, source_file, outcome, ...)``; no rows of a file that isn't such a cache."""
    schema = f"baseline struct<hash:string,computed_at:string>, results map<string,{RESULT}>, _bad string"
    raw = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    good = raw.where("_bad is null and baseline.hash is not null")
    return good.select(F.col("baseline.hash").alias("baseline"), F.explode("results")).select("baseline", "key", "value.*")


def tag_cache(spark: SparkSession, path: str, now: str, ttl_hours: float = 24.0) -> DataFrame:
    """``(path, node_id, data_type, is_writable)``; no rows once a cache is older than its hours."""
    tag = "struct<path:string,node_id:string,data_type:string,is_writable:boolean>"
    raw = spark.read.schema(f"built_at string, ttl_hours double, tags map<string,{tag}>").option("multiLine", True).json(path)
    age = (F.lit(now).try_cast("timestamp").cast("double") - F.col("built_at").try_cast("timestamp").cast("double")) / 3600
    fresh = raw.where(age <= F.coalesce("ttl_hours", F.lit(ttl_hours)))
    return fresh.select(F.explode("tags")).select("value.*")


#: Folders that hold tag files, in the order they are tried.
TAG_FOLDERS = ("PLC tags", "PLC Tags", "Tags", "tags")
DEEP_TAG_FOLDERS = ("PLC tags", "Tags")


def tag_folder(spark: SparkSession, project: str) -> str | None:
    """The tag folder of a project: one right in it, else the first one anywhere below it."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(project)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = lambda p: sorted((s.getPath() for s in fs.listStatus(p) if s.isDirectory()), key=lambda x: x.toString())
    if not fs.exists(root):
        return None
    direct = {p.getName(): p for p in folders(root)}
    for name in TAG_FOLDERS:
        if name in direct:
            return direct[name].toString()
    for name in DEEP_TAG_FOLDERS:
        level = list(direct.values())
        while level:
            below = [q for p in level for q in folders(p)]
            hit = next((q for q in below if q.getName() == name), None)
            if hit is not None:
                return hit.toString()
            level = below
    return None


def points_of_groups(spark: SparkSession, folder: str, groups: list[tuple[str, list[str]]]) -> tuple[DataFrame, DataFrame]:
    """Points of the tag files that groups (id, files) name, and the files that aren't there.

    A name in several files has the row of the last one named; ``functional_group`` is its group.
    """
    wanted = spark.createDataFrame(
        [(n, g, f) for n, (g, f) in enumerate((g, f) for g, fs in groups for f in fs)], "_n int, functional_group string, source_file string"
    )
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("source_file"))
    tags = tables.read_tags(spark, folder).join(wanted, "source_file")
    last = tags.groupBy("name").agg(F.max_by(F.struct(*tags.columns), "_n").alias("r")).select("r.*")
    points = tables.points_of_tags(last.drop("_n", "functional_group"))
    named = points.join(last.select(F.col("name").alias("mnemonic"), "functional_group"), "mnemonic")
    return named, wanted.join(there, "source_file", "left_anti").select("functional_group", "source_file")


SPACE = "{http://www.siemens.com/automation/Openness/SW/Interface/v5}"
PARAMETERS = "path string, ord int, qualified_path string, datatype string, value string, comment string"
#: Members of types: name to (parent, name, data type, default), in order.
Types = dict[str, list[tuple[str, str, str, str | None]]]


def types_of(found: DataFrame) -> Types:
    """Members of the type blocks among facts; the driver holds the types of one project."""
    rows = found.where("block_type = 'TYPE'").select("block", "variables").collect()
    return {r.block: [(v.parent or "", v.name, v.data_type, v.default_value) for v in r.variables] for r in rows}


def _bare(data_type: str) -> str:
    cleaned = data_type.replace("&quot;", "").replace('"', "")
    array = re.match(r"Array\[.*?\]\s+of\s+(.*)", cleaned)
    return array.group(1).strip() if array else cleaned


def _expanded(types: Types, path: str, data_type: str, default: str, members: list, inside: str) -> Iterator[tuple[str, str, str]]:
    """``(path, type, value)`` of the leaves of a member; ``inside`` is its place among ``members``."""
    array = re.match(r"(?i)^Array\s*\[(.*)\]\s*of\s+(.+)$", data_type.strip())
    bounds = [re.match(r"^\s*(-?\d+)\s*\.\.\s*(-?\d+)\s*$", d) for d in array.group(1).split(",")] if array else []
    name = data_type.strip().strip('"')
    if array and all(bounds):
        for index in itertools.product(*[range(int(b.group(1)), int(b.group(2)) + 1) for b in bounds]):
            yield from _expanded(types, f"{path}[{','.join(map(str, index))}]", array.group(2).strip(), "", members, inside)
    elif name.lower() == "struct":
        for parent, field, kind, value in members:
            if parent == inside:
                yield from _expanded(types, f"{path}.{field}", kind, value or "", members, f"{inside}.{field}" if inside else field)
    elif name in types:
        for parent, field, kind, value in types[name]:
            if parent == "":
                yield from _expanded(types, f"{path}.{field}", kind, value or "", types[name], field)
    else:
        yield path, name, default


def parameter_entries(text: str, fallback: str, db_name: str | None = None, types: Types | None = None) -> list[tuple[str, str, str]]:
    """``(qualified path, type, value)`` of an instance block's XML, an instance of a structure at a time."""
    block = ET.fromstring(text).find("SW.Blocks.InstanceDB/AttributeList")
    if block is None:
        raise ValueError("no instance block")
    static = block.find(f"Interface/{SPACE}Sections/{SPACE}Section[@Name='Static']")
    if static is None:
        raise ValueError("no static section")
    db = db_name or block.findtext("Name") or fallback
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    out: list[tuple[str, str, str]] = []

    def walk(member: ET.Element, above: list[tuple[str, bool]]) -> None:
        raw = member.get("Datatype", "")
        path = [*above, (member.get("Name", ""), raw.startswith("Array"))]
        below: dict[str, list[ET.Element]] = {}
        for child in member:
            below.setdefault(local(child), []).append(child)
        plain = ".".join([db, *[n for n, _ in path]])
        if "Subelement" in below:
            for sub in below["Subelement"]:
                left = iter(sub.get("Path", "").split(","))
                full = db
                for name, many in path:
                    index = next(left, None) if many else None
                    full += f".{name}" + (f"[{index}]" if index is not None else "")
                value = next((e.text for e in sub if local(e) == "StartValue"), None)
                out.append((full, _bare(raw), value or ""))
        elif "StartValue" in below:
            out.append((plain, _bare(raw), below["StartValue"][0].text or ""))
        elif "Sections" in below:
            for section in below["Sections"][0]:
                for child in section:
                    if local(child) == "Member":
                        walk(child, path)
        elif types and _bare(raw) in types:
            out.extend(_expanded(types, plain, _bare(raw), "", [], ""))

    for member in static.findall(f"{SPACE}Member"):
        walk(member, [])
    return sorted(out, key=lambda e: [int(i) for i in re.findall(r"\[(\d+)\](?=\.)", e[0])])


def parameters(files: DataFrame, db_name: str | None = None, types: Types | None = None) -> DataFrame:
    """``PARAMETERS`` of instance-block XML files (path, text); a file that isn't one gives no rows."""

    def rows(path: str, text: str) -> list[tuple]:
        stem = re.sub(r"(?<=.)\.[^.]*$", "", path.rsplit("/", 1)[-1])
        try:
            found = parameter_entries(text, stem, db_name, types)
        except (ET.ParseError, ValueError):
            return []
        return [(path, i, *entry, "") for i, entry in enumerate(found)]

    return _each(files, PARAMETERS, rows)


def data_blocks(found: DataFrame) -> DataFrame:
    """``(path, block, json)`` of the data blocks among facts: declared start values, else zeros, then what the body sets."""
    kinds = found.where("block_type = 'DATA_BLOCK'").select("path", "block", F.to_json(F.struct("variables", "assignments")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                facts, root = json.loads(text), {}
                for v in facts.get("variables") or []:
                    start = literal_value(v["default_value"]) if v.get("default_value") is not None else zero_value(v["data_type"])
                    if start is not None:
                        put(root, f"{v['parent']}.{v['name']}" if v.get("parent") else v["name"], start)
                for a in facts.get("assignments") or []:
                    put(root, a["target"].lstrip("#").replace('"', ""), literal_value(a["expression"]))
                out.append(json.dumps(root))
            yield batch[["path", "block"]].assign(json=out)

    return kinds.mapInPandas(run, "path string, block string, json string")
