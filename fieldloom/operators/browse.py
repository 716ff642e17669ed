"""Lists and look-ups over cross-references, parameters, tags, sources and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import names


def access_type(readers: Column, writers: Column) -> Column:
    return F.when((readers > 0) & (writers > 0), "R/W").when(writers > 0, "W").when(readers > 0, "R").otherwise("-")


def variable_list(
    variables: DataFrame,
    violations: DataFrame,
    db: str | None = None,
    search: str | None = None,
    access: str | None = None,
    has_violations: bool | None = None,
) -> DataFrame:
    """Variables (full_reference, db_name, readers, writers) with access type and violations (full_reference), by reference."""
    counts = violations.groupBy("full_reference").agg(F.count("*").alias("violation_count"))
    out = variables.join(counts, "full_reference", "left").select(
        "full_reference",
        "db_name",
        access_type(F.col("readers"), F.col("writers")).alias("access_type"),
        "readers",
        "writers",
        F.coalesce("violation_count", F.lit(0)).alias("violation_count"),
    )
    if db is not None:
        out = out.where(F.col("db_name") == db)
    if search:
        out = out.where(F.lower("full_reference").contains(search.lower()))
    if access:
        out = out.where(F.col("access_type") == access)
    if has_violations is not None:
        out = out.where((F.col("violation_count") > 0) == has_violations)
    return out.orderBy("full_reference")


def db_summary(references: DataFrame) -> DataFrame:
    """``(db_name, fields)``: the distinct fields of each block of data, sorted."""
    return references.groupBy("db_name").agg(F.array_sort(F.collect_set("field_path")).alias("fields"))


def excerpt(sources: DataFrame, line: int = 0, context: int = 0) -> DataFrame:
    """``(block, source, total_lines, start_line, end_line)``: the lines around one, or all."""
    lines = F.split(F.regexp_replace("text", r"(?:\r\n|\n|\r)$", ""), r"\r\n|\n|\r")
    total = F.when(F.length("text") > 0, F.size(lines)).otherwise(0)
    if line > 0 and context > 0:
        start, end = F.greatest(F.lit(1), F.lit(line - context)), F.least(total, F.lit(line + context))
    else:
        start, end = F.lit(1), total
    part = F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n")
    return sources.select("block", part.alias("source"), total.alias("total_lines"), start.alias("start_line"), end.alias("end_line"))


def values_match(actual: Column, expected: Column, tolerance: float | None = None) -> Column:
    """Equal, or within a tolerance where both are numbers."""
    same = F.coalesce(actual.cast("string") == expected.cast("string"), F.lit(False))
    if tolerance is None:
        return same
    a, b = actual.try_cast("double"), expected.try_cast("double")
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= tolerance).otherwise(same)


def select_scenarios(scenarios: DataFrame, pattern: str | None) -> DataFrame:
    """Scenarios (name, source_file) whose name or file stem contains a text, in any case."""
    if not pattern:
        return scenarios
    stem = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.[^.]*$", "")
    p = pattern.lower()
    return scenarios.where(F.lower("name").contains(p) | F.coalesce(F.lower(stem).contains(p), F.lit(False)))


def search_tags(tags: DataFrame, pattern: str) -> DataFrame:
    return tags.where(F.lower("path").contains(pattern.lower())).orderBy("path")


def resolve_tags(wanted: DataFrame, tags: DataFrame) -> DataFrame:
    """Wanted paths with their node, null where there is none; of a repeated path the last."""
    last = tags.groupBy("path").agg(F.max("node_id").alias("node_id"))
    return wanted.select("path").join(last, "path", "left")


def tag_list(tags: DataFrame, category: str | None = None, direction: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The tags asked for, by name, and the counts of all categories in their fixed order."""
    order = F.array(*[F.lit(c) for c in names.CATEGORIES])
    counts = tags.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.array_position(order, F.col("category")))
    out = tags
    if category:
        out = out.where(F.col("category") == category)
    if direction:
        out = out.where(F.col("direction") == direction)
    return out.orderBy("name"), counts


#: Sections of a parameter table besides numbered ones.
SECTIONS = ("remote", "drive", "controller", "modbus", "redundancy")


def parameter_section(path: Column, db_name: str) -> Column:
    """``arms.N``, ``safety_arms.N``, a known section, or global."""
    prefix = f"{db_name}."
    rest = F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)
    arm, safety = F.regexp_extract(rest, r"^arms\[(\d+)\]\.", 1), F.regexp_extract(rest, r"^arm(\d+)\.", 1)
    known = F.regexp_extract(rest, rf"^({'|'.join(SECTIONS)})(?:\.|$)", 1)
    return (
        F.when(arm != "", F.concat(F.lit("arms."), arm.cast("long").cast("string")))
        .when(safety != "", F.concat(F.lit("safety_arms."), safety.cast("long").cast("string")))
        .when(known != "", known)
        .otherwise("global")
    )


def indexed_values(entries: DataFrame, db_name: str, field: str) -> DataFrame:
    """``(index, value)`` of entries (ord, qualified_path, value) ``db.arms[index].field``; the last one wins."""
    pattern = rf"^\Q{db_name}\E\.arms\[(\d+)\]\.\Q{field}\E$"
    found = entries.withColumn("index", F.regexp_extract("qualified_path", pattern, 1)).where("index <> ''")
    return found.groupBy(F.col("index").cast("int").alias("index")).agg(F.max_by("value", "ord").alias("value"))


def instance_indices(path: Column) -> Column:
    """The indices of a path that a member follows, as whole numbers: ``a[1].b[2].c[3]`` to ``[1, 2]``."""
    return F.transform(F.regexp_extract_all(path, F.lit(r"\[(\d+)\](?=\.)"), F.lit(1)), lambda x: x.cast("int"))


def by_instance(entries: DataFrame, path: str, order: str | None = None) -> DataFrame:
    """Entries an array instance at a time, those without one first, within it in their order (by path if none is named)."""
    return entries.orderBy(instance_indices(F.col(path)), order or path)


def unit_labels(units: DataFrame, configured: DataFrame, named: DataFrame) -> DataFrame:
    """``(index, label)``: the configured label, else the name without its quotes, else ``Unit n``."""
    c, n = configured.select("index", F.col("label").alias("_c")), named.select("index", F.regexp_replace("value", r"^['\"]+|['\"]+$", "").alias("_n"))
    both = units.select("index").join(c, "index", "left").join(n, "index", "left")
    return both.select("index", F.coalesce("_c", F.when(F.col("_n") != "", F.col("_n")), F.concat(F.lit("Unit "), F.col("index").cast("string"))).alias("label"))


def test_files(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """``(block, path)``: the test file of each block that has one.

    Of files (folder_ord, path) the first folder counts, in it the first
    candidate name, of equal names the shortest, then smallest path.
    """
    b = F.col("block")
    low, bare = F.lower(b), F.replace(b, F.lit("_"), F.lit(""))
    stems = F.array(b, low, names.camel_to_snake(b), F.concat(F.lit("fb"), b), F.concat(F.lit("fb"), low), F.concat(F.lit("fc"), b), F.concat(F.lit("fc"), low), F.lower(bare))
    wanted = blocks.select("block", F.posexplode(F.transform(stems, lambda x: F.concat(F.lit("test_"), x, F.lit(".py")))).alias("_c", "_name"))
    there = files.select("folder_ord", "path", F.element_at(F.split("path", "/"), -1).alias("_name"))
    rank = F.struct("folder_ord", "_c", F.length("path"), "path")
    return wanted.join(there, "_name").groupBy("block").agg(F.min_by("path", rank).alias("path"))


def qualified(parts: Column) -> Column:
    """Names of a nested member joined: ``a``, ``[1]``, ``b`` to ``a[1].b``."""
    return F.regexp_replace(F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), "."), r"\.\[", "[")


def file_groups(files: DataFrame, by: str) -> DataFrame:
    """``(by, files, names)``."""
    return files.groupBy(by).agg(F.count("*").alias("files"), F.array_sort(F.collect_list("name")).alias("names"))


def run_statistics(runs: DataFrame) -> DataFrame:
    """``(category, type, succeeded, failed)`` of pipeline runs (category, type, ok)."""
    return runs.groupBy("category", "type").agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


def suite_summary(steps: DataFrame) -> DataFrame:
    """``(scenario, outcome, steps, passed, failed, skipped, duration_s)`` of step results (scenario, ord, outcome, duration_s)."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    out = steps.groupBy("scenario").agg(
        F.count("*").alias("steps"), n("PASSED").alias("passed"), n("FAILED", "ERROR").alias("failed"), n("SKIPPED").alias("skipped"), F.round(F.sum("duration_s"), 3).alias("duration_s")
    )
    return out.withColumn("outcome", F.when(F.col("failed") > 0, "FAILED").when(F.col("skipped") == F.col("steps"), "SKIPPED").otherwise("PASSED"))


def first_of_each(diffs: DataFrame, by: str, order: str, n: int = 20) -> DataFrame:
    """The first ``n`` rows of each class."""
    w = Window.partitionBy(by).orderBy(order)
    return diffs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def undefined_names(used: DataFrame, bound: DataFrame) -> DataFrame:
    """``(block, name)`` of names that a block uses and nothing binds."""
    return used.select("block", "name").distinct().join(bound.select("block", "name"), ["block", "name"], "left_anti")


def struct_bindings(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """Arguments (block, callee, parameter, argument) bound to in-out parameters (block, parameter, section) of the callee."""
    inout = parameters.where("section = 'VAR_IN_OUT'").select(F.col("block").alias("callee"), "parameter")
    return calls.join(inout, ["callee", "parameter"], "left_semi")


def instance_types(variables: DataFrame, known: DataFrame) -> DataFrame:
    """``(block, instance, type)`` of variables (block, name, data_type) whose type is a known block (block)."""
    base = names.type_spec(F.col("data_type"))["base"]
    rows = variables.select("block", F.col("name").alias("instance"), base.alias("type"))
    return rows.join(known.select(F.col("block").alias("type")).distinct(), "type", "left_semi").select("block", "instance", "type")


def writes_like(accesses: DataFrame, pattern: Column) -> DataFrame:
    """Writes whose key with ``[*]`` indices matches a pattern."""
    return accesses.where(F.col("is_write") & names.wildcard_path(F.col("path")).rlike(pattern))


def tag_indices(tag: Column) -> Column:
    """The numbers at the end of a tag's name parts, in order: ``DO_ARM3_VALVE12`` to [3, 12]."""
    return F.transform(F.regexp_extract_all(tag, F.lit(r"[A-Za-z](\d+)(?=_|$)"), F.lit(1)), lambda x: x.cast("int"))


def tree_order(nodes: DataFrame) -> DataFrame:
    """Children (parent, is_leaf, name) of each parent, branches first, then by name."""
    return nodes.orderBy("parent", "is_leaf", "name")


def by_frequency(rows: DataFrame, by: str) -> DataFrame:
    """``(by, n)``, most frequent first."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)
