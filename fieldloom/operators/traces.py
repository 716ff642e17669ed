"""Tracing fields through statements: flows, bounded searches with stop rules, chains, trees, type graphs.

Accesses are rows (block, line, statement, path, is_write).  A search is a
frontier a round, written to the shared folder; it holds one row for each root
and field, so one run traces every root at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import names
from fieldloom.operators.components import connected_components
from fieldloom.plans.scratch import Scratch

#: Prefixes of physical tags.
IO_TAG_PREFIXES = ("DO_", "SDO_", "DI_", "SDI_", "AI_", "SAI_")
#: What a field path, and a local name, of a state looks like.
STATE_FIELDS = (
    r"\.status\.(motionMode|userMode|safetyState|ersState|userState|alarmState)",
    r"\.status\.[a-zA-Z]*[Ss]tate",
    r"\.status\.[a-zA-Z]*[Mm]ode",
    r"\.[a-zA-Z]+State$",
    r"\.[a-zA-Z]+Mode$",
    r"SafetyData.*\.status\.",
)
STATE_NAMES = (r"^activeState$", r"^state$", r"^currentState$", r"State$", r"Mode$")


def tight_path(path: Column) -> Column:
    """A path without blanks around dots and brackets."""
    p = F.regexp_replace(path, r"\s*\.\s*", ".")
    p = F.regexp_replace(F.regexp_replace(p, r"\s*\[\s*", "["), r"\s*\]\s*", "]")
    return F.regexp_replace(p, r"\[\s*#\s*", "[#")


def is_io_tag(name: Column) -> Column:
    return F.regexp_replace(name, '^"+|"+$', "").rlike(f"^({'|'.join(IO_TAG_PREFIXES)})")


def is_state_variable(path: Column) -> Column:
    return tight_path(path).rlike("(?i)" + "|".join(f"(?:{p})" for p in STATE_FIELDS))


def is_state_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, "^#+", "")).rlike("(?i)" + "|".join(f"(?:{p})" for p in STATE_NAMES))


def variable_kind(name: Column, known_tag: Column | None = None, known_state: Column | None = None) -> Column:
    """io_tag, state_var, local or field, in this order; the flags say whether a table holds the name."""
    tag = is_io_tag(name) if known_tag is None else F.coalesce(known_tag, F.lit(False)) | is_io_tag(name)
    local = name.startswith("#")
    state = is_state_variable(name) | (local & is_state_name(name))
    if known_state is not None:
        state = F.coalesce(known_state, F.lit(False)) | state
    return F.when(tag, "io_tag").when(state, "state_var").when(local, "local").otherwise("field")


def is_termination(name: Column, known_tag: Column | None = None) -> Column:
    """Where a trace ends: a tag or a state."""
    return variable_kind(name, known_tag).isin("io_tag", "state_var")


def valid_path(path: Column) -> Column:
    """Not blank, not cut off inside an index, brackets in pairs."""
    pairs = F.regexp_count(path, F.lit(r"\[")) == F.regexp_count(path, F.lit(r"\]"))
    return F.coalesce(~path.endswith("[") & pairs & (F.trim(path) != ""), F.lit(False))


def usages(accesses: DataFrame, fields: DataFrame, exclude_writes: bool = True) -> DataFrame:
    """``(field, block, line, statement, access)`` of global fields (field), one row a statement.

    Paths match on their key with ``[*]`` for every index.  Of several
    accesses in a statement a read stands for it.
    """
    keyed = accesses.where(F.col("path").startswith('"')).withColumn("_key", names.wildcard_path(F.col("path")))
    if exclude_writes:
        keyed = keyed.where(~F.col("is_write"))
    wanted = fields.select("field", names.wildcard_path(F.col("field")).alias("_key")).where(F.col("field").startswith('"'))
    found = keyed.join(wanted.distinct(), "_key").groupBy("field", "block", "line", "statement")
    return found.agg(F.when(F.bool_and("is_write"), "write").otherwise("read").alias("access"))


def statement_flows(accesses: DataFrame, *by: str) -> DataFrame:
    """``(src, dst)``: what a statement reads, to what it writes."""
    keys = list(by) or ["block", "line", "statement"]
    reads = accesses.where(~F.col("is_write")).select(*keys, F.col("path").alias("src")).distinct()
    writes = accesses.where("is_write").select(*keys, F.col("path").alias("dst")).distinct()
    return reads.join(writes, keys).select("src", "dst").distinct()


def trace(flows: DataFrame, starts: DataFrame, max_depth: int = 10, stops: DataFrame | None = None, backward: bool = False) -> DataFrame:
    """``(root, field, depth, parent, why)``: fields reached from each start (root, field), at their least depth.

    ``stops`` (field, why) are reached and not followed; what lies at
    ``max_depth`` is marked MAX_DEPTH.  parent is the smallest field one step
    nearer to the root that leads to a field.
    """
    scratch = Scratch(flows.sparkSession)
    src, dst = ("dst", "src") if backward else ("src", "dst")
    steps = scratch.keep(flows.select(F.col(src).alias("parent"), F.col(dst).alias("field")).where("parent <> field").distinct(), "trace-flows")
    none = F.lit(None)
    seen = starts.select("root", "field", F.lit(0).alias("depth"), none.cast(flows.schema[src].dataType).alias("parent")).distinct()
    seen = scratch.keep(seen, "trace-0")
    frontier = seen
    for depth in range(1, max_depth + 1):
        if stops is not None:
            frontier = frontier.join(stops.select("field"), "field", "left_anti")
        nxt = frontier.select("root", F.col("field").alias("parent")).join(steps, "parent").groupBy("root", "field").agg(F.min("parent").alias("parent"))
        nxt = nxt.join(seen.select("root", "field"), ["root", "field"], "left_anti").select("root", "field", F.lit(depth).alias("depth"), "parent")
        frontier = scratch.keep(nxt, f"trace-{depth}")
        if frontier.isEmpty():
            break
        seen = scratch.keep(seen.union(frontier), "trace-seen")
    why = F.when(F.col("depth") >= max_depth, "MAX_DEPTH")
    if stops is None:
        return seen.withColumn("why", why)
    marked = seen.join(stops.groupBy("field").agg(F.min("why").alias("_why")), "field", "left")
    return marked.select("root", "field", "depth", "parent", F.coalesce(why, "_why").alias("why"))


def output_stops(assignments: DataFrame, output_prefixes: tuple[str, ...] = ("DO_", "SDO_")) -> DataFrame:
    """``(field, why)`` of fields that output tags (tag, field) are assigned from; of several tags the last by name."""
    out = assignments.where(F.col("tag").rlike(f"^({'|'.join(output_prefixes)})") & F.col("field").isNotNull())
    return out.groupBy(tight_path(F.col("field")).alias("field")).agg(F.concat(F.lit("-> "), F.max("tag")).alias("why"))


def best_writers(accesses: DataFrame, *priority: str) -> DataFrame:
    """The one write of each path that comes first by ``priority``."""
    rank = F.struct(*[F.col(c) for c in priority])
    writes = accesses.where("is_write")
    return writes.groupBy("path").agg(F.min_by(F.struct(*[c for c in accesses.columns if c != "path"]), rank).alias("w")).select("path", "w.*")


def chain_flows(accesses: DataFrame, keys: list[str], *priority: str) -> DataFrame:
    """``(src, dst)``: each path's best write, and what its statement reads."""
    best = best_writers(accesses, *priority).select(*keys, F.col("path").alias("dst"))
    reads = accesses.where(~F.col("is_write")).select(*keys, F.col("path").alias("src")).distinct()
    return best.join(reads, keys).select("src", "dst").distinct()


def chain_depth(traced: DataFrame) -> DataFrame:
    """``(root, depth, nodes)``: how deep a chain goes and how many fields it has."""
    return traced.groupBy("root").agg(F.max("depth").alias("depth"), F.count("*").alias("nodes"))


def leaves(traced: DataFrame) -> DataFrame:
    """The rows of a trace that are no row's parent."""
    inner = traced.select("root", F.col("parent").alias("field")).where("field is not null").distinct()
    return traced.join(inner, ["root", "field"], "left_anti")


def combined(assignments: DataFrame) -> DataFrame:
    """``(target, expression)``: assignments (target, ord, expression, condition) of a target OR-ed, each inside its condition."""
    one = F.when(F.col("condition").isNotNull(), F.concat(F.lit("("), "condition", F.lit(" AND "), "expression", F.lit(")"))).otherwise(F.col("expression"))
    rows = assignments.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("ord", one.alias("e")))).alias("x"))
    return rows.select("target", F.array_join(F.transform("x", lambda x: x["e"]), " OR ").alias("expression"))


def edges_inside(edges: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """``(group, src, dst)`` of edges with both ends in a group (group, n)."""
    a = members.select(F.col(group), F.col("n").alias("src"))
    b = members.select(F.col(group), F.col("n").alias("dst"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, [group, "dst"]).select(group, "src", "dst")


def type_edges(members: DataFrame, known: DataFrame) -> DataFrame:
    """``(src, dst)``: a type and a known type (type) that a member (type, data_type) is of, arrays included."""
    base = names.type_spec(F.col("data_type"))["base"]
    used = members.select(F.col("type").alias("src"), base.alias("dst"))
    return used.join(known.select(F.col("type").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def type_components(types: DataFrame, edges: DataFrame) -> DataFrame:
    """``(name, size, members)`` of components of types (type): largest first, then by name.

    The name is that of the member with the most dependencies.
    """
    degree = edges.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("out"))
    comps = connected_components(edges, "src", "dst")
    t = types.select("type").distinct().join(comps.withColumnRenamed("node", "type"), "type", "left")
    t = t.join(degree.withColumnRenamed("src", "type"), "type", "left")
    rows = t.select("type", F.coalesce("component", "type").alias("c"), F.coalesce("out", F.lit(0)).alias("out"))
    out = rows.groupBy("c").agg(F.min_by("type", F.struct(-F.col("out"), "type")).alias("name"), F.count("*").alias("size"), F.array_sort(F.collect_list("type")).alias("members"))
    return out.select("name", "size", "members").orderBy(F.desc("size"), "name")
