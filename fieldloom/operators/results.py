"""Test results: roll-ups, reruns, caches, coverage, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup(steps: DataFrame, by: str, passed: Column, failed: Column, skipped: Column) -> DataFrame:
    out = steps.groupBy(by).agg(
        F.count_if(passed).alias("passed"), F.count_if(failed).alias("failed"), F.count_if(skipped).alias("skipped"), F.count("*").alias("_n")
    )
    rate = F.round(F.coalesce(F.try_divide(100.0 * F.col("passed"), F.col("_n")), F.lit(0.0)), 4)
    return out.select(by, "passed", "failed", "skipped", rate.alias("pass_rate"))


def to_rerun(scenarios: DataFrame, key: str, history: DataFrame, history_key: str, outcome: str, order: str, bad: list[str]) -> DataFrame:
    """Keys never seen, or whose latest outcome is bad."""
    last = history.groupBy(F.col(history_key).alias(key)).agg(F.max_by(outcome, order).alias("_last"))
    return scenarios.select(key).join(last, key, "left").where(F.col("_last").isNull() | F.col("_last").isin(bad)).select(key)


def skip_after_failure(steps: DataFrame, scenario: str, order: tuple[str, ...], failed: Column) -> DataFrame:
    """Adds ``outcome``: steps after a scenario's first failure are SKIPPED."""
    w = Window.partitionBy(scenario).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(failed).over(w), F.lit(False))
    return steps.withColumn("outcome", F.when(before, "SKIPPED").when(failed, "FAILED").otherwise("PASSED"))


def merge_results(cache: DataFrame, new: DataFrame, baseline: str) -> DataFrame:
    """New results over old ones; old ones stay only if they are of this baseline."""
    kept = cache.where(F.col("baseline_hash") == baseline).join(new.select("name"), "name", "left_anti")
    return new.unionByName(kept.select(*new.columns))


def fingerprint(files: DataFrame, by: str | None, path: Column, content: str, separator: str) -> DataFrame:
    """``h``: SHA-256 of the sorted (path, SHA-256 of content) lines, for each group or for all."""
    line = F.struct(F.col("_p"), F.concat(F.col("_p").cast("string"), F.lit(separator), F.sha2(F.col(content).cast("binary"), 256)).alias("l"))
    rows = files.withColumn("_p", path)
    groups = rows.groupBy(by) if by else rows.groupBy()
    h = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").cast("binary"), 256)
    return groups.agg(h.alias("h"))


def coverage(lines: DataFrame) -> DataFrame:
    """``(block, covered, total, percent, missing)`` from arrays ``executable`` and ``touched``; missing as ranges."""
    x = lines.select("block", F.array_distinct("executable").alias("e"), F.array_intersect("executable", "touched").alias("c"))
    gaps = F.array_sort(F.array_except("e", "c"))
    first = F.transform(
        F.filter(F.transform(gaps, lambda v, i: F.struct(v.alias("v"), (v - i).alias("g"))), lambda s: s["v"].isNotNull()), lambda s: s["g"]
    )
    ranges = F.transform(
        F.array_distinct(first),
        lambda g: F.concat_ws(
            "-",
            F.array_distinct(
                F.array(
                    F.array_min(F.filter(gaps, lambda v: F.array_contains(gaps, v) & (F.array_position(gaps, v).cast("int") - 1 + g == v))),
                    F.array_max(F.filter(gaps, lambda v: F.array_position(gaps, v).cast("int") - 1 + g == v)),
                ).cast("array<string>")
            ),
        ),
    )
    return x.select(
        "block",
        F.size("c").alias("covered"),
        F.size("e").alias("total"),
        F.round(F.coalesce(F.try_divide(100.0 * F.size("c"), F.size("e")), F.lit(0.0)), 2).alias("percent"),
        F.array_join(ranges, ",").alias("missing"),
    )


def section_counts(findings: DataFrame, path: str = "section_path", severity: str = "severity") -> DataFrame:
    """Errors and findings of a section and everything below it."""
    s = F.split(path, "/")
    up = findings.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.array_join(F.slice(s, F.lit(1), i), "/"))).alias("section"), severity
    )
    return up.groupBy("section").agg(F.count_if(F.col(severity) == "ERROR").alias("errors"), F.count("*").alias("findings"))
