"""I/O-point tables: filters, statistics, upsert, diff, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import names


def filter_points(points: DataFrame, **wanted) -> DataFrame:
    """Conjunction of equalities; a value of None asks nothing."""
    for column, value in wanted.items():
        if value is not None:
            points = points.where(F.col(column) == value)
    return points


def top_points(points: DataFrame, key: str, limit: int, **wanted) -> DataFrame:
    return filter_points(points, **wanted).orderBy(key).limit(limit)


def statistics(points: DataFrame, dimensions: dict[str, tuple[str, str]]) -> DataFrame:
    """``(dim, k, n)`` for several groupings in one pass; name -> (column, label of null)."""
    sets = F.array(
        *[
            F.struct(F.lit(name).alias("dim"), F.coalesce(F.col(column).cast("string"), F.lit(label)).alias("k"))
            for name, (column, label) in dimensions.items()
        ]
    )
    return points.select(F.inline(sets)).groupBy("dim", "k").agg(F.count("*").alias("n"))


def upsert(base: DataFrame, other: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Rows of both by key; of a key in both the other's row if ``overwrite``, else the base's."""
    first, second = (other, base) if overwrite else (base, other)
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def upsert_counts(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``(added, skipped)``: keys of ``other`` that are new, and that are there already."""
    flags = other.select(key).join(base.select(key, F.lit(True).alias("there")), key, "left")
    return flags.agg(F.count_if(F.col("there").isNull()).alias("added"), F.count_if("there").alias("skipped"))


def update(points: DataFrame, key: str, value, **new) -> DataFrame:
    """Named existing columns of the row with a key get new values."""
    hit = F.col(key) == value
    return points.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in new.items() if c in points.columns})


def remove(points: DataFrame, key: str, value) -> DataFrame:
    return points.where(~F.col(key).eqNullSafe(F.lit(value)))


def _plain(c: Column, case: bool) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return text if case else F.lower(text)


def diff(source: DataFrame, target: DataFrame, key: str, columns: Sequence[str], case_sensitive: bool = False) -> DataFrame:
    """``(key, diff_type, field_diffs)``; null equals empty, case counts only if asked.

    One full outer join; removed rows are the source's alone, added the target's.
    """
    s, t = source.select(key, *columns).alias("s"), target.select(key, *columns).alias("t")
    both = s.join(t, F.col(f"s.{key}") == F.col(f"t.{key}"), "full_outer")
    fields = F.filter(
        F.array(
            *[
                F.when(
                    _plain(F.col(f"s.{c}"), case_sensitive) != _plain(F.col(f"t.{c}"), case_sensitive),
                    F.struct(
                        F.lit(c).alias("field_name"),
                        F.col(f"s.{c}").cast("string").alias("source_value"),
                        F.col(f"t.{c}").cast("string").alias("target_value"),
                    ),
                )
                for c in columns
            ]
        ),
        lambda x: x.isNotNull(),
    )
    kind = (
        F.when(F.col(f"t.{key}").isNull(), "removed")
        .when(F.col(f"s.{key}").isNull(), "added")
        .when(F.size(fields) > 0, "modified")
        .otherwise("unchanged")
    )
    none = F.array().cast("array<struct<field_name:string,source_value:string,target_value:string>>")
    return both.select(
        F.coalesce(f"s.{key}", f"t.{key}").alias(key),
        kind.alias("diff_type"),
        F.when(kind == "modified", fields).otherwise(none).alias("field_diffs"),
    )


def diff_ordered(found: DataFrame, key: str) -> DataFrame:
    """Removed, added, then common rows, each by key."""
    rank = F.when(F.col("diff_type") == "removed", 0).when(F.col("diff_type") == "added", 1).otherwise(2)
    return found.orderBy(rank, key)


def first_of_each(found: DataFrame, kind: str, key: str, n: int = 20) -> DataFrame:
    w = Window.partitionBy(kind).orderBy(key)
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def duplicates(points: DataFrame, by: Sequence[Column], member: str) -> DataFrame:
    """Groups with more than one member, members listed in order."""
    return (
        points.groupBy(*by)
        .agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(member)), ",").alias("members"))
        .where("n > 1")
    )


def only_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str, side: str) -> DataFrame:
    """``(side, k)``: keys of ``left`` without one in ``right``."""
    return left.join(right, left[left_key] == right[right_key], "left_anti").select(F.lit(side).alias("side"), left[left_key].alias("k"))


def spare_share(points: DataFrame, by: str, spare: Column) -> DataFrame:
    """``(by, spares, total, pct)``; 0 where a group is empty."""
    out = points.groupBy(by).agg(F.count_if(spare).alias("spares"), F.count("*").alias("total"))
    return out.withColumn("pct", F.round(F.coalesce(F.try_divide(100.0 * F.col("spares"), F.col("total")), F.lit(0.0)), 4))


def validate(points: DataFrame, key: str = "mnemonic", address: str = "plc_address", locations=()) -> DataFrame:
    """``(issue_type, severity, message, mnemonic)``; an internal tag is judged by no rule."""
    judged = points.where(~names.is_internal(F.col(key)))
    named = judged.select(F.col(key).alias("mnemonic"), F.explode(names.check_mnemonic(F.col(key), locations)).alias("issue_type"))
    missing = judged.where((F.coalesce(F.col(address), F.lit("")) == "") & ~names.is_spare(F.col(key))).select(
        F.col(key).alias("mnemonic"), F.lit("NO_ADDRESS").alias("issue_type")
    )
    shared = duplicates(judged.where(F.col(address) != ""), [F.upper(address).alias("addr")], key)
    issues = named.union(missing).select(
        "issue_type",
        F.when(F.col("issue_type").isin("LENGTH", "DOUBLE_UNDERSCORE"), "WARNING").otherwise("ERROR").alias("severity"),
        F.concat_ws(" ", "issue_type", "mnemonic").alias("message"),
        "mnemonic",
    )
    return issues.union(
        shared.select(
            F.lit("DUPLICATE_ADDRESS"), F.lit("ERROR"), F.concat_ws(" ", "addr", "members"), F.get(F.split("members", ","), 0)
        )
    )
