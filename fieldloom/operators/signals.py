"""Signals over time: edges, timers, flash and stability checks, waits, snapshots, ring traces.

Everything but the pulse timer is a window over one exchange and one sort by
signal and total order; intervals are in microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _order(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order)


def edges(samples: DataFrame, key: str, order: tuple[str, ...], value: Column) -> DataFrame:
    """Adds ``rising`` and ``falling``; before the first sample a signal is false."""
    prev = F.coalesce(F.lag(value).over(_order(key, *order)), F.lit(False))
    return samples.withColumns({"rising": value & ~prev, "falling": ~value & prev})


def runs(samples: DataFrame, key: str, order: tuple[str, ...], value: Column) -> DataFrame:
    """Adds ``v`` and ``run``, the number of the stretch of equal values that a sample is in."""
    w = _order(key, *order)
    x = samples.withColumn("v", value)
    x = x.withColumn("_p", F.lag("v").over(w))
    changed = F.when(F.col("_p").isNull() | (F.col("_p") != F.col("v")), 1).otherwise(0)
    return x.withColumn("run", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_p")


def on_delay(samples: DataFrame, key: str, order: tuple[str, ...], value: Column, preset_us: int) -> DataFrame:
    """Adds ``q`` and ``et_us``: true once the input has been true for the preset."""
    x = runs(samples, key, order, value)
    start = F.first(_us(F.col(order[0]))).over(Window.partitionBy(key, "run").orderBy(*order))
    et = _us(F.col(order[0])) - start
    return x.withColumns(
        {
            "q": F.col("v") & (et >= preset_us),
            "et_us": F.when(F.col("v"), F.least(et, F.lit(preset_us))).otherwise(F.lit(0)),
        }
    )


def off_delay(samples: DataFrame, key: str, order: tuple[str, ...], value: Column, preset_us: int) -> DataFrame:
    """Adds ``q``: true while the input is, and until the preset has passed since it fell."""
    w = _order(key, *order)
    x = samples.withColumn("v", value)
    fell = F.when(~F.col("v") & F.coalesce(F.lag("v").over(w), F.lit(False)), _us(F.col(order[0])))
    x = x.withColumn("_fell", fell)
    last = F.last("_fell", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    et = _us(F.col(order[0])) - last
    return x.withColumns({"q": F.col("v") | F.coalesce(et < preset_us, F.lit(False)), "et_us": F.when(~F.col("v"), et)}).drop("_fell")


def retentive_on_delay(
    samples: DataFrame, key: str, order: tuple[str, ...], value: Column, reset: Column, preset_us: int | None = None
) -> DataFrame:
    """Adds ``et_us`` (and ``q`` with a preset): time before each true sample adds up until a reset; q latches."""
    w = _order(key, *order)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    x = samples.withColumns({"v": value, "r": reset})
    x = x.withColumn("dt", _us(F.col(order[0])) - F.lag(_us(F.col(order[0]))).over(w))
    x = x.withColumn("grp", F.sum(F.when(F.col("r"), 1).otherwise(0)).over(up_to))
    g = Window.partitionBy(key, "grp").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    add = F.when(F.col("v") & ~F.col("r"), F.coalesce("dt", F.lit(0))).otherwise(0)
    x = x.withColumn("et_us", F.sum(add).over(g))
    if preset_us is not None:
        x = x.withColumn("q", F.max((F.col("et_us") >= preset_us) & ~F.col("r")).over(g))
    return x.drop("dt", "grp")


def pulse(samples: DataFrame, key: str, order: tuple[str, ...], value: Column, preset_us: int) -> DataFrame:
    """``(key, order..., q, et_us)``: a pulse of fixed length, which a new edge can't prolong.

    The state of a pulse depends on where the last one ended, which no window
    frame expresses; one ordered pass a signal.
    """
    cols = samples.select(key, *order, value.alias("v"), _us(F.col(order[0])).alias("t"))
    schema = f"{cols.select(key, *order)._jdf.schema().toDDL()}, q boolean, et_us long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable", ignore_index=True)
        q, et, began, prev = [], [], None, False
        for v, t in zip(pdf["v"].tolist(), pdf["t"].tolist()):
            if began is not None and t - began >= preset_us:
                began = None
            if began is None and v and not prev:
                began = t
            prev = v
            q.append(began is not None)
            et.append(0 if began is None else t - began)
        return pdf[[key, *order]].assign(q=q, et_us=et)

    return cols.groupBy(key).applyInPandas(run, schema)


def flash_intervals(samples: DataFrame, key: str, order: tuple[str, ...], value: Column) -> DataFrame:
    """``(key, transitions, on_us, off_us)``: completed stretches and the time in them."""
    x = runs(samples, key, order, value)
    s = x.groupBy(key, "run").agg(F.bool_and("v").alias("v"), F.min(_us(F.col(order[0]))).alias("t0"))
    d = s.withColumn("dur", F.lead("t0").over(_order(key, "run")) - F.col("t0"))
    return d.groupBy(key).agg(
        F.count("dur").alias("transitions"),
        F.sum(F.when(F.col("v"), F.col("dur"))).alias("on_us"),
        F.sum(F.when(~F.col("v"), F.col("dur"))).alias("off_us"),
    )


def flash_verdict(samples: DataFrame, key: str, order: tuple[str, ...], value: Column, on_us: float, off_us: float, tolerance: float) -> DataFrame:
    """``(key, true_ratio, transitions, verdict)``: FAILED under 5 % true, WARNING on few or ill-timed changes.

    The first stretch began before the samples did; averages leave it out.
    """
    x = runs(samples, key, order, value)
    s = x.groupBy(key, "run").agg(
        F.bool_and("v").alias("v"), F.min(_us(F.col(order[0]))).alias("t0"), F.count("*").alias("n")
    )
    d = s.withColumn("dur", F.lead("t0").over(_order(key, "run")) - F.col("t0"))
    inner = F.col("run") > 1
    g = d.groupBy(key).agg(
        F.try_divide(F.sum(F.when(F.col("v"), F.col("n")).otherwise(0)), F.sum("n")).alias("true_ratio"),
        (F.count("*") - 1).alias("transitions"),
        F.avg(F.when(F.col("v") & inner, F.col("dur"))).alias("_on"),
        F.avg(F.when(~F.col("v") & inner, F.col("dur"))).alias("_off"),
    )
    misfit = (F.abs(F.col("_on") - on_us) > tolerance * on_us) | (F.abs(F.col("_off") - off_us) > tolerance * off_us)
    verdict = (
        F.when(F.col("true_ratio") < 0.05, "FAILED")
        .when(F.col("transitions") < 2, "WARNING")
        .when(F.coalesce(misfit, F.lit(False)), "WARNING")
        .otherwise("PASSED")
    )
    return g.select(key, "true_ratio", "transitions", verdict.alias("verdict"))


def within(samples: DataFrame, key: str, ts: str, seconds: float | None) -> DataFrame:
    """The samples of each signal from its first one on, for so many seconds (all if None)."""
    if seconds is None:
        return samples
    begin = samples.groupBy(key).agg(F.min(ts).alias("_begin"))
    until = _us(F.col("_begin")) + F.lit(int(seconds * 1_000_000))
    return samples.join(begin, key).where(_us(F.col(ts)) <= until).drop("_begin")


def stable(samples: DataFrame, key: str, ts: str, holds: Column, seconds: float | None = None) -> DataFrame:
    """``(key, stable, first_dev)`` over the first ``seconds`` of a signal, or all of it."""
    samples = within(samples, key, ts, seconds)
    return samples.groupBy(key).agg(F.bool_and(holds).alias("stable"), F.min(F.when(~holds, F.col(ts))).alias("first_dev"))


def wait_outcome(samples: DataFrame, key: str, ts: str, value: str, match: Column, seconds: float) -> DataFrame:
    """``(key, met, at, value)``: a signal's first match before its time is up, else its last sample by then."""
    seen = within(samples, key, ts, seconds)
    first = F.min_by(F.struct(F.col(ts).alias("at"), F.col(value).alias("value")), F.when(match, F.col(ts)))
    last = F.max_by(F.struct(F.col(ts).alias("at"), F.col(value).alias("value")), ts)
    found = seen.groupBy(key).agg(F.bool_or(match).alias("met"), first.alias("_f"), last.alias("_l"))
    picked = F.when(F.col("met"), F.col("_f")).otherwise(F.col("_l"))
    return found.select(key, "met", picked["at"].alias("at"), picked["value"].alias("value"))


def wait_until(samples: DataFrame, key: str, ts: str, match: Column, seconds: float | None = None) -> DataFrame:
    """``(key, met_at)`` of signals that match, within ``seconds`` of their first sample if given."""
    samples = within(samples, key, ts, seconds)
    return samples.where(match).groupBy(key).agg(F.min(ts).alias("met_at"))


def latest(samples: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return samples.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def capture_until(samples: DataFrame, key: str, ts: str, match: Column) -> DataFrame:
    """Samples up to the first match of their signal, all if there is none."""
    met = samples.where(match).groupBy(key).agg(F.min(ts).alias("_met"))
    return samples.join(met, key, "left").where(F.col("_met").isNull() | (F.col(ts) <= F.col("_met"))).drop("_met")


def ring_trace(samples: DataFrame, key: str, order: tuple[str, ...], value: str, every: int, depth: int, cycle_s: float) -> DataFrame:
    """``(key, cyc, t_rel_s, value)``: one cycle in ``every``, the newest ``depth`` of them."""
    w = _order(key, *order)
    c = samples.withColumn("cyc", F.row_number().over(w).cast("long"))
    s = c.where((F.col("cyc") - 1) % every == 0)
    s = s.withColumn("_back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cyc"))))
    return s.where(F.col("_back") <= depth).select(key, "cyc", (F.col("cyc") * F.lit(float(cycle_s))).alias("t_rel_s"), value)


def ring_rows(recordings: DataFrame, key: str, fields: list[str], depth: int, cycle_ms: float) -> DataFrame:
    """Ring buffers (write_idx, wrapped, sample_cycles and an array a field) to rows, oldest first."""
    zipped = F.posexplode(F.arrays_zip("sample_cycles", *fields)).alias("pos", "row")
    x = recordings.select(key, "write_idx", "wrapped", zipped)
    age = F.when(F.col("wrapped"), F.pmod(F.col("pos") - F.col("write_idx"), F.lit(depth))).otherwise(F.col("pos"))
    kept = x.withColumn("n", age).where(F.col("wrapped") | (F.col("pos") < F.col("write_idx")))
    return kept.select(
        key, "n", F.col("row.sample_cycles").alias("cycle"), (F.col("row.sample_cycles") * (cycle_ms / 1000)).alias("t_rel_s"), *[f"row.{f}" for f in fields]
    )


def record(cycles: DataFrame, key: str, order: str, start: str, decimation: str, depth: int, one_shot: bool, fields: list[str]) -> DataFrame:
    """What a trace block has in its buffer after the last cycle: ``(key, order, fields)``, oldest first.

    A rising start clears the buffer, a low one stops it; the countdown takes
    the first cycle and reloads from the decimation of the cycle it fires in.
    """
    cols = cycles.select(key, order, start, decimation, *fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        kept: list[int] = []
        prev, count = False, 1
        for i, (on, k) in enumerate(zip(pdf[start].tolist(), pdf[decimation].tolist())):
            if on and not prev:
                kept, count = [], 1
            prev = bool(on)
            if not on or one_shot and len(kept) >= depth:
                continue
            count -= 1
            if count <= 0:
                kept.append(i)
                if len(kept) > depth:
                    kept.pop(0)
                count = max(1, int(k))
        return pdf.loc[kept, [key, order, *fields]]

    return cols.groupBy(key).applyInPandas(run, cols.select(key, order, *fields).schema)


def sequence_steps(steps: DataFrame, key: str, order: str, fn, out: str) -> DataFrame:
    """A stateful block over ordered input steps: ``fn(iterator of row dicts) -> iterator of row dicts``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: Iterator[dict] = iter(pdf.sort_values(order).to_dict("records"))
        return pd.DataFrame(list(fn(rows)), columns=[x.strip().split(" ")[0] for x in out.split(",")])

    return steps.groupBy(key).applyInPandas(run, out)
