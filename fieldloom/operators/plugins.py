"""Rules and step types that a project adds to those here.

A rule is a function from subjects to ``(subject, line, message)``; a step type
one from samples and its arguments to one row ``(passed, message)``.  Both are
plans, so a run of many is one union that Spark schedules as it likes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Check = Callable[[DataFrame], DataFrame]
Step = Callable[[DataFrame, dict], DataFrame]


@dataclass
class Registry:
    """Rules by code, steps by type; a code or type that is given again replaces the one before."""

    rules: dict[str, tuple[str, Check]] = field(default_factory=dict)
    steps: dict[str, Step] = field(default_factory=dict)

    def rule(self, code: str, severity: str = "WARNING") -> Callable[[Check], Check]:
        def register(check: Check) -> Check:
            self.rules[code] = (severity, check)
            return check

        return register

    def step(self, kind: str) -> Callable[[Step], Step]:
        def register(execute: Step) -> Step:
            self.steps[kind.lower()] = execute
            return execute

        return register

    def violations(self, subjects: DataFrame, only: Iterable[str] | None = None, without: Iterable[str] = ()) -> DataFrame:
        """``(rule_code, severity, subject, line, message)`` of the rules that are on; an unknown code raises."""
        wanted = list(self.rules) if only is None else list(only)
        unknown = [c for c in wanted if c not in self.rules]
        if unknown:
            raise KeyError(f"no rule {', '.join(unknown)}")
        found = []
        for code in wanted:
            if code not in set(without):
                severity, check = self.rules[code]
                rows = check(subjects).select(F.col("subject").cast("string"), F.col("line").cast("int"), F.col("message").cast("string"))
                found.append(rows.select(F.lit(code).alias("rule_code"), F.lit(severity).alias("severity"), "*"))
        if not found:
            return subjects.sparkSession.createDataFrame([], "rule_code string, severity string, subject string, line int, message string")
        return reduce(DataFrame.unionAll, found)

    def run(self, samples: DataFrame, steps: list[dict]) -> DataFrame:
        """``(ord, step, passed, message)`` of a scenario's steps; a type that isn't registered raises."""
        out = []
        for n, given in enumerate(steps):
            kind = str(given.get("step", "")).lower()
            if kind not in self.steps:
                raise KeyError(f"no step type {kind!r}")
            got = self.steps[kind](samples, {k: v for k, v in given.items() if k != "step"})
            out.append(got.select(F.lit(n).alias("ord"), F.lit(kind).alias("step"), F.col("passed").cast("boolean"), F.col("message").cast("string")))
        if not out:
            return samples.sparkSession.createDataFrame([], "ord int, step string, passed boolean, message string")
        return reduce(DataFrame.unionAll, out)
