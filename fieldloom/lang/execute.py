"""Blocks run over rows: as one Column where the body allows it, else in Arrow batches.

Assignments, IF, CASE and FOR without a jump become Columns: each statement
binds the next state by a one-element ``transform``, a FOR is an ``aggregate``
over its sequence.  WHILE, REPEAT, EXIT, CONTINUE, RETURN and calls of other
blocks are run by ``scan``.  A null condition is false.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import parser as p
from .columns import compile_expression
from .start import literal_value, put, zero_value

STEPS = 1_000_000


class Unsupported(ValueError):
    """A statement that doesn't fit where it is asked for."""


def key(path: str) -> str:
    """A variable's name: its path without marks and indices."""
    return path.split("[", 1)[0].lstrip("#").replace('"', "")


def start_values(block: p.Block) -> dict[str, Any]:
    """What the block's own variables start from; inputs without a start value are zero too."""
    root: dict[str, Any] = {}
    for v in block.variables:
        value = literal_value(v.default) if v.default is not None else zero_value(v.data_type)
        if value is not None:
            put(root, f"{v.parent}.{v.name}" if v.parent else v.name, value)
    return root


# -- as Columns --------------------------------------------------------------


def compile_body(body: list[p.Node], values: dict[str, Column], types: dict[str, T.DataType]) -> Column:
    """A struct of all ``values`` after the statements; what is assigned is cast to ``types``."""
    names = list(values)
    shape = T.StructType([T.StructField(n, types[n]) for n in names])

    def state(now: dict[str, Column]) -> Column:
        return F.struct(*[now[n].alias(n) for n in names]).cast(shape)

    def value(node: p.Node, s: Column) -> Column:
        def column(path: str) -> Column:
            name = key(path)
            if name not in values:
                raise Unsupported(f"no value for {path}")
            if "[" not in path:
                return s[name]
            try:
                inner = p.parse_expression(path.split("[", 1)[1].rstrip("]"))
            except ValueError:
                raise Unsupported(path) from None
            return F.get(s[name], value(inner, s).cast("int"))

        try:
            return compile_expression(node, column)
        except (ValueError, TypeError) as e:
            raise Unsupported(str(e)) from None

    def truth(node: p.Node, s: Column) -> Column:
        return F.coalesce(value(node, s).cast("boolean"), F.lit(False))

    def assign(node: p.Assign, s: Column) -> Column:
        name = key(node.target.path)
        if name not in values:
            raise Unsupported(f"no value for {node.target.path}")
        got = value(node.value, s)
        if node.op != ":=":
            got = value(p.Binary(node.line, node.op[:-1], node.target, node.value), s)
        if node.target.indices:
            if len(node.target.indices) > 1 or not isinstance(types[name], T.ArrayType):
                raise Unsupported(f"{node.target.path} is no element of a list")
            at, of = value(node.target.indices[0], s).cast("int"), types[name].elementType
            new = got.cast(of)
            got = F.transform(s[name], lambda x, i: F.when(i == at, new).otherwise(x))
        return state({n: got.cast(types[n]) if n == name else s[n] for n in names})

    def one(node: p.Node) -> Callable[[Column], Column]:
        def run(s: Column) -> Column:
            if isinstance(node, p.Assign):
                return assign(node, s)
            if isinstance(node, p.Region):
                return many(node.body, s)
            if isinstance(node, p.If):
                arms, rest = [(truth(c, s), many(b, s)) for c, b in node.branches if c is not None], s
                for c, b in node.branches:
                    rest = many(b, s) if c is None else rest
            elif isinstance(node, p.Case):
                on = value(node.selector, s)
                fits = lambda x: on.between(value(x.left, s), value(x.right, s)) if isinstance(x, p.Binary) and x.op == ".." else on == value(x, s)
                arms = []
                for labels, body in node.branches:
                    when = F.lit(False)
                    for label in labels:
                        when = when | F.coalesce(fits(label), F.lit(False))
                    arms.append((when, many(body, s)))
                rest = many(node.default, s) if node.default is not None else s
            elif isinstance(node, p.For):
                name, step = key(node.variable.path), node.step or p.Literal(node.line, "1", "NUMBER")
                first, last, by = (value(x, s).cast("int") for x in (node.start, node.stop, step))
                ahead = ((by > 0) & (first <= last)) | ((by < 0) & (first >= last))
                turns = F.when(ahead, F.sequence(first, last, by)).otherwise(F.array().cast("array<int>"))
                turn = lambda acc, i: many(node.body, state({n: i if n == name else acc[n] for n in names}))
                if name not in values:
                    raise Unsupported(f"no value for {node.variable.path}")
                return F.aggregate(turns, state({n: s[n] for n in names}), turn)
            else:
                raise Unsupported(f"{type(node).__name__} in line {node.line}")
            out = state({n: rest[n] for n in names})
            for when, then in reversed(arms):
                out = F.when(when, then).otherwise(out)
            return out

        return run

    def many(body: list[p.Node], s: Column) -> Column:
        for node in body:
            s = F.get(F.transform(F.array(s), one(node)), 0)
        return s

    return many(body, state(values))


# -- step by step ------------------------------------------------------------


class Leave(Exception):
    pass


FUNCTIONS: dict[str, Callable] = {
    "ABS": abs, "SQR": lambda x: x * x, "SQRT": math.sqrt, "SIN": math.sin, "COS": math.cos, "TAN": math.tan, "ASIN": math.asin, "ACOS": math.acos,
    "ATAN": math.atan, "LN": math.log, "EXP": math.exp, "TRUNC": math.trunc, "MIN": min, "MAX": max,
    **dict.fromkeys(("INT_TO_REAL", "DINT_TO_REAL", "INT_TO_LREAL", "DINT_TO_LREAL"), float),
    **dict.fromkeys(("REAL_TO_INT", "REAL_TO_DINT", "INT_TO_DINT", "DINT_TO_INT", "BOOL_TO_INT"), int),
    "LOWER_BOUND": lambda a, dim=1: 0, "UPPER_BOUND": lambda a, dim=1: len(a) - 1,
}


def scan(body: list[p.Node], values: dict[str, Any], calls: dict[str, Callable[..., Any]] | None = None) -> dict[str, Any]:
    """The values after one run of the statements; a million statements are the limit.

    ``calls`` maps names to functions; one that is called as a statement gives
    a dict of its outputs.
    """
    state, left = json.loads(json.dumps(values)) if any(isinstance(v, (list, dict)) for v in values.values()) else dict(values), [STEPS]
    known = FUNCTIONS | {k.upper(): f for k, f in (calls or {}).items()}

    def place(ref: p.Ref) -> tuple[Any, Any]:
        """Container and key of a variable."""
        box, parts = state, key(ref.path).split(".")
        if key(ref.path) not in state:
            for part in parts[:-1]:
                box = box[part]
            name = parts[-1]
        else:
            name = key(ref.path)
        for node in ref.indices:
            box, name = box[name], int(of(node))
            if not 0 <= name < len(box):
                raise IndexError(f"{ref.path}: {name}")
        return box, name

    def of(node: p.Node) -> Any:
        if isinstance(node, p.Literal):
            text = node.text
            if node.kind == "STRING":
                return text[1:-1]
            return literal_value(text.split("#", 1)[1] if "#" in text and not text[0].isdigit() else text.replace("_", ""))
        if isinstance(node, p.Ref):
            box, name = place(node)
            return box[name]
        if isinstance(node, p.Unary):
            x = of(node.operand)
            return x if node.op == "+" else None if x is None else not x if node.op == "NOT" else -x
        if isinstance(node, p.Invoke):
            return call(node)
        if isinstance(node, p.Binary):
            a, b = of(node.left), of(node.right)
            if node.op in ("AND", "&"):
                return bool(a) and bool(b)
            if node.op == "OR":
                return bool(a) or bool(b)
            if a is None or b is None:
                return None
            return {
                "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b,
                "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "MOD": lambda: a % b, "**": lambda: a**b,
            }[node.op]()
        raise Unsupported(type(node).__name__)

    def call(node: p.Invoke) -> Any:
        name = node.target.strip('#"').upper()
        if name not in known:
            raise Unsupported(f"no function {node.target}")
        given = [(n, of(e)) for n, way, e in node.arguments if way != "=>"]
        return known[name](*[v for n, v in given if not n], **{n: v for n, v in given if n})

    def store(ref: p.Ref, value: Any) -> None:
        box, name = place(ref)
        old = box.get(name) if isinstance(box, dict) else box[name]
        if value is not None and isinstance(old, int) and not isinstance(old, bool) and isinstance(value, float):
            value = int(value)
        box[name] = value

    def run(body: list[p.Node]) -> None:
        for node in body:
            left[0] -= 1
            if left[0] < 0:
                raise RuntimeError("a block runs without end")
            if isinstance(node, p.Assign):
                got = of(node.value) if node.op == ":=" else of(p.Binary(node.line, node.op[:-1], node.target, node.value))
                store(node.target, got)
            elif isinstance(node, p.Region):
                run(node.body)
            elif isinstance(node, p.If):
                for condition, then in node.branches:
                    if condition is None or of(condition):
                        run(then)
                        break
            elif isinstance(node, p.Case):
                on = of(node.selector)
                fits = lambda x: of(x.left) <= on <= of(x.right) if isinstance(x, p.Binary) and x.op == ".." else on == of(x)  # noqa: B023, E731
                chosen = next((b for labels, b in node.branches if on is not None and any(map(fits, labels))), node.default)
                run(chosen or [])
            elif isinstance(node, p.For):
                by = int(of(node.step)) if node.step else 1
                turns = range(int(of(node.start)), int(of(node.stop)) + (1 if by > 0 else -1), by)
                loop(node.body, (store(node.variable, i) is None for i in turns))
            elif isinstance(node, p.Loop):
                loop(node.body, turns_of(node))
            elif isinstance(node, p.Jump):
                raise Leave(node.kind.upper())
            elif isinstance(node, p.CallStatement):
                got = call(node.call)
                for n, way, e in node.call.arguments:
                    if way == "=>" and isinstance(got, dict) and n in got and isinstance(e, p.Ref):
                        store(e, got[n])
            else:
                raise Unsupported(f"{type(node).__name__} in line {node.line}")

    def turns_of(node: p.Loop) -> Iterator[bool]:
        if node.kind.upper() == "WHILE":
            while of(node.condition):
                yield True
            return
        yield True
        while not of(node.condition):
            yield True

    def loop(body: list[p.Node], turns: Iterator[bool]) -> None:
        for _ in turns:
            left[0] -= 1
            if left[0] < 0:
                raise RuntimeError("a block runs without end")
            try:
                run(body)
            except Leave as e:
                if str(e) == "EXIT":
                    return
                if str(e) != "CONTINUE":
                    raise

    try:
        run(body)
    except Leave:
        pass
    return state


# -- over rows ---------------------------------------------------------------


def _plain(value: Any) -> Any:
    if hasattr(value, "tolist"):
        return value.tolist()
    return None if isinstance(value, float) and math.isnan(value) else value


def run_function(df: DataFrame, block: p.Block, calls: dict[str, Callable[..., Any]] | None = None) -> DataFrame:
    """Each row after one run: columns named as variables are read and written, other variables start anew.

    Outputs that aren't columns are added, typed by their start values.
    """
    fields = {f.name: f.dataType for f in df.schema}
    own = {n: v for n, v in start_values(block).items() if n not in fields and not isinstance(v, dict)}
    made = {n: T._infer_type(v) for n, v in own.items()}
    outputs = [v.name for v in block.variables if v.section == "VAR_OUTPUT" and v.name not in fields and v.name in own]
    used = {n: F.col(f"`{n}`") for n in fields if any(n == v.name for v in block.variables)}
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    columns = used | {n: lit(v) for n, v in own.items()}
    types = {n: fields.get(n) or made[n] for n in columns}
    try:
        done = compile_body(block.body, columns, types)
    except Unsupported:
        return _stepped(df, block, own, used, outputs, made, calls)
    after = df.select("*", done.alias("_after"))
    return after.select(*[F.col("_after")[n].alias(n) if n in used else F.col(f"`{n}`") for n in fields], *[F.col("_after")[n].alias(n) for n in outputs])


def _stepped(df, block, own, used, outputs, made, calls) -> DataFrame:
    names = list(used)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [scan(block.body, own | {n: _plain(r[n]) for n in names}, calls) for r in batch.to_dict("records")]
            for n in (*names, *outputs):
                batch[n] = pd.Series([r[n] for r in rows], index=batch.index, dtype=object)
            yield batch

    return df.mapInPandas(run, T.StructType([*df.schema.fields, *[T.StructField(n, made[n]) for n in outputs]]))


def run_cycles(df: DataFrame, block: p.Block, instance: str, order: tuple[str, ...], calls: dict[str, Callable[..., Any]] | None = None) -> DataFrame:
    """Rows as cycles of block instances: inputs are columns, all else is kept from cycle to cycle; outputs are added.

    Rows are spread by instance and sorted by ``order`` inside it, and read as a
    stream that holds the state of one instance, so a hot instance needs time,
    not memory.  Rows of a null instance are one instance.
    """
    start = start_values(block)
    inputs = [v.name for v in block.variables if v.section in ("VAR_INPUT", "VAR_IN_OUT") and v.name in df.columns]
    outputs = [v.name for v in block.variables if v.section == "VAR_OUTPUT"]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T._infer_type(start[n])) for n in outputs]])
    temps = {v.name for v in block.variables if v.section == "VAR_TEMP"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            got: list[dict] = []
            for row in batch.to_dict("records"):
                this = _plain(row[instance])
                if state is None or this != now:
                    now, state = this, start
                state = scan(block.body, state | {n: start[n] for n in temps if n in start} | {n: _plain(row[n]) for n in inputs}, calls)
                got.append({n: state[n] for n in outputs})
            yield batch.assign(**{n: pd.Series([g[n] for g in got], index=batch.index, dtype=object) for n in outputs})

    return df.repartition(instance).sortWithinPartitions(instance, *order).mapInPandas(run, schema)


def run_stream(df: DataFrame, block: p.Block, instance: str, order: str, calls: dict[str, Callable[..., Any]] | None = None) -> DataFrame:
    """``run_cycles`` over a stream: state is kept by instance between batches, rows of a batch in ``order``."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    start = start_values(block)
    inputs = [v.name for v in block.variables if v.section in ("VAR_INPUT", "VAR_IN_OUT") and v.name in df.columns]
    outputs = [v.name for v in block.variables if v.section == "VAR_OUTPUT"]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T._infer_type(start[n])) for n in outputs]])

    def run(_key: tuple, frames: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        state = json.loads(kept.get[0]) if kept.exists else start
        batch = pd.concat(list(frames)).sort_values(order, kind="stable")
        got: list[dict] = []
        for row in batch.to_dict("records"):
            state = scan(block.body, state | {n: _plain(row[n]) for n in inputs}, calls)
            got.append({n: state[n] for n in outputs})
        kept.update((json.dumps({k: v for k, v in state.items() if k not in inputs}),))
        yield batch.assign(**{n: [g[n] for g in got] for n in outputs})

    return df.groupBy(instance).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)
