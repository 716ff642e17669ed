"""Ladder networks: their rungs, and what a scan of them does to a row.

A program whose jumps all go forward becomes Columns: a jump is the label that
the rungs up to it wait for.  ``run_program`` makes each rung a projection;
``compile_program`` gives one Column, each rung binding the next state by a
one-element ``transform``, so that it grows with the rungs and not with their
product.  A program with a jump backward is run by ``scan``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Comparing contacts, arithmetic boxes.
COMPARE = ("GT", "LT", "GE", "LE", "EQ", "NE")
BOXES = ("Move", "Neg", "Mul", "Div", "Add", "Sub")
TOKEN = re.compile(r'\(\*.*?\*\)|//[^\n]*|\{.*?\}|"[^"]*"|wire#\w+|\w+#[\w.+-]+|:=|=>|[\w#%.\[\]-]+|\S', re.S)
BUDGET = 1000


class Unsupported(ValueError):
    """A rung of a shape that ladder programs here don't have."""


@dataclass(frozen=True)
class Contact:
    operand: str
    negated: bool = False


@dataclass(frozen=True)
class Comparison:
    op: str
    left: str
    right: str


@dataclass(frozen=True)
class Action:
    """``kind``: coil, jump, box or call; ``name`` is its operand, label, operator or block."""

    kind: str
    name: str
    inputs: tuple[tuple[str, str], ...] = ()
    outputs: tuple[tuple[str, str], ...] = ()


@dataclass
class Rung:
    """A rail (terms that all hold; of each term one contact) and its actions, or a label."""

    label: str | None = None
    rail: list[list[Contact | Comparison]] = field(default_factory=list)
    actions: list[Action] = field(default_factory=list)
    network: int = 0


def _words(source: str) -> list[str]:
    return [t for t in TOKEN.findall(source) if not t.startswith(("(*", "//", "{"))]


def _arguments(words: list[str], at: int) -> tuple[list[list[str]], int]:
    """Argument lists after an opening bracket, and the place past the closing one."""
    out: list[list[str]] = [[]]
    depth = 1
    while at < len(words):
        word = words[at]
        at += 1
        depth += (word == "(") - (word == ")")
        if not depth:
            return [a for a in out if a], at
        if word == "," and depth == 1:
            out.append([])
        else:
            out[-1].append(word)
    raise Unsupported("unclosed argument list")


def _element(name: str, arguments: list[list[str]]) -> Contact | Comparison | Action:
    first = "".join(arguments[0]) if arguments else ""
    if name in ("Contact", "I_Contact"):
        return Contact(first, name != "Contact")
    if name in ("Coil", "JumpCoil"):
        return Action("coil" if name == "Coil" else "jump", first)
    ins, outs = [], []
    for words in arguments:
        side = ins if ":=" in words else outs if "=>" in words else None
        if side is None:
            raise Unsupported(f"parameter without a name: {''.join(words)}")
        cut = words.index(":=" if side is ins else "=>")
        side.append(("".join(words[:cut]), "".join(words[cut + 1 :])))
    if name.endswith("_Contact") and name[:-8] in COMPARE:
        given = dict(ins)
        if not {"in1", "in2"} <= given.keys():
            raise Unsupported(f"{name} without in1 and in2")
        return Comparison(name[:-8], given["in1"], given["in2"])
    return Action("box" if name in BOXES else "call", name, tuple(ins), tuple(outs))


def _network(source: str, number: int) -> list[Rung]:
    """The rungs of one network; rungs that end on a wire are branches of the rung that shows it."""
    words, at = _words(source), 0
    rungs: list[Rung] = []
    taps: dict[str, list[tuple[Rung, int]]] = {}
    branches: list[tuple[str, list]] = []
    now: Rung | None = None
    while at < len(words):
        word = words[at]
        at += 1
        if word == "RUNG":
            now = Rung(network=number)
            at += at < len(words) and words[at].startswith("wire#")
        elif word == "END_RUNG":
            if now is not None and at < len(words) and words[at].startswith("wire#"):
                if now.actions:
                    raise Unsupported("a branch with an action")
                branches.append((words[at], [c for term in now.rail for c in term]))
                at += 1
            elif now is not None and (now.label or now.rail or now.actions):
                rungs.append(now)
            now = None
        elif word.startswith("wire#"):
            if now is not None:
                taps.setdefault(word, []).append((now, len(now.rail) - 1))
        elif at < len(words) and words[at] == "(":
            arguments, at = _arguments(words, at + 1)
            name = word.strip('"')
            if name == "Label":
                rungs.append(Rung(label="".join(arguments[0]) if arguments else "", network=number))
                continue
            if now is None:
                raise Unsupported(f"{name} outside a rung")
            found = _element(name, arguments)
            if isinstance(found, Action):
                now.actions.append(found)
            else:
                now.rail.append([found])
        elif now is not None and word != ";":
            raise Unsupported(f"{word} in a rung")
    for wire, contacts in branches:
        for rung, term in taps.get(wire, ()):
            if term < 0:
                raise Unsupported("a branch joins before any contact")
            rung.rail[term] = rung.rail[term] + contacts
    return rungs


def program(source: str) -> list[Rung]:
    """The rungs of a block's networks, in order."""
    found = re.findall(r"(?s)\bNETWORK\b(.*?)\bEND_NETWORK\b", source)
    return [rung for n, text in enumerate(found, 1) for rung in _network(text, n)]


def _name(operand: str) -> str:
    return operand.lstrip("#")


def operands(rungs: list[Rung]) -> tuple[list[str], list[str]]:
    """Names that a program reads, and names that it writes, in order of first use."""
    reads: dict[str, None] = {}
    writes: dict[str, None] = {}
    for rung in rungs:
        for c in (c for term in rung.rail for c in term):
            reads |= dict.fromkeys((c.operand,) if isinstance(c, Contact) else (c.left, c.right))
        for a in rung.actions:
            reads |= dict.fromkeys(o for _, o in a.inputs)
            writes |= dict.fromkeys([a.name] if a.kind == "coil" else [o for _, o in a.outputs])
    plain = lambda xs: list(dict.fromkeys(_name(x) for x in xs if _constant(x) is None))
    return plain(reads), plain(writes)


def _constant(operand: str) -> Any:
    if operand.lower() in ("true", "false"):
        return operand.lower() == "true"
    return int(operand) if re.fullmatch(r"-?\d+", operand) else None


def _box(op: str, given: dict[str, Any], native: bool) -> Any:
    """The value of a box; 32-bit, division toward zero, overflow raises."""
    if op == "Move":
        return given["in"]
    a, b = (0, given["in"]) if op == "Neg" else (given["in1"], given["in2"])
    if native:
        x, y = (F.lit(v).cast("int") if not isinstance(v, Column) else v.cast("int") for v in (a, b))
        if op == "Div":
            return F.call_function("div", x, y).cast("int")
        return x - y if op in ("Neg", "Sub") else x + y if op == "Add" else x * y
    if op == "Div":
        out = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
    else:
        out = a - b if op in ("Neg", "Sub") else a + b if op == "Add" else a * b
    if not -(2**31) <= out < 2**31:
        raise OverflowError(f"{op} leaves 32 bits")
    return out


def _compare(op: str, a: Any, b: Any) -> Any:
    return {
        "GT": lambda: a > b, "LT": lambda: a < b, "GE": lambda: a >= b, "LE": lambda: a <= b, "EQ": lambda: a == b, "NE": lambda: a != b,
    }[op]()


def scan(rungs: list[Rung], values: dict[str, Any], calls: dict[str, Callable[..., dict]] | None = None) -> dict[str, Any]:
    """The values after one scan; ``calls`` maps a block's name to a function of its inputs.

    Raises when jumps take more than 1,000 steps a rung.
    """
    state, at, steps = dict(values), 0, 0
    places = {r.label: i for i, r in enumerate(rungs) if r.label is not None}

    def read(operand: str) -> Any:
        fixed = _constant(operand)
        return state[_name(operand)] if fixed is None else fixed

    def holds(c: Contact | Comparison) -> bool:
        if isinstance(c, Comparison):
            return _compare(c.op, read(c.left), read(c.right))
        return bool(read(c.operand)) != c.negated

    while at < len(rungs):
        steps += 1
        if steps > BUDGET * (len(rungs) + 1):
            raise RuntimeError("a ladder program jumps without end")
        rung = rungs[at]
        at += 1
        power = all(any(holds(c) for c in term) for term in rung.rail)
        for action in rung.actions:
            if action.kind == "coil":
                state[_name(action.name)] = power
            elif power and action.kind == "jump":
                at = places[action.name]
                break
            elif power and action.kind == "box":
                out = _box(action.name, {k: read(o) for k, o in action.inputs}, False)
                state |= {_name(o): out for _, o in action.outputs}
            elif power:
                got = (calls or {})[action.name.strip('"')](**{k: read(o) for k, o in action.inputs})
                state |= {_name(o): got[k] for k, o in action.outputs if k in got}
    return state


def forward_only(rungs: list[Rung]) -> bool:
    places = {r.label: i for i, r in enumerate(rungs) if r.label is not None}
    return all(places.get(a.name, -1) > i for i, r in enumerate(rungs) for a in r.actions if a.kind == "jump")


def compile_program(rungs: list[Rung], values: dict[str, Column], calls: dict[str, Callable[..., dict]] | None = None) -> Column:
    """A struct of all names after one scan of a program without backward jumps.

    ``values`` holds every name that is read or written, ``calls`` functions of
    Columns.  A null operand makes a contact not conduct.
    """
    if not forward_only(rungs):
        raise Unsupported("a jump backward; use run_program")
    missing = set().union(*operands(rungs)) - values.keys()
    if missing:
        raise Unsupported(f"no value for {', '.join(sorted(missing))}")
    names = list(values)
    bound = lambda now, waits: F.struct(*[now[n].alias(n) for n in names], waits.alias("_skip"))
    state = bound(values, F.lit(None).cast("string"))
    for rung in rungs:
        step = lambda s: bound(*_after(rung, {n: s[n] for n in names}, s["_skip"], calls))  # noqa: B023, E731
        state = F.get(F.transform(F.array(state), step), 0)
    return F.get(F.transform(F.array(state), lambda s: F.struct(*[s[n].alias(n) for n in names])), 0)


def _after(rung: Rung, values: dict[str, Column], waits: Column, calls: dict[str, Callable[..., dict]] | None) -> tuple[dict[str, Column], Column]:
    """The values after a rung, and the label that the rungs below wait for (null if none)."""
    if rung.label is not None:
        return values, F.when(waits != rung.label, waits)
    now, here, power = dict(values), waits.isNull(), F.lit(True)

    def read(operand: str) -> Column:
        fixed = _constant(operand)
        return now[_name(operand)] if fixed is None else F.lit(fixed)

    def holds(c: Contact | Comparison) -> Column:
        if isinstance(c, Comparison):
            return F.coalesce(_compare(c.op, read(c.left), read(c.right)), F.lit(False))
        value = F.coalesce(read(c.operand).cast("boolean"), F.lit(False))
        return ~value if c.negated else value

    for term in rung.rail:
        one = F.lit(False)
        for c in term:
            one = one | holds(c)
        power = power & one

    def write(operand: str, value: Column, when: Column) -> None:
        now[_name(operand)] = F.when(when, value).otherwise(now[_name(operand)])

    runs = here & power
    for action in rung.actions:
        if action.kind == "coil":
            write(action.name, power, here)
        elif action.kind == "jump":
            # what stands behind a jump in its rung waits too
            waits = F.when(runs, F.lit(action.name)).otherwise(waits)
            here, runs = here & ~power, F.lit(False)
        else:
            given = {k: read(o) for k, o in action.inputs}
            if action.kind == "box":
                out = _box(action.name, given, True)
                got = {k: out for k, _ in action.outputs}
            else:
                got = (calls or {})[action.name.strip('"')](**given)
            for k, operand in action.outputs:
                if k in got:
                    write(operand, got[k], runs)
    return now, waits


def run_program(df: DataFrame, rungs: list[Rung], columns: dict[str, str] | None = None) -> DataFrame:
    """Every row after one scan, its columns being the names of the program.

    ``columns`` maps names to columns where they differ.  Without jumps backward
    each rung is a projection, all of them in one generated stage; jumps
    backward are followed in Arrow batches.
    """
    columns = columns or {}
    names = list(dict.fromkeys(n for side in operands(rungs) for n in side))
    where = {n: columns.get(n, n) for n in names}
    if forward_only(rungs):
        skip = "_skip"
        while skip in df.columns:
            skip = "_" + skip
        back, types = {c: n for n, c in where.items()}, {f.name: f.dataType for f in df.schema}
        now = df.withColumn(skip, F.lit(None).cast("string"))
        for rung in rungs:
            after, waits = _after(rung, {n: F.col(f"`{c}`") for n, c in where.items()}, F.col(skip), None)
            now = now.select(*[after[back[c]].cast(types[c]).alias(c) if c in back else F.col(f"`{c}`") for c in df.columns], waits.alias(skip))
        return now.drop(skip)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [scan(rungs, {n: row[c] for n, c in where.items()}) for row in batch.to_dict("records")]
            for n, c in where.items():
                batch[c] = pd.Series([r[n] for r in rows], index=batch.index, dtype=batch[c].dtype)
            yield batch

    return df.mapInPandas(run, df.schema)


def contacts(rungs: list[Rung]) -> list[dict]:
    """A row a contact or action: network, rung, kind, name, operand, negated, term."""
    rows = []
    for i, rung in enumerate(rungs):
        base = {"network": rung.network, "rung": i, "term": None, "negated": False, "operand": None}
        if rung.label is not None:
            rows.append(base | {"kind": "label", "name": rung.label})
        for t, term in enumerate(rung.rail):
            for c in term:
                if isinstance(c, Contact):
                    rows.append(base | {"term": t, "kind": "contact", "name": "Contact", "operand": _name(c.operand), "negated": c.negated})
                else:
                    rows.append(base | {"term": t, "kind": "compare", "name": c.op, "operand": f"{_name(c.left)},{_name(c.right)}"})
        for a in rung.actions:
            shown = _name(a.name) if a.kind == "coil" else ",".join(_name(o) for _, o in a.outputs) or None
            rows.append(base | {"kind": a.kind, "name": "Coil" if a.kind == "coil" else a.name, "operand": shown})
    return rows


RUNGS = "path string, network int, rung int, term int, kind string, name string, operand string, negated boolean, error string"


def ladder_rows(files: DataFrame) -> DataFrame:
    """``RUNGS`` of texts (path, text); a text that isn't a known ladder has one row with ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = [part.split()[0] for part in RUNGS.split(", ")]
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"]):
                try:
                    out += [row | {"path": path, "error": None} for row in contacts(program(text or ""))]
                except Unsupported as e:
                    out.append(dict.fromkeys(keys) | {"path": path, "error": str(e)})
            yield pd.DataFrame(out, columns=keys).astype({"network": "Int32", "rung": "Int32", "term": "Int32", "negated": "boolean"})

    return files.select("path", "text").mapInPandas(run, RUNGS)
