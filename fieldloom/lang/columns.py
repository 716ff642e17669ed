"""Expression trees of the controller language as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.values import BUILTINS, modulo

from . import parser as p


def literal(text: str, kind: str) -> Column:
    """Numbers, booleans, strings, durations in seconds and based integers, with chained prefixes."""
    if kind == "BOOL":
        return F.lit(text.upper() == "TRUE")
    if kind == "STRING":
        return F.lit(text[1:-1])
    if kind == "TIME":
        body, total = text.split("#", 1)[1].lower(), 0.0
        for n, unit in re.findall(r"(\d+)(ms|us|ns|d|h|m|s)", body):
            total += int(n) * {"d": 86400, "h": 3600, "m": 60, "s": 1, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}[unit]
        return F.lit(total)
    body = text.replace("_", "")
    if "#" in body:
        *prefix, digits = body.split("#")
        if prefix[-1] in ("2", "8", "16"):
            return F.lit(int(digits, int(prefix[-1])))
        return literal(digits, "BOOL" if digits.upper() in ("TRUE", "FALSE") else "NUMBER")
    return F.lit(float(body) if re.search(r"[.eE]", body) else int(body))


def compile_expression(node: p.Node, column: Callable[[str], Column] = lambda path: F.col(path.lstrip("#").strip('"'))) -> Column:
    """A tree as a Column; ``column`` maps a variable's path.  XOR is refused, as in the language."""
    go = lambda x: compile_expression(x, column)
    if isinstance(node, p.Literal):
        return literal(node.text, node.kind)
    if isinstance(node, p.Ref):
        return column(node.path)
    if isinstance(node, p.Unary):
        return ~go(node.operand) if node.op == "NOT" else -go(node.operand) if node.op == "-" else go(node.operand)
    if isinstance(node, p.Invoke):
        name = node.target.strip('#"').upper()
        if name not in BUILTINS:
            raise ValueError(f"{node.target} is no built-in function")
        return BUILTINS[name](*[go(e) for _, _, e in node.arguments])
    if isinstance(node, p.Binary):
        a, b = go(node.left), go(node.right)
        table = {
            "AND": lambda: a & b, "OR": lambda: a | b, "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b,
            ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b,
            "*": lambda: a * b, "/": lambda: a.cast("double") / b, "MOD": lambda: modulo(a, b), "**": lambda: F.pow(a, b),
        }
        if node.op not in table:
            raise ValueError(f"the operator {node.op} is not supported")
        return table[node.op]()
    raise ValueError(f"{type(node).__name__} is no expression")


def expression(source: str, column: Callable[[str], Column] | None = None) -> Column:
    node = p.parse_expression(source)
    return compile_expression(node, column) if column else compile_expression(node)
