"""Facts of a parsed block: accesses, calls, assignments, variables, states, layout inputs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from . import parser as p


@dataclass(frozen=True)
class Access:
    path: str
    kind: str
    line: int
    statement: str
    expression: str
    element: str


def references(node: p.Node | None) -> Iterator[p.Ref]:
    """Variables read by an expression, indices included."""
    if isinstance(node, p.Ref):
        yield node
        for i in node.indices:
            yield from references(i)
    elif isinstance(node, p.Unary):
        yield from references(node.operand)
    elif isinstance(node, p.Binary):
        yield from references(node.left)
        yield from references(node.right)
    elif isinstance(node, p.Invoke):
        for _, way, e in node.arguments:
            if way != "=>":
                yield from references(e)


def invocations(node: p.Node | None) -> Iterator[p.Invoke]:
    if isinstance(node, p.Invoke):
        yield node
        for _, _, e in node.arguments:
            yield from invocations(e)
    elif isinstance(node, p.Unary):
        yield from invocations(node.operand)
    elif isinstance(node, p.Binary):
        yield from invocations(node.left)
        yield from invocations(node.right)


def walk(body: list[p.Node], context: tuple[str, ...] = ()) -> Iterator[tuple[p.Node, tuple[str, ...]]]:
    """Every statement with the conditions it stands under."""
    for s in body:
        yield s, context
        if isinstance(s, p.If):
            for condition, inner in s.branches:
                yield from walk(inner, (*context, p.text_of(condition) if condition else "ELSE"))
        elif isinstance(s, p.Case):
            for labels, inner in s.branches:
                yield from walk(inner, (*context, f"{p.text_of(s.selector)} = {', '.join(map(p.text_of, labels))}"))
            yield from walk(s.default or [], (*context, f"{p.text_of(s.selector)} ELSE"))
        elif isinstance(s, (p.For, p.Loop, p.Region)):
            yield from walk(s.body, context)


def accesses(block: p.Block) -> list[Access]:
    out: list[Access] = []

    def reads(node: p.Node | None, statement: str, element: str) -> None:
        for r in references(node):
            out.append(Access(r.path, "read", r.line, statement, p.text_of(node), element))
        for call in invocations(node):
            outputs(call, statement)

    def outputs(call: p.Invoke, statement: str) -> None:
        for name, way, e in call.arguments:
            if way == "=>" and isinstance(e, p.Ref):
                out.append(Access(e.path, "write", e.line, statement, f"{call.target}.{name}", "call_out"))

    for s, _ in walk(block.body):
        if isinstance(s, p.Assign):
            text = f"{s.target.path} {s.op} {p.text_of(s.value)}"
            out.append(Access(s.target.path, "write", s.line, text, p.text_of(s.value), "assignment"))
            if s.op != ":=":
                out.append(Access(s.target.path, "read", s.line, text, p.text_of(s.value), "assignment"))
            for i in s.target.indices:
                reads(i, text, "index")
            reads(s.value, text, "assignment")
        elif isinstance(s, p.CallStatement):
            text = p.text_of(s.call)
            for _, way, e in s.call.arguments:
                if way != "=>":
                    reads(e, text, "call_in")
            outputs(s.call, text)
        elif isinstance(s, p.If):
            for condition, _ in s.branches:
                reads(condition, p.text_of(condition) if condition else "", "condition")
        elif isinstance(s, p.Case):
            reads(s.selector, p.text_of(s.selector), "selector")
        elif isinstance(s, p.For):
            out.append(Access(s.variable.path, "write", s.line, "FOR", p.text_of(s.start), "for"))
            for e in (s.start, s.stop, s.step):
                reads(e, "FOR", "for")
        elif isinstance(s, p.Loop):
            reads(s.condition, p.text_of(s.condition), "condition")
    return out


def calls(block: p.Block) -> list[tuple[str, str, int]]:
    """(target as written, kind, line) of every call in the body."""
    out = []
    for s, _ in walk(block.body):
        found: list[p.Invoke] = []
        if isinstance(s, p.CallStatement):
            found += invocations(s.call)
        elif isinstance(s, p.Assign):
            found += invocations(s.value)
        elif isinstance(s, p.If):
            for c, _ in s.branches:
                found += invocations(c)
        for call in found:
            kind = "instance" if call.target.startswith("#") else "instance_db" if call.target.startswith('"') else "function"
            out.append((call.target.strip('#"'), kind, call.line))
    return out


def assignments(block: p.Block) -> list[tuple[str, str, str, int]]:
    """(target, expression, condition, line); conditions joined with AND."""
    return [
        (s.target.path, p.text_of(s.value), " AND ".join(context), s.line)
        for s, context in walk(block.body)
        if isinstance(s, p.Assign)
    ]


def unread_tokens(block: p.Block) -> int:
    return sum(len(s.tokens) for s, _ in walk(block.body) if isinstance(s, p.Unread))


def state_machine(block: p.Block) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """States (name, value) and transitions (from, to, condition) of the first CASE that assigns its selector."""
    constants = {v.name: v.default or "" for v in block.variables if v.constant}

    def name_of(node: p.Node) -> str:
        return p.text_of(node).lstrip("#").strip('"')

    for s, _ in walk(block.body):
        if not isinstance(s, p.Case):
            continue
        selector = p.text_of(s.selector)
        states = [(name_of(label), constants.get(name_of(label), name_of(label))) for labels, _ in s.branches for label in labels]
        moves = []
        for labels, body in s.branches:
            for inner, context in walk(body):
                if isinstance(inner, p.Assign) and inner.target.path == selector:
                    for label in labels:
                        moves.append((name_of(label), name_of(inner.value), " AND ".join(context)))
        if moves:
            return states, moves
    return [], []


def flat_statements(block: p.Block) -> list[tuple[int, str]]:
    """(line, text) of simple statements with their context; what a semantic comparison compares."""
    out = []
    for s, context in walk(block.body):
        if isinstance(s, p.Assign):
            out.append((s.line, " / ".join((*context, f"{s.target.path} {s.op} {p.text_of(s.value)}"))))
        elif isinstance(s, p.CallStatement):
            out.append((s.line, " / ".join((*context, p.text_of(s.call)))))
        elif isinstance(s, p.Jump):
            out.append((s.line, " / ".join((*context, s.kind))))
    return out
