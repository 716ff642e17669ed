"""Blocks, statements and expressions.

Expressions are parsed by binding power.  Statements recover at the next
``;``: what could not be read is kept as an ``Unread`` node, so that every
token of a body is accounted for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .lexer import Token, tokenize


@dataclass
class Node:
    line: int


@dataclass
class Literal(Node):
    text: str
    kind: str


@dataclass
class Ref(Node):
    """A variable: its path as written, without spaces; indices are expressions of their own."""

    path: str
    indices: list[Node] = field(default_factory=list)


@dataclass
class Unary(Node):
    op: str
    operand: Node


@dataclass
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass
class Invoke(Node):
    """A call; arguments are (name, direction, expression), direction ``:=``, ``=>`` or empty."""

    target: str
    arguments: list[tuple[str, str, Node]]


@dataclass
class Assign(Node):
    target: Ref
    op: str
    value: Node


@dataclass
class CallStatement(Node):
    call: Invoke


@dataclass
class If(Node):
    branches: list[tuple[Node | None, list[Node]]]


@dataclass
class Case(Node):
    selector: Node
    branches: list[tuple[list[Node], list[Node]]]
    default: list[Node] | None


@dataclass
class For(Node):
    variable: Ref
    start: Node
    stop: Node
    step: Node | None
    body: list[Node]


@dataclass
class Loop(Node):
    """WHILE, or REPEAT whose condition ends it."""

    kind: str
    condition: Node
    body: list[Node]


@dataclass
class Jump(Node):
    kind: str


@dataclass
class Region(Node):
    name: str
    body: list[Node]


@dataclass
class Unread(Node):
    tokens: list[Token]


@dataclass
class Variable:
    section: str
    name: str
    data_type: str
    default: str | None
    line: int
    parent: str = ""
    constant: bool = False


@dataclass
class Block:
    name: str
    kind: str
    attributes: dict[str, str]
    variables: list[Variable]
    body: list[Node]
    return_type: str = ""
    base_type: str = ""
    networks: int = 0


class Stop(Exception):
    pass


#: Binding powers, weakest first; ``**`` binds to the right.
POWER = {
    "OR": 1, "XOR": 1, "AND": 2, "&": 2, "=": 3, "<>": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5,
    "MOD": 5, "DIV": 5, "**": 7,
}
UNARY_POWER = 6
BLOCK_KINDS = ("FUNCTION_BLOCK", "FUNCTION", "ORGANIZATION_BLOCK", "DATA_BLOCK", "TYPE")
SECTIONS = ("VAR", "VAR_INPUT", "VAR_OUTPUT", "VAR_IN_OUT", "VAR_TEMP", "VAR_STATIC", "VAR_EXTERNAL")


class Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else Token("END", "", self.tokens[-1].line if self.tokens else 1, 0)

    def next(self) -> Token:
        token = self.peek()
        self.at += 1
        return token

    def take(self, *values: str) -> Token | None:
        token = self.peek()
        if token.value in values and token.kind in ("OP", "KEYWORD"):
            return self.next()
        return None

    def need(self, *values: str) -> Token:
        if token := self.take(*values):
            return token
        raise Stop(f"line {self.peek().line}: {' or '.join(values)} expected, {self.peek().value!r} found")

    # -- expressions

    def expression(self, power: int = 0) -> Node:
        left = self.operand()
        while (p := POWER.get(self.peek().value, -1)) > power and self.peek().kind in ("OP", "KEYWORD"):
            op = self.next()
            right = self.expression(p - 1 if op.value == "**" else p)
            left = Binary(op.line, "AND" if op.value == "&" else op.value, left, right)
        return left

    def operand(self) -> Node:
        token = self.peek()
        if token.value in ("NOT", "-", "+") and token.kind in ("OP", "KEYWORD"):
            self.next()
            return Unary(token.line, token.value, self.expression(UNARY_POWER))
        if self.take("("):
            inner = self.expression()
            self.need(")")
            return inner
        if token.kind in ("NUMBER", "TIME", "STRING") or token.value in ("TRUE", "FALSE"):
            self.next()
            return Literal(token.line, token.value, "BOOL" if token.kind == "KEYWORD" else token.kind)
        if token.kind == "TYPED":
            self.next()
            return Literal(token.line, token.value, "TYPED")
        if token.kind in ("NAME", "LOCAL", "QUOTED", "ADDRESS"):
            ref = self.reference()
            if self.peek().value == "(" and self.peek().kind == "OP":
                return Invoke(token.line, ref.path, self.arguments())
            return ref
        raise Stop(f"line {token.line}: an operand expected, {token.value!r} found")

    def reference(self) -> Ref:
        token = self.next()
        if token.kind not in ("NAME", "LOCAL", "QUOTED", "ADDRESS"):
            raise Stop(f"line {token.line}: a name expected, {token.value!r} found")
        path, indices = token.value, []
        while True:
            if self.peek().value == "." and self.peek(1).kind in ("NAME", "QUOTED", "KEYWORD", "NUMBER", "ADDRESS", "SLICE"):
                self.next()
                path += f".{self.next().value}"
            elif self.peek().value == "[":
                self.next()
                inner = [self.expression()]
                while self.take(","):
                    inner.append(self.expression())
                self.need("]")
                path += f"[{','.join(map(text_of, inner))}]"
                indices += inner
            else:
                return Ref(token.line, path, indices)

    def arguments(self) -> list[tuple[str, str, Node]]:
        self.need("(")
        out: list[tuple[str, str, Node]] = []
        while not self.take(")"):
            if self.peek(1).value in (":=", "=>") and self.peek().kind in ("NAME", "QUOTED", "LOCAL", "KEYWORD"):
                name, way = self.next().value, self.next().value
                out.append((name, way, self.expression()))
            else:
                out.append(("", "", self.expression()))
            if not self.take(",") and self.peek().value != ")":
                raise Stop(f"line {self.peek().line}: , or ) expected")
        return out

    # -- statements

    def statements(self, *ends: str) -> list[Node]:
        out: list[Node] = []
        while self.peek().kind != "END" and not (self.peek().value in ends and self.peek().kind == "KEYWORD"):
            if self.take(";"):
                continue
            if self.peek().value == "{":
                self.pragma()
                continue
            begun = self.at
            try:
                out.append(self.statement())
            except Stop:
                self.at = begun
                out.append(self.unread(ends))
        return out

    def unread(self, ends: tuple[str, ...]) -> Unread:
        lost = [self.next()]
        while self.peek().kind != "END" and self.peek().value != ";" and not (self.peek().value in ends and self.peek().kind == "KEYWORD"):
            lost.append(self.next())
        return Unread(lost[0].line, lost)

    def pragma(self) -> dict[str, str]:
        self.need("{")
        out, depth, key = {}, 1, None
        while depth and self.peek().kind != "END":
            token = self.next()
            if token.value == "{":
                depth += 1
            elif token.value == "}":
                depth -= 1
            elif self.peek().value == ":=":
                key = token.value
            elif key and token.value != ":=":
                out[key] = token.value.strip("\"'")
                key = None
        return out

    def statement(self) -> Node:
        token = self.peek()
        line, word = token.line, token.value if token.kind == "KEYWORD" else ""
        if word == "IF":
            self.next()
            branches: list[tuple[Node | None, list[Node]]] = []
            condition: Node | None = self.expression()
            self.need("THEN")
            while True:
                branches.append((condition, self.statements("ELSIF", "ELSE", "END_IF")))
                if self.take("ELSIF"):
                    condition = self.expression()
                    self.need("THEN")
                elif self.take("ELSE"):
                    condition = None
                else:
                    self.need("END_IF")
                    return If(line, branches)
        if word == "CASE":
            return self.case(line)
        if word == "FOR":
            self.next()
            variable = self.reference()
            self.need(":=")
            start = self.expression()
            self.need("TO")
            stop = self.expression()
            step = self.expression() if self.take("BY") else None
            self.need("DO")
            body = self.statements("END_FOR")
            self.need("END_FOR")
            return For(line, variable, start, stop, step, body)
        if word == "WHILE":
            self.next()
            condition = self.expression()
            self.need("DO")
            body = self.statements("END_WHILE")
            self.need("END_WHILE")
            return Loop(line, word, condition, body)
        if word == "REPEAT":
            self.next()
            body = self.statements("UNTIL")
            self.need("UNTIL")
            condition = self.expression()
            self.take(";")
            self.need("END_REPEAT")
            return Loop(line, word, condition, body)
        if word in ("RETURN", "EXIT", "CONTINUE"):
            self.next()
            return Jump(line, word)
        if word == "REGION":
            self.next()
            name = []
            while self.peek().line == line and self.peek().kind != "END":
                name.append(self.next().value)
            body = self.statements("END_REGION")
            self.need("END_REGION")
            return Region(line, " ".join(name), body)
        ref = self.reference()
        if self.peek().value == "(":
            return CallStatement(line, Invoke(line, ref.path, self.arguments()))
        op = self.need(":=", "+=", "-=", "*=", "/=")
        return Assign(line, ref, op.value, self.expression())

    def case(self, line: int) -> Case:
        self.need("CASE")
        selector = self.expression()
        self.need("OF")
        branches: list[tuple[list[Node], list[Node]]] = []
        default = None
        while not self.take("END_CASE"):
            if self.take("ELSE"):
                self.take(":")
                default = self.statements("END_CASE")
                continue
            labels = [self.label()]
            while self.take(","):
                labels.append(self.label())
            self.need(":")
            branches.append((labels, self.case_body()))
        return Case(line, selector, branches, default)

    def label(self) -> Node:
        first = self.expression(3)
        if dots := self.take(".."):
            return Binary(dots.line, "..", first, self.expression(3))
        return first

    def case_body(self) -> list[Node]:
        """Statements up to what reads as the next label."""
        out: list[Node] = []
        while self.peek().kind != "END" and self.peek().value not in ("ELSE", "END_CASE"):
            if self.take(";"):
                continue
            if self.at_label():
                break
            begun = self.at
            try:
                out.append(self.statement())
            except Stop:
                self.at = begun
                out.append(self.unread(("ELSE", "END_CASE")))
        return out

    def at_label(self) -> bool:
        begun = self.at
        try:
            self.label()
            while self.take(","):
                self.label()
            return self.peek().value == ":"
        except Stop:
            return False
        finally:
            self.at = begun

    # -- blocks

    def block(self) -> Block:
        attributes: dict[str, str] = {}
        while self.peek().value == "{":
            attributes |= self.pragma()
        kind = self.need(*BLOCK_KINDS).value
        while self.peek().value == "{":
            attributes |= self.pragma()
        name = self.next().value.strip('"')
        out = Block(name, kind, attributes, [], [])
        if self.take(":"):
            if kind == "TYPE":
                self.members("TYPE", "", out)
                return out
            out.return_type = self.type_text()
        elif kind == "DATA_BLOCK" and self.peek().kind == "QUOTED":
            out.base_type = self.next().value.strip('"')
        elif kind == "TYPE":
            self.members("TYPE", "", out)
            return out
        while self.peek().kind != "END" and self.peek().value != f"END_{kind}":
            if self.peek().value == "{":
                attributes |= self.pragma()
            elif self.peek().value in SECTIONS:
                self.section(out)
            elif self.peek().value == "STRUCT":
                self.members("VAR", "", out)
            elif self.take("NETWORK"):
                out.networks += 1
            elif not self.take("BEGIN", "END_NETWORK", "END_STRUCT", ";"):
                got = self.statements("NETWORK", "END_NETWORK", f"END_{kind}")
                out.body += got
                if not got and self.peek().value not in ("NETWORK", "END_NETWORK", f"END_{kind}"):
                    out.body.append(Unread(self.peek().line, [self.next()]))
        return out

    def section(self, out: Block) -> None:
        word = self.next().value
        constant = bool(self.take("CONSTANT"))
        self.take("RETAIN")
        while not self.take("END_VAR") and self.peek().kind != "END":
            self.variable("CONSTANT" if constant else word, "", out, constant)

    def members(self, section: str, parent: str, out: Block) -> None:
        self.take("STRUCT")
        while not self.take("END_STRUCT") and self.peek().kind != "END" and self.peek().value != "END_TYPE":
            self.variable(section, parent, out, False)
        self.take(";")

    def variable(self, section: str, parent: str, out: Block, constant: bool) -> None:
        if self.peek().value == "{":
            self.pragma()
            return
        if self.take(";"):
            return
        token = self.next()
        names = [token.value.strip('"')]
        while self.take(","):
            names.append(self.next().value.strip('"'))
        if self.peek().value == "{":
            self.pragma()
        if not self.take(":"):
            if self.peek().value == ":=":  # a start value of a data block
                self.next()
                out.variables.append(Variable("START", names[0], "", self.until(";"), token.line, parent))
            return
        if self.peek().value == "STRUCT":
            for name in names:
                out.variables.append(Variable(section, name, "Struct", None, token.line, parent, constant))
            self.members(section, f"{parent}.{names[0]}" if parent else names[0], out)
            return
        kind = self.type_text()
        default = self.until(";") if self.take(":=") else None
        self.take(";")
        for name in names:
            out.variables.append(Variable(section, name, kind, default, token.line, parent, constant))

    def type_text(self) -> str:
        parts = []
        while self.peek().kind != "END" and self.peek().value not in (":=", ";", "{") and self.peek().value not in (*SECTIONS, "END_VAR", "NETWORK"):
            parts.append(self.next().value)
        text = " ".join(parts)
        for tight in (" [", "[ ", " ]", " . . ", " .. ", " ,"):
            text = text.replace(tight, tight.strip().replace(" ", ""))
        return text

    def until(self, end: str) -> str:
        parts = []
        while self.peek().kind != "END" and self.peek().value not in (end, "END_VAR"):
            parts.append(self.next().value)
        return "".join(parts)


def text_of(node: Node) -> str:
    """Canonical text of an expression."""
    if isinstance(node, Literal):
        return node.text
    if isinstance(node, Ref):
        return node.path
    if isinstance(node, Unary):
        return f"{node.op} {text_of(node.operand)}" if node.op == "NOT" else f"{node.op}{text_of(node.operand)}"
    if isinstance(node, Binary):
        sides = [
            f"({text_of(x)})" if isinstance(x, Binary) and POWER.get(x.op, 9) < POWER.get(node.op, 0) else text_of(x)
            for x in (node.left, node.right)
        ]
        return f"{sides[0]} {node.op} {sides[1]}"
    if isinstance(node, Invoke):
        return f"{node.target}({', '.join(f'{n} {w} {text_of(e)}' if n else text_of(e) for n, w, e in node.arguments)})"
    return ""


def parse_block(source: str) -> Block:
    return Parser(tokenize(source)).block()


def parse_statements(source: str) -> list[Node]:
    return Parser(tokenize(source)).statements()


def parse_expression(source: str) -> Node:
    """An expression that takes up the whole text, else ValueError."""
    parser = Parser(tokenize(source))
    try:
        node = parser.expression()
    except Stop as e:
        raise ValueError(str(e)) from None
    if parser.peek().kind != "END":
        raise ValueError(f"{parser.peek().value!r} is left over")
    return node
