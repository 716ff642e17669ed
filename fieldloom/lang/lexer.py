"""Tokens of the controller language by one alternation of named patterns."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str
    value: str
    line: int
    column: int


#: Words of the language.
KEYWORDS = frozenset(
    """FUNCTION FUNCTION_BLOCK ORGANIZATION_BLOCK DATA_BLOCK TYPE STRUCT END_FUNCTION END_FUNCTION_BLOCK
    END_ORGANIZATION_BLOCK END_DATA_BLOCK END_TYPE END_STRUCT VAR VAR_INPUT VAR_OUTPUT VAR_IN_OUT VAR_TEMP VAR_STATIC
    VAR_EXTERNAL END_VAR CONSTANT RETAIN BEGIN NETWORK END_NETWORK REGION END_REGION RUNG END_RUNG IF THEN ELSIF ELSE END_IF CASE OF
    END_CASE FOR TO BY DO END_FOR WHILE END_WHILE REPEAT UNTIL END_REPEAT RETURN EXIT CONTINUE AND OR XOR NOT MOD DIV TRUE
    FALSE ARRAY""".split()
)

PATTERN = re.compile(
    r"""(?P<COMMENT>\(\*.*?(?:\*\)|\Z)|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<TIME>(?:LTIME|TIME|LT|T|TOD|DT|D|DATE|LDT|DTL)\#[\w.:+-]+)
    |(?P<TYPED>(?:[A-Za-z_]\w*\#)*(?:2|8|16)\#[0-9A-Fa-f_]+|[A-Za-z_]\w*\#[+-]?[\w.]+)
    |(?P<NUMBER>\d[\d_]*(?:\.(?!\.)\d+)?(?:[eE][+-]?\d+)?)
    |(?P<LOCAL>\#[A-Za-z_]\w*|\#"[^"\n]*")
    |(?P<QUOTED>"[^"\n]*")
    |(?P<STRING>'(?:[^'$\n]|\$.)*')
    |(?P<ADDRESS>%[A-Za-z]+\d+(?:\.\d+)?)
    |(?P<SLICE>%[XBWD]\d+)
    |(?P<NAME>[A-Za-z_À-ɏ][\wÀ-ɏ]*)
    |(?P<OP>:=|=>|<>|<=|>=|\*\*|\.\.|\+=|-=|\*=|/=|[-+*/=<>&(),;:.\[\]{}\#?!|@$%^~\\`])
    |(?P<NEWLINE>\n)
    |(?P<SPACE>[ \t\r\f\v﻿ ]+)
    |(?P<OTHER>.)""",
    re.VERBOSE | re.DOTALL,
)


def tokenize(source: str, keep_newlines: bool = False, keep_comments: bool = False) -> list[Token]:
    """Tokens in order; no character but white space and comments is lost."""
    out, line, begin = [], 1, 0
    for m in PATTERN.finditer(source):
        kind, text = m.lastgroup, m[0]
        at = (line, m.start() - begin + 1)
        if kind == "NAME" and text.upper() in KEYWORDS:
            kind = "KEYWORD"
            out.append(Token(kind, text.upper(), *at))
        elif kind == "NEWLINE":
            if keep_newlines:
                out.append(Token(kind, text, *at))
        elif kind == "COMMENT":
            if keep_comments:
                out.append(Token(kind, text, *at))
        elif kind != "SPACE":
            out.append(Token(kind, text, *at))
        if n := text.count("\n"):
            line += n
            begin = m.start() + text.rindex("\n") + 1
    return out
