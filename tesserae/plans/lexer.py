"""Tokens of the query language."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..errors import EngineError

#: Reserved words of the language.
KEYWORDS = frozenset(
    """add alter and as asc begin between by collection collections commit contains count create delete desc describe
    distinct drop duplicate embedding exists explain false field from group having in index indexes inner insert into
    is join left like limit not null offset on or order rename rollback select set show table to transaction true
    unique update values view where""".upper().split()
)
MOST_BYTES = 256 * 1024


class Token(NamedTuple):
    kind: str  # word, name, number, text, mark, end
    value: object
    at: int


_PARTS = re.compile(
    r"""(?P<skip>\s+|--[^\n]*)
    |(?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*")
    |(?P<quoted>`[^`]+`)
    |(?P<number>\d+(?:\.\d+)?)
    |(?P<name>[^\W\d]\w*(?:\.[^\W\d]\w*)*(?:\.\*)?)
    |(?P<mark><->|<=|>=|<>|!=|==|[-+*/%(),;=<>])""",
    re.X,
)


def tokens(statement: str) -> list[Token]:
    if len(statement.encode("utf-8", "replace")) > MOST_BYTES:
        raise EngineError("the statement is longer than 256 KB")
    out, at = [], 0
    while at < len(statement):
        m = _PARTS.match(statement, at)
        if not m:
            raise EngineError(f"unexpected character {statement[at]!r} at {at}")
        kind, s = m.lastgroup, m.group()
        if kind == "text":
            out.append(Token("text", s[1:-1].replace(s[0] * 2, s[0]), at))
        elif kind == "number":
            out.append(Token("number", float(s) if "." in s else int(s), at))
        elif kind == "quoted":
            out.append(Token("name", s[1:-1], at))
        elif kind == "name":
            word = s.upper()
            out.append(Token("word", word, at) if word in KEYWORDS else Token("name", s, at))
        elif kind == "mark":
            out.append(Token("mark", {"==": "=", "<>": "!="}.get(s, s), at))
        at = m.end()
    return [*out, Token("end", None, at)]
