"""Parsed statements."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Agg:
    name: str
    arg: object | None


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object = None  # a value, a tuple of literals, a (low, high) pair or a Select


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Exists:
    select: object


@dataclass(frozen=True)
class Join:
    collection: str
    alias: str
    left: str
    right: str
    outer: bool


@dataclass
class Select:
    collection: str
    alias: str
    items: list  # (value or None for *, alias or None)
    joins: list = field(default_factory=list)
    distinct: bool = False
    where: object = None
    group: list = field(default_factory=list)
    having: object = None
    order: list = field(default_factory=list)  # (name, descending)
    limit: int | None = None
    offset: int = 0
    near: str | None = None
    text: str = ""

    @property
    def bare_count(self) -> bool:
        return self.items == [(Agg("COUNT", None), None)] and not (self.group or self.having or self.distinct)


@dataclass
class Statement:
    kind: str
    body: dict
    explain: bool = False


def signature(node) -> str:
    """A value's default column name."""
    match node:
        case None:
            return "*"
        case Lit(bool(v)):
            return "true" if v else "false"
        case Lit(None):
            return "NULL"
        case Lit(str(v)):
            return f"'{v}'"
        case Lit(v):
            return repr(v)
        case Name(n):
            return n
        case Op(o, a, b):
            return f"{signature(a)} {o} {signature(b)}"
        case Call(n, args):
            return f"{n}({', '.join(map(signature, args))})"
        case Agg(n, a):
            return f"{n}({signature(a)})"
    raise TypeError(node)


def aggregates(node) -> list[Agg]:
    """All aggregates of a value or predicate, on either side of a comparison."""
    match node:
        case Agg():
            return [node]
        case Op(_, a, b) | Compare(_, a, b):
            return aggregates(a) + (aggregates(b) if not isinstance(b, (tuple, Select)) else [])
        case Call(_, parts) | Both(parts) | Either(parts):
            return [x for p in parts for x in aggregates(p)]
        case Not(p):
            return aggregates(p)
    return []


def names(node) -> list[str]:
    """All names that a value or predicate uses, without its subqueries."""
    match node:
        case Name(n):
            return [n]
        case Op(_, a, b) | Compare(_, a, b):
            return names(a) + (names(b) if not isinstance(b, (tuple, Select)) else [])
        case Call(_, parts) | Both(parts) | Either(parts):
            return [x for p in parts for x in names(p)]
        case Not(p) | Agg(_, p):
            return names(p)
    return []


def subqueries(node) -> list[Select]:
    match node:
        case Exists(s) | Compare(_, _, Select() as s):
            return [s]
        case Both(parts) | Either(parts):
            return [x for p in parts for x in subqueries(p)]
        case Not(p):
            return subqueries(p)
    return []


def collections(select: Select) -> set[str]:
    """Every collection that a query reads, subqueries included."""
    found = {select.collection, *(j.collection for j in select.joins)}
    for part in (select.where, select.having):
        for s in subqueries(part):
            found |= collections(s)
    return found
