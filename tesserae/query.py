"""Fluent queries: the same syntax trees as statements, and the same lowering."""

from __future__ import annotations

from dataclasses import replace as _replace

from pyspark.sql import DataFrame, Row

from .errors import EngineError
from .plans.lower import Scope
from .plans.parser import parse
from .plans.syntax import Both, Compare, Join, Lit, Name, Not, Select
from .profiles import require

UNARY = {"IS NULL": False, "IS NOT NULL": True}


def comparison(field: str, op: str, value=None):
    op = op.upper().strip()
    name = Name(field)
    if op in UNARY:
        found = Compare("null", name)
        return Not(found) if UNARY[op] else found
    negated = op.startswith("NOT ")
    op = op.removeprefix("NOT ")
    match op:
        case "IN":
            found = Compare("in", name, tuple(Lit(v) for v in value))
        case "LIKE" | "CONTAINS":
            found = Compare(op.lower(), name, Lit(value))
        case "BETWEEN":
            found = Compare("between", name, (Lit(value[0]), Lit(value[1])))
        case "=" | "==" | "!=" | "<>" | "<" | "<=" | ">" | ">=":
            found = Compare({"==": "=", "<>": "!="}.get(op, op), name, Lit(value))
        case _:
            raise EngineError(f"unknown operator {op}")
    return Not(found) if negated else found


class Query:
    """Immutable: every step gives a new query."""

    def __init__(self, engine, collection: str, spec: Select | None = None) -> None:
        self.engine = engine
        self.spec = spec or Select(collection, collection, [(None, None)])

    def _with(self, **changes) -> Query:
        return Query(self.engine, self.spec.collection, _replace(self.spec, **changes))

    def where(self, field: str, *rest) -> Query:
        """(field, value), (field, unary operator) or (field, operator, value); steps are joined by AND."""
        if len(rest) == 1:
            unary = isinstance(rest[0], str) and rest[0].upper() in UNARY
            node = comparison(field, rest[0]) if unary else comparison(field, "=", rest[0])
        else:
            node = comparison(field, *rest)
        return self.where_expr(node)

    def where_expr(self, node) -> Query:
        """A predicate, as a tree or as text of the query language."""
        if isinstance(node, str):
            node = parse(f"SELECT * FROM x WHERE {node}").body["select"].where
        return self._with(where=node if self.spec.where is None else Both((self.spec.where, node)))

    def join(self, collection: str, here: str, there: str, left: bool = False) -> Query:
        require(self.engine.profile, "joins")
        j = Join(collection, collection, here, f"{collection}.{there}", left)
        return self._with(joins=[*self.spec.joins, j])

    def order_by(self, field: str, direction: str = "asc") -> Query:
        return self._with(order=[*self.spec.order, (field, direction.lower() == "desc")])

    def limit(self, n: int) -> Query:
        return self._with(limit=max(0, n))

    def offset(self, n: int) -> Query:
        return self._with(offset=max(0, n))

    def select(self, *fields: str) -> Query:
        return self._with(items=[(Name(f), None) for f in fields])

    def df(self) -> DataFrame:
        spec = self.spec
        if spec.items != [(None, None)]:
            # absent fields stay absent
            scope = self.engine.lowering().base(_replace(spec, where=None))
            there = [(v, a) for v, a in spec.items if scope.name(v.name).kind != "null" or isinstance(scope, Scope) and v.name in scope.df.columns]
            spec = _replace(spec, items=there or spec.items)
        return self.engine.lowering().select(spec)

    def get(self) -> list[Row]:
        return self.df().collect()

    def first(self) -> Row | None:
        return self.limit(1).df().first()

    def count(self) -> int:
        return self.engine.lowering().select(_replace(self.spec, items=[(None, None)], order=[], limit=None, offset=0)).count()

    def plan(self) -> dict:
        s = self.spec
        return {"collection": s.collection, "where": s.where, "order": s.order, "limit": s.limit, "offset": s.offset}
