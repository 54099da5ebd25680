"""Lowering of parsed queries to DataFrames.

FROM, joins, WHERE, grouping, HAVING, projection, DISTINCT, ORDER BY, OFFSET
and LIMIT, in this order, as one lazy plan that Catalyst optimises.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import scalars, values
from ..functions.values import Value, lit
from ..operators.joins import column, hash_join, prefixed
from .syntax import Agg, Both, Call, Compare, Either, Exists, Lit, Name, Not, Op, Select, aggregates, names, signature

#: Hidden columns that carry what HAVING and ORDER BY need beside the result.
HIDDEN = "__q_"


class Scope:
    """Names that a query can use; absent ones are null."""

    def __init__(self, df: DataFrame, first: str | None = None, aliases: tuple[str, ...] = ()) -> None:
        self.df, self.first, self.aliases = df, first, aliases
        self.extra: dict[object, Value] = {}

    def name(self, name: str) -> Value:
        if name in self.extra:
            return self.extra[name]
        tried = [name] if self.first is None else [name, f"{self.first}.{name}"]
        if self.first is None and "." in name and name.split(".", 1)[0] in self.aliases:
            tried.append(name.split(".", 1)[1])
        for n in tried:
            found = column(self.df, n)
            if found is not None:
                return found
        return lit(None)

    def value(self, node) -> Value:
        match node:
            case Lit(v):
                return lit(v)
            case Name(n):
                return self.name(n)
            case Op(o, a, b):
                return values.arithmetic(o, self.value(a), self.value(b))
            case Call(n, args):
                return scalars.call(n, [self.value(a) for a in args])
            case Agg():
                if node in self.extra:
                    return self.extra[node]
                raise EngineError(f"{signature(node)} can't stand here")
        raise TypeError(node)


class Lowering:
    """source(name) gives a collection's DataFrame; near(select) plans a similarity query."""

    def __init__(self, source: Callable[[str], DataFrame], near: Callable[[Select], DataFrame] | None = None, guard=None) -> None:
        self.source, self.near, self.guard = source, near, guard

    def read(self, name: str) -> DataFrame:
        if self.guard is not None:
            self.guard(name)
        return self.source(name)

    # FROM

    def base(self, s: Select) -> Scope:
        df = self.read(s.collection)
        if not s.joins:
            return Scope(df, None, (s.alias, s.collection))
        aliases = [s.alias]
        df = prefixed(df, s.alias)
        for j in s.joins:
            if j.alias in aliases:
                raise EngineError(f"the alias {j.alias} is used twice")
            right = prefixed(self.read(j.collection), j.alias)
            here, there = self.sides(df, right, aliases, j)
            df = hash_join(df, right, here, there, j.outer)
            aliases.append(j.alias)
        return Scope(df, s.alias, tuple(aliases))

    @staticmethod
    def sides(left: DataFrame, right: DataFrame, aliases: list[str], j) -> tuple[str, str]:
        """The ON names as (column of the left, column of the right), whichever way they were written."""
        a, b = j.left, j.right
        if a.startswith(f"{j.alias}.") and not b.startswith(f"{j.alias}."):
            a, b = b, a
        elif not b.startswith(f"{j.alias}.") and "." not in a and "." not in b:
            # bare names: the side that only the joined collection has is the right one
            here = lambda n: f"{aliases[0]}.{n}" in left.columns
            there = lambda n: f"{j.alias}.{n}" in right.columns
            if not (here(a) and there(b)) or (here(b) and there(a)):
                a, b = b, a
        here = a if a in left.columns else f"{aliases[0]}.{a}"
        return here, b if b in right.columns else f"{j.alias}.{b}"

    # predicates

    def condition(self, node, scope: Scope, loose: bool = False) -> Column:
        """A predicate as a column: never null, or with ``loose`` perhaps null for false, as a filter's parts may be."""
        match node:
            case Both(parts):
                return reduce(lambda a, b: a & b, [self.condition(p, scope, loose) for p in parts])
            case Either(parts):
                return reduce(lambda a, b: a | b, [self.condition(p, scope, loose) for p in parts])
            case Not(p):
                return ~self.condition(p, scope)
            case Exists(s):
                self.uncorrelated(s)
                return self.select(s).exists()  # one lookup when the query runs, none when it is planned
            case Compare("in", left, Select() as s):
                raise EngineError("a subquery can't stand here")
            case Compare("in", left, items):
                return values.among(scope.value(left), [scope.value(i) for i in items], loose)
            case Compare("like", left, right):
                return values.like(scope.value(left), right.value)
            case Compare("contains", left, right):
                return values.contains(scope.value(left), scope.value(right))
            case Compare("between", left, (low, high)):
                return values.between(scope.value(left), scope.value(low), scope.value(high), loose)
            case Compare("null", left):
                v = scope.value(left)
                return F.lit(True) if v.kind == "null" else v.col.isNull()
            case Compare(op, left, right):
                return values.compare(op, scope.value(left), scope.value(right), loose)
        raise TypeError(node)

    def uncorrelated(self, s: Select) -> None:
        own = {s.alias, s.collection, *(j.alias for j in s.joins), *(j.collection for j in s.joins)}
        for part in [v for v, _ in s.items if v is not None] + [p for p in (s.where, s.having) if p is not None]:
            for n in names(part):
                if "." in n and n.split(".", 1)[0] not in own and n not in self.read(s.collection).columns:
                    raise EngineError(f"{n}: a subquery can't use names of the query around it")

    def restrict(self, scope: Scope, node) -> Scope:
        """Rows for which a predicate holds. IN (SELECT) becomes a join against the distinct values."""
        df, marks = scope.df, []

        def replaced(p):
            nonlocal df
            match p:
                case Both(parts):
                    return Both(tuple(map(replaced, parts)))
                case Either(parts):
                    return Either(tuple(map(replaced, parts)))
                case Not(q):
                    return Not(replaced(q))
                case Compare("in", left, Select() as s):
                    self.uncorrelated(s)
                    mark = f"{HIDDEN}in{len(marks)}"
                    marks.append(mark)
                    df = self.marked(Scope(df, scope.first, scope.aliases), left, self.select(s), mark)
                    return Compare("=", Name(mark), Lit(True))
            return p

        if isinstance(node, Compare) and node.op == "in" and isinstance(node.right, Select):
            return self.semi(scope, node, "left_semi")
        if isinstance(node, Not) and isinstance(node.part, Compare) and node.part.op == "in" and isinstance(node.part.right, Select):
            return self.semi(scope, node.part, "left_anti")
        if isinstance(node, Both):
            for p in node.parts:
                scope = self.restrict(scope, p)
            return scope
        changed = replaced(node)
        inner = Scope(df, scope.first, scope.aliases)
        inner.extra = dict(scope.extra)
        out = df.where(self.condition(changed, inner, loose=True))
        found = Scope(out.drop(*marks), scope.first, scope.aliases)
        found.extra = scope.extra
        return found

    @staticmethod
    def first_column(sub: DataFrame) -> tuple[DataFrame, Value]:
        sub = sub.select(F.col(f"`{sub.columns[0]}`").alias(f"{HIDDEN}v"))
        return sub, column(sub, f"{HIDDEN}v")

    def semi(self, scope: Scope, node: Compare, how: str) -> Scope:
        self.uncorrelated(node.right)
        sub, right = self.first_column(self.select(node.right))
        left = scope.value(node.left)
        out = Scope(scope.df.join(sub, self.matching(left, right), how), scope.first, scope.aliases)
        out.extra = scope.extra
        return out

    @staticmethod
    def matching(left: Value, right: Value) -> Column:
        """Equality as a join condition, with an equi-key wherever the types allow one."""
        kinds = {left.kind, right.kind}
        if len(kinds) == 1 or (left.number and right.number) or "null" in kinds:
            return values.equal(left, right)
        if "text" in kinds and kinds <= {"text", "int", "float", "time"}:

            def view(v: Value) -> Column:
                if "time" in kinds:
                    return values.instant(v)
                return values.as_double(v) if v.number else values.numeric_text(v, values.EQUAL_NUMBER)

            # a text without such a view is (null, false), which the other side never is
            x, y = (F.struct(view(v).alias("v"), v.col.isNull().alias("n")) for v in (left, right))
            return x == y
        return left.col.isNull() & right.col.isNull()

    def marked(self, scope: Scope, left_node, sub: DataFrame, mark: str) -> DataFrame:
        """df with a boolean that says whether the value is among the subquery's."""
        sub, right = self.first_column(sub)
        sub = sub.distinct().withColumn(mark, F.lit(True))
        right = column(sub, f"{HIDDEN}v")
        joined = scope.df.join(sub, self.matching(scope.value(left_node), right), "left")
        return joined.withColumn(mark, F.coalesce(F.col(mark), F.lit(False))).drop(f"{HIDDEN}v")

    # SELECT

    def select(self, s: Select) -> DataFrame:
        if s.near is not None:
            if self.near is None:
                raise EngineError("similarity queries need an engine")
            return self.near(s)
        scope = self.base(s)
        if s.where is not None:
            scope = self.restrict(scope, s.where)
        grouped = bool(s.group) or any(aggregates(v) for v, _ in s.items if v is not None)
        return self.grouped(s, scope) if grouped else self.plain(s, scope)

    def star(self, scope: Scope) -> list[tuple[str, Value]]:
        out = {}
        for c in scope.df.columns:
            if c.startswith(HIDDEN):
                continue
            if scope.first is not None and c.startswith(f"{scope.first}."):
                out.setdefault(c.split(".", 1)[1], column(scope.df, c))
        for c in scope.df.columns:
            if not c.startswith(HIDDEN):
                out.setdefault(c, column(scope.df, c))
        return list(out.items())

    def projected(self, s: Select, scope: Scope) -> dict[str, Value]:
        """Output columns by name; a star's fields come first and win."""
        out: dict[str, Value] = {}
        if any(v is None for v, _ in s.items):
            out.update(self.star(scope))
        for v, alias in s.items:
            if v is not None:
                name = alias or signature(v)
                if name not in out:
                    out[name] = scope.value(v)
        return out

    def plain(self, s: Select, scope: Scope) -> DataFrame:
        out = self.projected(s, scope)
        hidden = {}
        for n, _ in s.order:
            if n not in out:
                hidden[f"{HIDDEN}o_{n}"] = scope.name(n)
        return self.finish(s, scope.df, out, hidden)

    def grouped(self, s: Select, scope: Scope) -> DataFrame:
        wanted = [a for v, _ in s.items if v is not None for a in aggregates(v)]
        if s.having is not None:
            wanted += aggregates(s.having)
        wanted = list(dict.fromkeys(wanted))
        keys = {g: scope.name(g) for g in s.group}
        rest = {n for v, _ in s.items if v is not None for n in names_outside(v)} - set(keys)
        rest |= set(names_outside(s.having)) - set(keys) if s.having is not None else set()
        rest |= {n for n, _ in s.order} - set(keys)
        if any(v is None for v, _ in s.items):
            rest |= {n for n, _ in self.star(scope)} - set(keys)
        rest = sorted(n for n in rest if scope.name(n).kind != "null")
        order = scope.name("id")
        aggs, made = [], {}
        for i, a in enumerate(wanted):
            col, kind = self.aggregate(a, scope)
            aggs.append(col.alias(f"{HIDDEN}a{i}"))
            made[a] = (f"{HIDDEN}a{i}", kind)
        for i, n in enumerate(rest):
            # the group's first document stands for it
            v = scope.name(n)
            first = F.min_by(v.col, order.col) if order.kind != "null" else F.first(v.col)
            aggs.append(first.alias(f"{HIDDEN}r{i}"))
        grouping = [v.col.alias(f"{HIDDEN}k{i}") for i, v in enumerate(keys.values())]
        aggs = aggs or [F.count(F.lit(1)).alias(f"{HIDDEN}n")]
        df = scope.df.groupBy(*grouping).agg(*aggs) if s.group else scope.df.agg(*aggs)
        inner = Scope(df, scope.first, scope.aliases)
        for a, (c, kind) in made.items():
            inner.extra[a] = Value(F.col(c), kind)
        for i, (n, v) in enumerate(keys.items()):
            inner.extra[n] = Value(F.col(f"{HIDDEN}k{i}"), v.kind, v.literal)
        for i, n in enumerate(rest):
            v = scope.name(n)
            inner.extra[n] = Value(F.col(f"{HIDDEN}r{i}"), v.kind, v.literal)
        out: dict[str, Value] = {}
        if any(v is None for v, _ in s.items):
            out.update({n: inner.name(n) for n, _ in self.star(scope)})
        for v, alias in s.items:
            if v is not None:
                out.setdefault(alias or signature(v), inner.value(v))
        if s.having is not None:
            visible = Scope(df, scope.first, scope.aliases)
            visible.extra = inner.extra | {n: v for n, v in out.items()}
            inner = self.restrict(visible, s.having)
            df = inner.df
        hidden = {f"{HIDDEN}o_{n}": inner.name(n) for n, _ in s.order if n not in out}
        return self.finish(s, df, out, hidden)

    def aggregate(self, a: Agg, scope: Scope) -> tuple[Column, str]:
        if a.arg is None:
            return F.count(F.lit(1)), "int"
        v = scope.value(a.arg)
        match a.name:
            case "COUNT":
                return F.count(v.col), "int"
            case "SUM":
                if v.kind == "int":
                    return F.try_sum(v.col.cast("long")), "int"
                return (F.sum(values.as_double(v)), "float") if v.number else (F.sum(F.lit(None).cast("double")), "float")
            case "AVG":
                if v.number:
                    return F.avg(values.as_double(v)), "float"
                return F.when(F.count(v.col) > 0, F.lit(0.0)), "float"
            case "MIN":
                return F.min(v.col), v.kind
            case "MAX":
                return F.max(v.col), v.kind
        raise EngineError(f"unknown aggregate {a.name}")

    def finish(self, s: Select, df: DataFrame, out: dict[str, Value], hidden: dict[str, Value]) -> DataFrame:
        """Project, then DISTINCT, ORDER BY, OFFSET and LIMIT; ties go by the id where there is one."""
        if s.distinct and hidden:
            hidden = {}
        tie = column(df, "id") if s.order and "id" not in out and "id" in df.columns and not s.distinct else None
        if tie is not None:
            hidden = hidden | {f"{HIDDEN}tie": tie}
        res = df.select(*[v.col.alias(n) for n, v in (out | hidden).items()])
        if s.distinct:
            res = res.distinct()
        if s.order:
            by = []
            for n, down in s.order:
                c = F.col(f"`{n if n in out else f'{HIDDEN}o_{n}'}`")
                if n in out or f"{HIDDEN}o_{n}" in hidden:
                    by.append(c.desc_nulls_last() if down else c.asc_nulls_first())
            if tie is not None:
                by.append(F.col(f"{HIDDEN}tie"))
            elif "id" in out:
                by.append(F.col("id"))
            res = res.orderBy(*by) if by else res
        if s.offset:
            res = res.offset(s.offset)
        if s.limit is not None:
            res = res.limit(s.limit)
        return res.drop(*hidden) if hidden else res


def names_outside(node) -> list[str]:
    """Names that are used outside aggregates."""
    match node:
        case Name(n):
            return [n]
        case Op(_, a, b) | Compare(_, a, b):
            return names_outside(a) + (names_outside(b) if not isinstance(b, (tuple, Select)) else [])
        case Call(_, parts) | Both(parts) | Either(parts):
            return [x for p in parts for x in names_outside(p)]
        case Not(p):
            return names_outside(p)
    return []
