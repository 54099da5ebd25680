"""Recursive-descent parser of the query language."""

from __future__ import annotations

from ..errors import EngineError
from ..functions.scalars import canonical
from .lexer import Token, tokens
from .syntax import Agg, Both, Call, Compare, Either, Exists, Join, Lit, Name, Not, Op, Select, Statement, aggregates

AGGREGATES = ("AVG", "COUNT", "MAX", "MIN", "SUM")
COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")
MOST_NESTED = 200


class Parser:
    def __init__(self, statement: str) -> None:
        self.source, self.tokens, self.at, self.depth = statement, tokens(statement), 0, 0

    # the cursor

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, wanted: str) -> EngineError:
        t = self.now
        return EngineError(f"{wanted} expected at {t.at}, found {t.value if t.kind != 'end' else 'the end'}")

    def is_word(self, *words: str) -> bool:
        return self.now.kind == "word" and self.now.value in words

    def is_mark(self, *marks: str) -> bool:
        return self.now.kind == "mark" and self.now.value in marks

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def word(self, *words: str) -> bool:
        """Take these words in a row if they come next."""
        got = [t.value for t in self.tokens[self.at : self.at + len(words)] if t.kind == "word"]
        if got != list(words):
            return False
        self.at += len(words)
        return True

    def mark(self, m: str) -> bool:
        if self.is_mark(m):
            self.at += 1
            return True
        return False

    def need_word(self, *words: str) -> None:
        if not self.word(*words):
            raise self.fail(" ".join(words))

    def need_mark(self, m: str) -> None:
        if not self.mark(m):
            raise self.fail(m)

    def name(self) -> str:
        if self.now.kind != "name" or str(self.now.value).endswith(".*"):
            raise self.fail("a name")
        return self.take().value

    def collection(self) -> str:
        if not (self.word("COLLECTION") or self.word("TABLE")):
            raise self.fail("COLLECTION")
        return self.name()

    def whole(self) -> int:
        if self.now.kind != "number" or not isinstance(self.now.value, int):
            raise self.fail("a whole number")
        return self.take().value

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > MOST_NESTED:
            raise EngineError(f"nested deeper than {MOST_NESTED}")

    # statements

    def statement(self) -> Statement:
        explain = self.word("EXPLAIN")
        first = self.now.value if self.now.kind == "word" else None
        one = {
            "SELECT": lambda: Statement("select", {"select": self.select()}), "INSERT": self.insert, "UPDATE": self.update,
            "DELETE": self.delete, "CREATE": self.create, "DROP": self.drop, "ALTER": self.alter, "SHOW": self.show,
            "DESCRIBE": lambda: (self.take(), Statement("describe", {"collection": self.name()}))[1],
            "BEGIN": self.transaction, "COMMIT": self.transaction, "ROLLBACK": self.transaction,
        }.get(first)
        if one is None:
            raise self.fail("a statement")
        found = one()
        found.explain = explain
        self.mark(";")
        if self.now.kind != "end":
            raise self.fail("the end")
        return found

    def transaction(self) -> Statement:
        kind = self.take().value.lower()
        self.word("TRANSACTION")
        return Statement(kind, {})

    def select(self) -> Select:
        self.deeper()
        begin = self.now.at
        self.need_word("SELECT")
        distinct = self.word("DISTINCT")
        items = [self.item()]
        while self.mark(","):
            items.append(self.item())
        self.need_word("FROM")
        collection = self.name()
        s = Select(collection, self.alias() or collection, items, distinct=distinct)
        while self.is_word("JOIN", "INNER", "LEFT"):
            outer = self.word("LEFT")
            if not outer:
                self.word("INNER")
            self.need_word("JOIN")
            other = self.name()
            alias = self.alias() or other
            self.need_word("ON")
            left = self.name()
            self.need_mark("=")
            s.joins.append(Join(other, alias, left, self.name(), outer))
        if self.word("WHERE"):
            s.where = self.predicate()
            if aggregates(s.where):
                raise EngineError("WHERE can't hold an aggregate; use HAVING")
        if self.word("GROUP", "BY"):
            s.group.append(self.name())
            while self.mark(","):
                s.group.append(self.name())
        if self.word("HAVING"):
            s.having = self.predicate()
            if not s.group and not any(aggregates(v) for v, _ in items if v is not None):
                raise EngineError("HAVING needs GROUP BY or an aggregate")
        if self.word("ORDER", "BY"):
            if self.word("EMBEDDING"):
                self.need_mark("<->")
                if self.now.kind != "text":
                    raise self.fail("a text")
                s.near = self.take().value
                if s.joins or s.group or s.having or s.distinct:
                    raise EngineError("ORDER BY EMBEDDING goes with WHERE and LIMIT only")
                s.limit = self.whole() if self.word("LIMIT") else None
            else:
                s.order.append(self.order())
                while self.mark(","):
                    s.order.append(self.order())
        if s.near is None:
            if self.word("LIMIT"):
                s.limit = self.whole()
            if self.word("OFFSET"):
                s.offset = self.whole()
        self.depth -= 1
        s.text = self.source[begin : self.now.at].strip() if self.now.kind != "end" else self.source[begin:].strip()
        return s

    def alias(self) -> str | None:
        if self.word("AS"):
            return self.name()
        return self.name() if self.now.kind == "name" else None

    def item(self) -> tuple:
        if self.mark("*"):
            return None, None
        value = self.value()
        return value, self.alias()

    def order(self) -> tuple[str, bool]:
        name = self.name()
        if self.word("DESC"):
            return name, True
        self.word("ASC")
        return name, False

    # predicates

    def predicate(self):
        parts = [self.conjunction()]
        while self.word("OR"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Either(tuple(parts))

    def conjunction(self):
        parts = [self.negation()]
        while self.word("AND"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def negation(self):
        if self.word("NOT"):
            self.deeper()
            part = self.negation()
            self.depth -= 1
            return Not(part)
        return self.comparison()

    def comparison(self):
        if self.word("EXISTS"):
            self.need_mark("(")
            s = self.select()
            self.need_mark(")")
            return Exists(s)
        if self.is_mark("("):
            # a bracket opens a predicate or a value: try the predicate, else the value
            start, depth = self.at, self.depth
            try:
                self.take()
                self.deeper()
                inner = self.predicate()
                self.need_mark(")")
                self.depth -= 1
                if not (self.is_mark(*COMPARISONS, "+", "-", "*", "/", "%") or self.is_word("IN", "LIKE", "IS", "CONTAINS", "BETWEEN")):
                    return inner
            except EngineError:
                if depth >= MOST_NESTED - 1:
                    raise
            self.at, self.depth = start, depth
        left = self.value()
        negated = self.word("NOT")
        found = self.after(left)
        if found is None:
            raise self.fail("a comparison")
        return Not(found) if negated else found

    def after(self, left):
        if self.is_mark(*COMPARISONS):
            return Compare(self.take().value, left, self.value())
        if self.word("IN"):
            self.need_mark("(")
            right = self.select() if self.is_word("SELECT") else self.literals()
            self.need_mark(")")
            return Compare("in", left, right)
        if self.word("LIKE"):
            return Compare("like", left, Lit(self.literal()))
        if self.word("CONTAINS"):
            return Compare("contains", left, Lit(self.literal()))
        if self.word("BETWEEN"):
            low = self.literal()
            self.need_word("AND")
            return Compare("between", left, (Lit(low), Lit(self.literal())))
        if self.word("IS"):
            negated = self.word("NOT")
            self.need_word("NULL")
            found = Compare("null", left)
            return Not(found) if negated else found
        return None

    def literals(self) -> tuple:
        out = [Lit(self.literal())]
        while self.mark(","):
            out.append(Lit(self.literal()))
        return tuple(out)

    def literal(self):
        if self.mark("-"):
            if self.now.kind != "number":
                raise self.fail("a number")
            return -self.take().value
        if self.now.kind in ("text", "number"):
            return self.take().value
        for word, v in (("NULL", None), ("TRUE", True), ("FALSE", False)):
            if self.word(word):
                return v
        raise self.fail("a literal")

    # values

    def value(self):
        left = self.term()
        while self.is_mark("+", "-"):
            left = Op(self.take().value, left, self.term())
        return left

    def term(self):
        left = self.factor()
        while self.is_mark("*", "/", "%"):
            left = Op(self.take().value, left, self.factor())
        return left

    def factor(self):
        if self.is_mark("-"):
            self.take()
            if self.now.kind == "number":
                return Lit(-self.take().value)
            self.deeper()
            found = Op("-", Lit(0), self.factor())
            self.depth -= 1
            return found
        if self.mark("("):
            self.deeper()
            found = self.value()
            self.need_mark(")")
            self.depth -= 1
            return found
        if self.now.kind in ("text", "number") or self.is_word("NULL", "TRUE", "FALSE"):
            return Lit(self.literal())
        if self.word("COUNT"):
            self.need_mark("(")
            arg = None if self.mark("*") else self.value()
            self.need_mark(")")
            return Agg("COUNT", arg)
        if self.now.kind == "name":
            name = self.name()
            if not self.mark("("):
                return Name(name)
            args = []
            while not self.is_mark(")"):
                args.append(self.value())
                if not self.mark(","):
                    break
            self.need_mark(")")
            if name.upper() in AGGREGATES:
                if len(args) != 1:
                    raise EngineError(f"{name.upper()} takes one argument")
                return Agg(name.upper(), args[0])
            return Call(canonical(name, len(args)), tuple(args))
        raise self.fail("a value")

    # writes and definitions

    def insert(self) -> Statement:
        self.need_word("INSERT", "INTO")
        collection = self.name()
        self.need_mark("(")
        fields = [self.name()]
        while self.mark(","):
            fields.append(self.name())
        self.need_mark(")")
        self.need_word("VALUES")
        rows = []
        while True:
            self.need_mark("(")
            row = [v.value for v in self.literals()]
            self.need_mark(")")
            if len(row) != len(fields):
                raise EngineError(f"{len(fields)} fields but {len(row)} values")
            rows.append(dict(zip(fields, row, strict=True)))
            if not self.mark(","):
                break
        return Statement("insert", {"collection": collection, "rows": rows, "upsert": self.word("ON", "DUPLICATE", "UPDATE")})

    def update(self) -> Statement:
        self.take()
        collection = self.name()
        self.need_word("SET")
        sets = {}
        while True:
            field = self.name()
            self.need_mark("=")
            sets[field] = self.value()
            if not self.mark(","):
                break
        return Statement("update", {"collection": collection, "sets": sets, **self.affected()})

    def delete(self) -> Statement:
        self.need_word("DELETE", "FROM")
        return Statement("delete", {"collection": self.name(), **self.affected()})

    def affected(self) -> dict:
        where = self.predicate() if self.word("WHERE") else None
        limit = None
        if self.word("LIMIT"):
            sign = -1 if self.mark("-") else 1
            limit = max(0, sign * self.whole())
        return {"where": where, "limit": limit}

    def create(self) -> Statement:
        self.take()
        if self.is_word("COLLECTION", "TABLE"):
            return Statement("create collection", {"collection": self.collection()})
        if self.word("VIEW"):
            name = self.name()
            self.need_word("AS")
            return Statement("create view", {"view": name, "select": self.select()})
        unique = self.word("UNIQUE")
        self.need_word("INDEX")
        self.need_word("ON")
        return Statement("create index", {"unique": unique, **self.indexed()})

    def indexed(self) -> dict:
        collection = self.name()
        self.need_mark("(")
        field = self.name()
        self.need_mark(")")
        return {"collection": collection, "field": field}

    def drop(self) -> Statement:
        self.take()
        if self.word("INDEX"):
            self.need_word("ON")
            return Statement("drop index", self.indexed())
        return Statement("drop collection", {"collection": self.collection()})

    def alter(self) -> Statement:
        self.take()
        body = {"collection": self.collection()}
        if self.word("RENAME", "TO"):
            return Statement("rename collection", body | {"to": self.name()})
        if self.word("ADD", "FIELD"):
            field = self.name()
            return Statement("add field", body | {"field": field, "value": self.literal() if self.mark("=") else None})
        if self.word("DROP", "FIELD"):
            return Statement("drop field", body | {"field": self.name()})
        if self.word("RENAME", "FIELD"):
            field = self.name()
            self.need_word("TO")
            return Statement("rename field", body | {"field": field, "to": self.name()})
        raise self.fail("RENAME, ADD or DROP")

    def show(self) -> Statement:
        self.take()
        if self.word("COLLECTIONS"):
            return Statement("show collections", {})
        self.need_word("INDEXES")
        self.word("ON")
        return Statement("show indexes", {"collection": self.name() if self.now.kind == "name" else None})


def parse(statement: str) -> Statement:
    return Parser(statement).statement()


def parse_select(statement: str) -> Select:
    found = parse(statement)
    if found.kind != "select":
        raise EngineError("a SELECT is needed")
    return found.body["select"]
