"""The engine: collections, statements, fluent queries, similarity and writes."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EngineError
from .functions import values
from .functions.embed import Embedder, HashEmbedder
from .operators import similarity
from .operators.joins import column
from .plans import similar as similar_plan
from .plans.lower import Lowering, Scope
from .plans.parser import parse
from .plans.syntax import Select, Statement, collections
from .profiles import require
from .query import Query
from .sources import exchange
from .sources.scratch import scratch
from .sources.store import Store, checked

PROTECTED = ("id", "_version", "_createdAt", "_updatedAt")
MOST_VIEWS = 8
#: A column of a merge's input that lists the fields each document sets.
SET_FIELDS = "__set"
#: Labels of the types that DESCRIBE reports.
LABELS = {"bool": "bool", "int": "entero", "float": "decimal", "text": "texto", "time": "texto", "list": "lista", "map": "mapa", "null": "vacio"}
#: Kinds that a declared type admits.
ADMITS = {
    "bool": {"bool"}, "entero": {"int"}, "decimal": {"int", "float"}, "numero": {"int", "float"}, "texto": {"text"}, "lista": {"list"}, "mapa": {"map"},
}


class Engine:
    """Collections are read-only DataFrames that were registered, or managed ones in a store folder."""

    def __init__(self, spark: SparkSession, root: str | None = None, embedder: Embedder | None = None, guard: Callable[[str], None] | None = None, profile: str = "ai", key: bytes | None = None) -> None:
        self.spark, self.embedder, self.guard = spark, embedder or HashEmbedder(), guard
        self.given: dict[str, DataFrame] = {}
        self.vectors: dict[str, dict] = {}
        self._root, self._store, self._key, self.profile = root, None, key, profile
        require(profile, "query")
        self.pending: dict[str, DataFrame] | None = None
        self._depth = self._held = 0

    @property
    def store(self) -> Store:
        if self._store is None:
            self._store = Store(self.spark, self._root or scratch(self.spark), self._key)
        return self._store

    # collections

    def register(self, name: str, df: DataFrame) -> Engine:
        self.given[name] = df
        return self

    def register_folder(self, folder: str, *names: str) -> Engine:
        for n in names:
            self.register(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))
        return self

    @contextmanager
    def _steady(self):
        """One state of the catalog for a whole statement: read at its start, or at its transaction's."""
        if self._held == 0 and self.pending is None and self._managed:
            self.store.refresh()
        self._held += 1
        try:
            yield
        finally:
            self._held -= 1

    @property
    def _managed(self) -> bool:
        return self._store is not None or self._root is not None

    def collections(self) -> list[str]:
        with self._steady():
            pass
        return sorted({*self.given, *(self.store.collections if self._managed else ())})

    def read(self, name: str) -> DataFrame:
        """A collection or, where none has the name, a view; expired documents are hidden."""
        if self.pending is not None and name in self.pending:
            return self.pending[name]
        if name in self.given:
            return self.given[name]
        if self._managed:
            with self._steady():
                pass
            if name in self.store.collections:
                return self._alive(name, self.store.read(name))
            if name in self.store.views:
                return self._view(name)
        raise EngineError(f"there is no collection {name}")

    def _alive(self, name: str, df: DataFrame) -> DataFrame:
        ttl = self.store.settings(name)["ttl"]
        if not ttl:
            return df
        written = F.unix_timestamp(F.try_to_timestamp("_updatedAt"))
        return df.where(F.coalesce(written + F.lit(int(ttl)) > F.unix_timestamp(F.current_timestamp()), F.lit(True)))

    def _view(self, name: str) -> DataFrame:
        self._depth += 1
        try:
            if self._depth > MOST_VIEWS:
                raise EngineError(f"views are nested deeper than {MOST_VIEWS}")
            return self.lowering().select(parse(self.store.views[name]).body["select"])
        finally:
            self._depth -= 1

    def lowering(self) -> Lowering:
        return Lowering(self.read, self.near, self.guard)

    # queries

    def find(self, name: str) -> Query:
        return Query(self, name)

    def get(self, name: str, id_: str) -> DataFrame:
        return self.read(name).where(F.col("id") == id_).limit(1)

    def exists(self, name: str, id_: str) -> bool:
        return bool(self.get(name, id_).head(1))

    def ids(self, name: str) -> DataFrame:
        return self.read(name).select("id").orderBy("id")

    def count(self, name: str) -> int:
        return self.read(name).count()

    def by(self, name: str, field: str, value) -> DataFrame:
        return self.find(name).where(field, value).df()

    def sql(self, statement: str):
        """A DataFrame for queries (an int for a bare COUNT(*)), a dict for anything else."""
        require(self.profile, "sql")
        s = parse(statement)
        if s.explain:
            return self.explain(s)
        match s.kind:
            case "select":
                q = s.body["select"]
                df = self.lowering().select(q)
                return df.first()[0] if q.bare_count else df
            case "describe":
                return self.describe(s.body["collection"])
            case "show collections":
                return self.spark.createDataFrame([(n,) for n in self.collections()], "coleccion string")
            case "show indexes":
                return self.indexes(s.body["collection"])
        return self.execute(s)

    def query(self, statement: str) -> DataFrame:
        """A SELECT as a lazy DataFrame, bare counts included."""
        s = parse(statement)
        if s.kind != "select":
            raise EngineError("a SELECT is needed")
        return self.lowering().select(s.body["select"])

    def reach(self, statement: str) -> set[str]:
        """The collections that a statement touches; what can't be read touches a name that can't be."""
        try:
            s = parse(statement)
        except EngineError:
            return {"\0"}
        found = {v for k, v in s.body.items() if k in ("collection", "to") and v}
        if "select" in s.body:
            found |= collections(s.body["select"])
        if s.body.get("where") is not None:
            found |= collections(Select("", "", [], where=s.body["where"])) - {""}
        return found

    def explain(self, s: Statement) -> dict:
        """What a statement would do; nothing is run or written."""
        said = {"explain": True, "operacion": s.kind}
        if s.kind == "select":
            q: Select = s.body["select"]
            said |= {"coleccion": q.collection, "orden": q.order, "limite": q.limit, "salto": q.offset}
            if q.near is not None:
                said |= {"operacion": "busqueda vectorial", "consulta": q.near, "k": q.limit or 10}
            plan = self.lowering().select(q)
            said["plan"] = plan._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        else:
            said |= {"coleccion": s.body.get("collection") or s.body.get("view")}
        return said

    def describe(self, name: str) -> DataFrame:
        """campo, tipo, declarado, documentos and de for each field."""
        df = self.read(name)
        declared = self.store.settings(name)["schema"] if self._managed and name in self.store.collections else {}
        counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
        rows = []
        for f in df.schema.fields:
            kind = LABELS[values.kind_of(f.dataType)] if counts[f.name] else "vacio"
            rows.append((f.name, kind, (declared.get(f.name) or {}).get("tipo"), counts[f.name], counts["__n"]))
        rows += [(n, r.get("tipo", "cualquiera"), r.get("tipo"), 0, counts["__n"]) for n, r in declared.items() if n not in df.columns]
        return self.spark.createDataFrame(sorted(rows), "campo string, tipo string, declarado string, documentos long, de long")

    def indexes(self, name: str | None = None) -> DataFrame:
        rows = []
        for n, entry in sorted(self.store.collections.items()) if self._managed else ():
            if name in (None, n):
                rows += [(n, f, f in entry["uniques"]) for f in sorted(entry["indexes"])]
        return self.spark.createDataFrame(rows, "coleccion string, campo string, unico boolean")

    # similarity

    def enable_vectors(self, name: str, field: str | None = None, auto: tuple[str, ...] = (), dims: int | None = None, precision: str = "rapida", key: str = "id") -> Engine:
        """Where a collection's vectors come from: a field that holds them, or text fields that are embedded."""
        require(self.profile, "vectors")
        similarity.candidates(precision, 1)
        if self._managed and self.store.collections.get(name, {}).get("sealed"):
            raise EngineError(f"{name} is encrypted; vectors would show its texts")
        self.vectors[name] = {"field": field, "auto": tuple(auto), "dims": dims or self.embedder.dims, "precision": precision, "key": key}
        return self

    def vector_rows(self, name: str, df: DataFrame | None = None) -> tuple[DataFrame, dict]:
        require(self.profile, "vectors")
        if name not in self.vectors:
            raise EngineError(f"{name} has no vectors; enable them first")
        how = self.vectors[name]
        df = self.read(name) if df is None else df
        field = how["field"]
        if field and isinstance(df.schema[field].dataType, T.ArrayType):
            return df.withColumn("__vec", F.col(f"`{field}`")), how
        fields = [field] if field else how["auto"]
        texts = []
        for f in fields:
            v = column(df, f)
            if v is not None and v.kind in ("text", "int", "float"):
                texts.append(values.as_text(v))
            elif v is not None and v.kind == "list":
                texts.append(F.concat_ws(" ", v.col.cast("array<string>")))
        text = F.concat_ws(" ", *texts) if texts else F.lit("")
        return similarity.embedded(df, F.when(F.trim(text) != "", text), self.embedder, "__vec"), how

    def similar(self, name: str, query, k: int = 10, where: Query | None = None, precision: str | None = None, places: int = similarity.PLACES) -> DataFrame:
        """The k nearest documents with their score, among those that the filter admits; scores equal to that many places go by the key."""
        df, how = self.vector_rows(name, where.df() if where is not None else None)
        vector = self.embedder.vector(query) if isinstance(query, str) else query
        found = similarity.nearest(df, "__vec", how["key"], vector, k, precision or how["precision"], places)
        return found.drop("__vec")

    def hybrid(self, name: str, text: str, k: int = 10) -> DataFrame:
        """Documents by fused ranks of similarity and of holding the text; puntos and en say how."""
        how = self.vectors.get(name) or {}
        key = how.get("key", "id")
        near = similarity.ranked(self.similar(name, text, 2 * k), F.desc("score"), F.col(key), most=2 * k)
        df = self.read(name)
        holds = F.lit(False)
        for f in how["auto"]:
            v = column(df, f)
            if v is not None and v.kind == "text":
                holds = holds | values.contains(v, values.lit(text))
        return similar_plan.hybrid(df, near, holds, key, k)

    def near(self, s: Select) -> DataFrame:
        return similar_plan.select(self, s)

    # writes

    def execute(self, s: Statement) -> dict:
        match s.kind:
            case "begin":
                return self.begin()
            case "commit":
                return self.commit()
            case "rollback":
                return self.rollback()
        with self._steady():
            return self._execute(s)

    def _execute(self, s: Statement) -> dict:
        b = s.body
        match s.kind:
            case "create collection":
                self.store.set(b["collection"])
                return {"created": b["collection"]}
            case "drop collection":
                self.store.drop(b["collection"])
                return {"dropped": b["collection"]}
            case "rename collection":
                return self._rename(b["collection"], checked(b["to"]))
            case "create view":
                if b["view"] in self.collections():
                    raise EngineError(f"{b['view']} is a collection")
                self.lowering().select(b["select"])
                self.store.set_view(b["view"], b["select"].text)
                return {"view": b["view"]}
            case "create index":
                return self.index(b["collection"], b["field"], b["unique"])
            case "drop index":
                entry = self.store.settings(b["collection"])
                self.store.set(b["collection"], **{k: [f for f in entry[k] if f != b["field"]] for k in ("indexes", "uniques")})
                return {"dropped": b["field"]}
            case "insert":
                return self.insert_rows(b["collection"], b["rows"], merge=b["upsert"])
            case "update":
                return self.update_where(b["collection"], b["sets"], b["where"], b["limit"])
            case "delete":
                return self.delete_where(b["collection"], b["where"], b["limit"])
            case "add field" | "drop field" | "rename field":
                return self._alter(s.kind, b)
        raise EngineError(f"{s.kind} can't be run")

    def index(self, name: str, field: str, unique: bool = False) -> dict:
        entry = self.store.settings(name)
        df = self.read(name)
        v = column(df, field)
        n = 0
        if v is not None and v.kind not in ("list", "map", "null"):
            n = df.select(values.as_text(v).alias("v")).where("v is not null and v <> ''").distinct().count()
        if unique:
            self._unique(df, [field])
        self.store.set(name, indexes=sorted({*entry["indexes"], field}), uniques=sorted({*entry["uniques"], *([field] if unique else [])}))
        return {"index": field, "values": n}

    @staticmethod
    def _unique(df: DataFrame, fields: list[str]) -> None:
        for f in fields:
            v = column(df, f)
            if v is None:
                continue
            if v.kind in ("list", "map"):
                raise EngineError(f"{f}: a list can't be unique")
            twice = df.select(values.as_text(v).alias("v")).where("v is not null and v <> ''").groupBy("v").count().where("count > 1")
            if twice.head(1):
                raise EngineError(f"{f} must be unique; it repeats {twice.first()['v']!r}")

    def _write(self, changed: dict[str, DataFrame], stamp: str | None = None) -> None:
        """Stage whole new states, check them, and commit them or hold them for the open transaction.

        stamp: when the documents that this write touches were updated; they must keep the declared schema.
        """
        require(self.profile, "crud")
        for name in changed:
            if name in self.given:
                raise EngineError(f"{name} is read-only")
        seen = {n: self.store.collections.get(n, {}).get("snapshot") for n in changed}
        staged = {n: self.store.stage(n, df) for n, df in changed.items()}
        try:
            for name, snapshot in staged.items():
                entry, df = self.store.collections.get(name, {}), self.store.staged(name, snapshot)
                self._unique(df, entry.get("uniques", []))
                if stamp is not None:
                    self._keeps_schema(df.where(F.col("_updatedAt") == stamp), entry.get("schema", {}))
            if self.pending is None:
                self.store.commit(staged, seen)
        except BaseException:
            for name, snapshot in staged.items():
                self.store.discard(name, snapshot)
            raise
        if self.pending is not None:
            self.pending |= {n: self.store.staged(n, p) for n, p in staged.items()}
            self._paths |= staged

    @staticmethod
    def _keeps_schema(df: DataFrame, rules: dict) -> None:
        """Raise where a document breaks a rule: one pass for all rules."""
        broken = {}
        for i, (field, rule) in enumerate(rules.items()):
            v = column(df, field)
            absent = F.lit(True) if v is None or v.kind == "null" else v.col.isNull()
            if rule.get("obligatorio"):
                broken[f"n{i}"] = (F.count_if(absent | (v.col == "") if v is not None and v.kind == "text" else absent), f"{field} is needed")
            if rule.get("tipo") and v is not None and v.kind not in ADMITS[rule["tipo"]]:
                broken[f"t{i}"] = (F.count_if(~absent), f"{field} must be {rule['tipo']}")
        if broken:
            seen = df.agg(*[c.alias(k) for k, (c, _) in broken.items()]).first()
            for k, (_, said) in broken.items():
                if seen[k]:
                    raise EngineError(said)

    def begin(self) -> dict:
        if self.pending is not None:
            raise EngineError("a transaction is open already")
        with self._steady():
            self.pending, self._paths = {}, {}
            self._seen = {n: e["snapshot"] for n, e in self.store.collections.items()}
        return {"transaction": "open"}

    def commit(self) -> dict:
        """All writes at once, if no collection that was written has changed on disk since the transaction began."""
        if self.pending is None:
            raise EngineError("no transaction is open")
        paths, self.pending = self._paths, None
        self.store.commit(paths, self._seen)
        return {"committed": len(paths)}

    def rollback(self) -> dict:
        if self.pending is None:
            raise EngineError("no transaction is open")
        self.pending = None
        return {"transaction": "rolled back"}

    def transaction(self, work: Callable[[Engine], object]):
        self.begin()
        try:
            found = work(self)
        except BaseException:
            self.rollback()
            raise
        self.commit()
        return found

    def define_schema(self, name: str, rules: dict) -> None:
        for field, rule in rules.items():
            if rule.get("tipo") not in (None, *ADMITS):
                raise EngineError(f"{field}: unknown type {rule['tipo']}")
        self.store.set(name, schema=rules)

    def define_ttl(self, name: str, seconds: int | None) -> None:
        self.store.set(name, ttl=seconds)

    def _ruled(self, name: str, rows: list[dict], merged: bool = False) -> list[dict]:
        rules = self.store.collections.get(name, {}).get("schema", {})
        out = []
        for row in rows:
            row = dict(row)
            for field, rule in rules.items():
                if field not in row and "defecto" in rule and not merged:
                    row[field] = rule["defecto"]
                v = row.get(field)
                if rule.get("obligatorio") and v in (None, "") and not merged:
                    raise EngineError(f"{field} is needed")
                kind = {bool: "bool", int: "int", float: "float", str: "text", list: "list", dict: "map"}.get(type(v))
                if v is not None and rule.get("tipo") and kind not in ADMITS[rule["tipo"]]:
                    raise EngineError(f"{field} must be {rule['tipo']}")
            out.append(row)
        return out

    def insert(self, name: str, doc: dict, id_: str | None = None) -> dict:
        return self.insert_rows(name, [doc | ({"id": id_} if id_ else {})])

    def insert_rows(self, name: str, rows: list[dict], merge: bool = False) -> dict:
        """Literal rows; equal ids are replaced, or merged field by field where ``merge`` says so.

        Of rows with one id the last one counts; merged rows add up in their order.
        """
        with self._steady():
            return self._insert_rows(name, rows, merge)

    def _insert_rows(self, name: str, rows: list[dict], merge: bool) -> dict:
        now = datetime.now(timezone.utc)
        made = []
        for i, row in enumerate(self._ruled(name, rows, merge)):
            row = {k: v for k, v in row.items() if k not in PROTECTED[1:]}
            row["id"] = str(row.get("id") or f"{now:%Y%m%d%H%M%S}{now.microsecond // 100:04d}{i:06d}{uuid.uuid4().hex[:6]}")
            made.append(row)
        last: dict[str, dict] = {}
        for row in made:
            last[row["id"]] = last[row["id"]] | row if merge and row["id"] in last else row
        n, made = len(made), list(last.values())
        fields = list(dict.fromkeys(k for r in made for k in r))
        # numbers of both kinds in one field are decimals
        for f in fields:
            kinds = {type(r[f]) for r in made if r.get(f) is not None}
            if kinds == {int, float}:
                for r in made:
                    if r.get(f) is not None:
                        r[f] = float(r[f])
        schema = self._schema_of(fields, made).add(SET_FIELDS, T.ArrayType(T.StringType()))
        new = self.spark.createDataFrame([(*(r.get(f) for f in fields), list(r)) for r in made], schema)
        self._merge(name, new, merge)
        return {"inserted": n} if n > 1 else self._public(self.get(name, made[0]["id"]).first().asDict())

    @staticmethod
    def _public(doc: dict) -> dict:
        return {k: v for k, v in doc.items() if v is not None}

    @staticmethod
    def _schema_of(fields: list[str], rows: list[dict]) -> T.StructType:
        kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
        out = []
        for f in fields:
            v = next((r[f] for r in rows if r.get(f) is not None), "")
            if all(r.get(f) is None for r in rows):
                out.append(T.StructField(f, T.NullType()))
                continue
            t = T.ArrayType(kinds.get(type(v[0]) if v else str, T.StringType())) if isinstance(v, list) else kinds.get(type(v), T.StringType())
            out.append(T.StructField(f, t))
        return T.StructType(out)

    def merge(self, name: str, new: DataFrame, keep_old_fields: bool = True) -> None:
        """Documents of ``new`` into a collection by id: one full outer join, whatever their number.

        Fields that a document of ``new`` does not set are kept or go; those
        set are the ones SET_FIELDS lists, where there is such a column, else
        the ones that are not null. Of rows with one id the last one counts.
        """
        with self._steady():
            at = Window.partitionBy("id").orderBy(F.desc("__at"))
            new = new.withColumn("__at", F.monotonically_increasing_id()).withColumn("__r", F.row_number().over(at)).where("__r = 1").drop("__at", "__r")
            self._merge(name, new, keep_old_fields)

    def _merge(self, name: str, new: DataFrame, keep_old_fields: bool) -> None:
        if name not in self.collections() and (self.pending is None or name not in self.pending):
            self.store.create(name)
        old = self.read(name) if name in self.store.collections or (self.pending and name in self.pending) else None
        now = datetime.now(timezone.utc).isoformat()
        fields = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in (*PROTECTED, SET_FIELDS)]
        a, b = old.alias("a"), new.alias("b")
        both = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
        there, comes = F.col("a.id").isNotNull(), F.col("b.id").isNotNull()
        out = [F.coalesce("b.id", "a.id").alias("id")]
        for c in fields:
            x = F.col(f"a.`{c}`") if c in old.columns else F.lit(None)
            y = F.col(f"b.`{c}`") if c in new.columns else F.lit(None)
            if c in old.columns and c in new.columns:
                x, y = self._common(old, new, c, x, y)
                given = F.array_contains(f"b.{SET_FIELDS}", c) if SET_FIELDS in new.columns else y.isNotNull()
                replaced = y if not keep_old_fields else F.when(given, y).otherwise(x)
            else:
                replaced = x if (keep_old_fields and c in old.columns) else y
                if c in new.columns and isinstance(new.schema[c].dataType, T.NullType):
                    x, replaced = x.cast("string"), y.cast("string")
            out.append(F.when(comes, replaced).otherwise(x).alias(c))
        version = F.col("a._version")
        out += [
            F.when(comes, F.coalesce(version, F.lit(0)) + 1).otherwise(version).cast("long").alias("_version"),
            F.when(there, F.col("a._createdAt")).otherwise(F.lit(now)).alias("_createdAt"),
            F.when(comes, F.lit(now)).otherwise(F.col("a._updatedAt")).alias("_updatedAt"),
        ]
        self._write({name: both.select(out)}, now)

    @staticmethod
    def _common(old: DataFrame, new: DataFrame, c: str, x, y):
        s, t = old.schema[c].dataType, new.schema[c].dataType
        if s == t:
            return x, y
        if isinstance(t, T.NullType):
            return x, y.cast(s)
        if values.kind_of(s) == values.kind_of(t) == "int":
            return x.cast("long"), y.cast("long")
        if {values.kind_of(s), values.kind_of(t)} == {"int", "float"}:
            return x.cast("double"), y.cast("double")
        if isinstance(t, T.StringType) or isinstance(s, T.StringType):
            return x.cast("string"), y.cast("string")
        raise EngineError(f"{c}: {t.simpleString()} does not go with {s.simpleString()}")

    def put(self, name: str, id_: str, doc: dict, replace: bool = False) -> dict:
        return self.insert_rows(name, [doc | {"id": id_}], merge=not replace)

    def update(self, name: str, id_: str, doc: dict) -> dict:
        with self._steady():
            if not self.exists(name, id_):
                raise EngineError(f"there is no document {id_}")
            return self.put(name, id_, doc)

    def delete(self, name: str, id_: str) -> bool:
        with self._steady():
            there = self.exists(name, id_)
            if there:
                self._write({name: self.read(name).where(F.col("id") != id_)})
            return there

    def _affected(self, name: str, where, limit: int | None) -> DataFrame:
        scope = Scope(self.read(name))
        if where is not None:
            scope = self.lowering().restrict(scope, where)
        ids = scope.df.select("id")
        return ids.orderBy("id").limit(limit) if limit is not None else ids

    def update_where(self, name: str, sets: dict, where, limit: int | None = None) -> dict:
        """Fields get their expressions' values on the old document."""
        if set(sets) & set(PROTECTED):
            raise EngineError("id and metadata can't be set")
        df = self.read(name)
        ids = self._affected(name, where, limit)
        n = ids.count()
        scope = Scope(df)
        new = df.select("id", *[(F.lit(None) if (x := scope.value(v)).kind == "null" else x.col).alias(f) for f, v in sets.items()])
        mark = df.join(ids.withColumn("__hit", F.lit(True)), "id", "left")
        now = datetime.now(timezone.utc).isoformat()
        hit = F.coalesce("__hit", F.lit(False))
        inner, out = Scope(mark), []
        for c in dict.fromkeys([*df.columns, *sets]):
            x = F.col(f"`{c}`") if c in df.columns else F.lit(None)
            if c in sets:
                y = inner.value(sets[c]).col
                if c in df.columns:
                    x, y = self._common(df, new, c, x, y)
                else:
                    x = x.cast(new.schema[c].dataType if not isinstance(new.schema[c].dataType, T.NullType) else "string")
                out.append(F.when(hit, y).otherwise(x).alias(c))
            elif c == "_version":
                out.append(F.when(hit, x + 1).otherwise(x).alias(c))
            elif c == "_updatedAt":
                out.append(F.when(hit, F.lit(now)).otherwise(x).alias(c))
            else:
                out.append(x.alias(c))
        self._write({name: mark.select(out)}, now)
        return {"updated": n}

    def delete_where(self, name: str, where, limit: int | None = None) -> dict:
        ids = self._affected(name, where, limit)
        n = ids.count()
        self._write({name: self.read(name).join(ids, "id", "left_anti")})
        return {"deleted": n}

    def _alter(self, kind: str, b: dict) -> dict:
        name, field = b["collection"], b["field"]
        if field in PROTECTED or b.get("to") in PROTECTED:
            raise EngineError(f"{field} is protected")
        df = self.read(name)
        n = df.count()
        match kind:
            case "add field":
                if field in df.columns:
                    return {"changed": 0}
                v = values.lit(b["value"]).col
                self._write({name: df.withColumn(field, v)})
            case "drop field":
                if field not in df.columns:
                    return {"changed": 0}
                self._write({name: df.drop(field)})
            case "rename field":
                if field not in df.columns:
                    return {"changed": 0}
                self._write({name: df.withColumnRenamed(field, b["to"])})
        return {"changed": n}

    def _rename(self, name: str, to: str) -> dict:
        if to in self.given:
            raise EngineError(f"{to} exists already")
        self.store.rename(name, to)
        return {"renamed": to}

    # exchange, upkeep

    def export(self, name: str, path: str) -> None:
        require(self.profile, "exchange")
        exchange.write(self.read(name), path)

    def import_(self, name: str, path: str) -> int:
        """Documents of a file into a collection, under its declared schema; the last one of an id counts."""
        require(self.profile, "exchange")
        with self._steady():
            return self._import(name, path)

    def _import(self, name: str, path: str) -> int:
        new = exchange.read(self.spark, path)
        if "id" not in new.columns:
            new = new.withColumn("id", F.expr("uuid()"))
        new = new.withColumn("id", F.col("id").cast("string"))
        rules = self.store.collections.get(name, {}).get("schema", {})
        for field, rule in rules.items():
            if "defecto" in rule:
                given = F.lit(rule["defecto"])
                new = new.withColumn(field, F.coalesce(F.col(f"`{field}`"), given) if field in new.columns else given)
        self.merge(name, new, False)
        return new.count()

    def backup(self, path: str, base: str | None = None) -> dict:
        require(self.profile, "backup")
        return self.store.backup(path, base)

    def restore(self, path: str) -> dict:
        require(self.profile, "backup")
        return self.store.restore(path)

    def compact(self, name: str, files: int = 1) -> None:
        with self._steady():
            self._write({name: self.read(name).repartition(files)})

    def migrate(self, name: str, kind: str) -> None:
        """Store a collection as parquet or json from now on."""
        if kind not in ("parquet", "json"):
            raise EngineError(f"{kind} is no format of the store")
        self.store.change(name, format=kind)

    def encrypt(self, name: str) -> None:
        """Seal a collection's documents under the engine's key from now on."""
        if name in self.vectors:
            raise EngineError(f"{name} has vectors, which would show its texts")
        self.store.change(name, sealed=True, format="parquet")

    def stats(self) -> DataFrame:
        """Documents, format and encryption of each managed collection."""
        rows = [(n, self.count(n), e.get("format", "parquet"), bool(e.get("sealed"))) for n, e in sorted(self.store.collections.items())]
        return self.spark.createDataFrame(rows, "coleccion string, documentos long, formato string, cifrada boolean")

    def sweep(self, name: str) -> int:
        """Drop expired documents for good; gives their number."""
        with self._steady():
            before = self.store.read(name).count()
            self._write({name: self.read(name)})
            return before - self.read(name).count()

    def checkup(self) -> DataFrame:
        """Documents, version and repeats of unique fields of each managed collection."""
        rows = []
        for n, e in sorted(self.store.collections.items()):
            df = self.read(n)
            try:
                self._unique(df, e["uniques"])
                well = True
            except EngineError:
                well = False
            rows.append((n, df.count(), e["version"], well))
        return self.spark.createDataFrame(rows, "coleccion string, documentos long, version long, bien boolean")
