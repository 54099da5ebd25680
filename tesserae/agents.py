"""Bounded access for programs: sandboxed agents with an audit trail, and a request dispatcher."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .errors import EngineError
from .plans.parser import parse

#: The kind of access that a statement needs.
ACCESS = {
    "select": "read", "describe": "read", "show collections": "read", "show indexes": "read", "insert": "write", "update": "write", "delete": "delete",
    "create collection": "structure", "drop collection": "structure", "create index": "structure", "drop index": "structure", "create view": "structure",
    "rename collection": "structure", "add field": "structure", "drop field": "structure", "rename field": "structure",
    "begin": "write", "commit": "write", "rollback": "write",
}
MOST_BODY = 256 * 1024


class Audit:
    """An append-only folder of JSON records, one file each, that any Spark reader can query."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        os.makedirs(folder, exist_ok=True)

    def record(self, agent: str, action: str, allowed: bool, detail: str = "") -> None:
        said = {"at": datetime.now(timezone.utc).isoformat(), "agent": agent, "action": action, "allowed": allowed, "detail": detail}
        name = os.path.join(self.folder, f"{said['at'].replace(':', '')}-{uuid.uuid4().hex}.json")
        with open(f"{name}.part", "w") as f:
            f.write(json.dumps(said) + "\n")
        os.replace(f"{name}.part", name)

    def read(self, limit: int = 100) -> DataFrame:
        """Newest first."""
        schema = "at string, agent string, action string, allowed boolean, detail string"
        return self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(self.folder).orderBy(F.desc("at")).limit(limit)

    def rejections(self, limit: int = 100) -> DataFrame:
        return self.read(1 << 30).where("not allowed").limit(limit)


class Agent:
    """An engine behind an allow-list of accesses and collections, a stop file and a full audit."""

    def __init__(self, name: str, engine: Engine, audit: Audit, accesses: set[str], collections: set[str], stop_file: str | None = None) -> None:
        self.name, self.engine, self.audit = name, engine, audit
        self.accesses, self.collections, self.stop_file = set(accesses), set(collections), stop_file

    def sql(self, statement: str):
        try:
            self._admit(statement)
        except EngineError as e:
            self.audit.record(self.name, statement, False, str(e))
            raise
        found = self.engine.sql(statement)
        self.audit.record(self.name, statement, True)
        return found

    def _admit(self, statement: str) -> None:
        if self.stop_file and os.path.exists(self.stop_file):
            raise EngineError("the agent is stopped")
        reach = self.engine.reach(statement)
        if reach - self.collections:
            raise EngineError(f"not open to this agent: {', '.join(sorted(reach - self.collections)) or 'the statement'}")
        kind = ACCESS[parse(statement).kind]
        if kind not in self.accesses:
            raise EngineError(f"{kind} is not open to this agent")


def request(engine: Engine, body: dict) -> dict:
    """One action of a JSON request as a JSON-ready answer; errors are answers too."""
    try:
        if len(json.dumps(body)) > MOST_BODY:
            raise EngineError("the request is larger than 256 KB")
        return {"ok": True, "result": _answer(engine, body)}
    except EngineError as e:
        return {"ok": False, "error": str(e)}


def _answer(engine: Engine, body: dict):
    name = body.get("coleccion", "")
    match body.get("accion"):
        case "insert":
            return engine.insert(name, body["datos"], body.get("id"))
        case "get":
            found = engine.get(name, body["id"]).first()
            return found.asDict(True) if found else None
        case "update":
            return engine.update(name, body["id"], body["datos"])
        case "delete":
            return engine.delete(name, body["id"])
        case "find" | "count":
            q = engine.find(name)
            for w in body.get("donde", []):
                q = q.where(*w)
            if body["accion"] == "count":
                return q.count()
            for o in body.get("orden", []):
                q = q.order_by(*o)
            if "limite" in body:
                q = q.limit(body["limite"])
            if "salto" in body:
                q = q.offset(body["salto"])
            if "campos" in body:
                q = q.select(*body["campos"])
            return [r.asDict(True) for r in q.get()]
        case "sql":
            found = engine.sql(body["sql"])
            return [r.asDict(True) for r in found.collect()] if isinstance(found, DataFrame) else found
    raise EngineError(f"unknown action {body.get('accion')}")
