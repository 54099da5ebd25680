"""Agents, requests, profiles, encryption and streams."""

import pytest

from tesserae import agents
from tesserae.engine import Engine
from tesserae.errors import EngineError
from tesserae.profiles import require
from tesserae.sources.sealed import seal, unseal
from tesserae.streaming.ingest import ingest
from tests import fixtures


def test_agent(spark, tmp_path):
    e = fixtures.engine(spark)
    audit = agents.Audit(spark, str(tmp_path / "audit"))
    a = agents.Agent("bot", e, audit, {"read"}, {"tools", "jobs"}, str(tmp_path / "stop"))
    assert a.sql("SELECT COUNT(*) FROM tools") == 6
    for bad in ("SELECT * FROM people", "SELECT * FROM tools WHERE id IN (SELECT id FROM loans)", "DELETE FROM tools", "rubbish"):
        with pytest.raises(EngineError):
            a.sql(bad)
    (tmp_path / "stop").write_text("")
    with pytest.raises(EngineError):
        a.sql("SELECT COUNT(*) FROM tools")
    seen = audit.read().collect()
    assert len(seen) == 6 and not seen[0]["allowed"] and seen[-1]["allowed"] and audit.rejections().count() == 5


def test_requests(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    ask = lambda **b: agents.request(e, b)
    assert ask(accion="insert", coleccion="p", id="a", datos={"v": 3})["result"]["v"] == 3
    assert ask(accion="update", coleccion="p", id="a", datos={"v": 4})["ok"]
    assert ask(accion="find", coleccion="p", donde=[["v", ">", 1]], campos=["id", "v"], limite=5)["result"] == [{"id": "a", "v": 4}]
    assert ask(accion="count", coleccion="p", donde=[["v", 4]])["result"] == 1
    assert ask(accion="sql", sql="SELECT v FROM p")["result"] == [{"v": 4}]
    assert ask(accion="delete", coleccion="p", id="a")["result"] is True and ask(accion="get", coleccion="p", id="a")["result"] is None
    assert not ask(accion="nothing")["ok"] and not ask(accion="sql", sql="x" * 300_000)["ok"]


def test_profiles():
    require("ai", "vectors")
    for bad in (("core", "sql"), ("none", "sql")):
        with pytest.raises(EngineError):
            require(*bad)


def test_sealed(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "id string, v long, t string")
    key = b"0123456789abcdef0123456789abcdef"
    boxes = seal(df, "p", key)
    assert sorted(map(tuple, unseal(boxes, "p", key, "id string, v long, t string").collect())) == [("a", 1, None), ("b", 2, "x")]
    assert unseal(boxes, "other", key, "id string, v long, t string").count() == 0
    assert unseal(boxes, "p", b"f" * 32, "id string, v long, t string").count() == 0


def test_formats_and_encryption(spark, tmp_path):
    key = bytes(range(32))
    e = Engine(spark, str(tmp_path / "db"), key=key)
    e.sql("INSERT INTO p (id, v, t) VALUES ('a', 1, 'secret words'), ('b', 2, NULL)")
    want = {("a", 1, "secret words"), ("b", 2, None)}
    seen = lambda x: {(r["id"], r["v"], r["t"]) for r in x.read("p").collect()}
    e.migrate("p", "json")
    assert seen(e) == want and dict(e.read("p").dtypes)["v"] == "bigint"
    e.encrypt("p")
    e.sql("UPDATE p SET v = v + 1 WHERE id = 'b'")
    want = {("a", 1, "secret words"), ("b", 3, None)}
    assert seen(e) == want and seen(Engine(spark, str(tmp_path / "db"), key=key)) == want
    for f in (tmp_path / "db" / "p").rglob("*.parquet"):
        assert b"secret" not in f.read_bytes() or f.parent.name != e.store.collections["p"]["snapshot"]
    assert Engine(spark, str(tmp_path / "db"), key=bytes(32)).count("p") == 0
    for bad in (lambda: Engine(spark, str(tmp_path / "db")).read("p"), lambda: e.enable_vectors("p", auto=("t",)), lambda: e.migrate("p", "xml")):
        with pytest.raises(EngineError):
            bad()
    assert [tuple(r) for r in e.stats().collect()] == [("p", 2, "parquet", True)]


def test_profile_of_an_engine(spark):
    e = Engine(spark, profile="core")
    e.given = fixtures.engine(spark).given
    assert e.find("tools").where("kind", "measure").count() == 3
    for bad in (lambda: e.sql("SELECT id FROM tools"), lambda: e.find("tools").join("jobs", "id", "id"), lambda: e.similar("tools", "x")):
        with pytest.raises(EngineError):
            bad()


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 5, 1)], "id string, v long, n long").write.parquet(str(source))
    e = Engine(spark, str(tmp_path / "db"))
    stream = lambda: spark.readStream.schema("id string, v long, n long").parquet(str(source))
    ingest(e, stream(), "p", str(tmp_path / "check"), "n").awaitTermination()
    assert {r["id"]: r["v"] for r in e.read("p").collect()} == {"a": 2, "b": 5}
    spark.createDataFrame([("b", 6, 2)], "id string, v long, n long").write.mode("append").parquet(str(source))
    ingest(e, stream(), "p", str(tmp_path / "check"), "n").awaitTermination()
    assert {r["id"]: (r["v"], r["_version"]) for r in e.read("p").collect()} == {"a": (2, 1), "b": (6, 2)}
