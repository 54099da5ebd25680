"""Managed collections: writes, constraints, transactions, exchange and backups."""

import pytest

from tesserae.engine import Engine
from tesserae.errors import EngineError


@pytest.fixture
def e(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


def ids(e, name="p"):
    return [r["id"] for r in e.ids(name).collect()]


def test_crud(e):
    e.sql("INSERT INTO p (id, n, precio) VALUES ('a', 'x', 1), ('b', 'y', 2)")
    assert e.get("p", "a").first()["_version"] == 1
    assert e.put("p", "a", {"precio": 9})["n"] == "x" and e.get("p", "a").first()["_version"] == 2
    assert "n" not in e.put("p", "a", {"precio": 3}, replace=True)
    assert e.update("p", "b", {"stock": 2})["precio"] == 2
    with pytest.raises(EngineError):
        e.update("p", "zz", {"n": "q"})
    assert e.delete("p", "a") and not e.delete("p", "a") and ids(e) == ["b"]
    assert e.sql("UPDATE p SET precio = precio * 2 + 1") == {"updated": 1} and e.get("p", "b").first()["precio"] == 5
    assert len(e.sql("INSERT INTO p (n) VALUES ('auto')")["id"]) > 20


def test_limits_take_the_first_ids(e):
    e.sql("INSERT INTO p (id, v) VALUES ('c', 1), ('a', 1), ('b', 1)")
    assert e.sql("UPDATE p SET v = 2 LIMIT 2") == {"updated": 2}
    assert {r["id"]: r["v"] for r in e.read("p").collect()} == {"a": 2, "b": 2, "c": 1}
    assert e.sql("DELETE FROM p LIMIT -4") == {"deleted": 0} and e.sql("DELETE FROM p LIMIT 1") == {"deleted": 1} and ids(e) == ["b", "c"]


def test_nulls_keep_types(e):
    e.sql("INSERT INTO p (id, v, w) VALUES ('a', 1, 'x'), ('b', 2, 'y')")
    e.sql("INSERT INTO p (id, v, z) VALUES ('c', NULL, NULL)")
    e.sql("UPDATE p SET v = NULL, extra = 7 WHERE id = 'a'")
    e.sql("INSERT INTO p (id, v) VALUES ('b', NULL) ON DUPLICATE UPDATE")
    assert dict(e.read("p").dtypes)["v"] == "bigint"
    assert {r["id"]: (r["v"], r["w"], r["extra"]) for r in e.read("p").collect()} == {"a": (None, "x", 7), "b": (None, "y", None), "c": (None, None, None)}


def test_constraints(e):
    e.sql("INSERT INTO p (id, mail) VALUES ('a', 'x'), ('b', ''), ('c', '')")
    e.sql("CREATE UNIQUE INDEX ON p (mail)")
    with pytest.raises(EngineError):
        e.sql("INSERT INTO p (id, mail) VALUES ('d', 'x')")
    assert ids(e) == ["a", "b", "c"]
    e.define_schema("q", {"edad": {"tipo": "entero"}, "correo": {"tipo": "texto", "obligatorio": True}, "activo": {"tipo": "bool", "defecto": True}})
    assert e.insert("q", {"correo": "c", "edad": 3}, "1")["activo"] is True
    for bad in ({"correo": ""}, {"edad": 3}, {"correo": "c", "edad": "3"}, {"correo": "c", "edad": 1.5}):
        with pytest.raises(EngineError):
            e.insert("q", bad)
    e.define_ttl("q", -5)
    assert e.count("q") == 0 and e.sweep("q") == 1


def test_transactions(e):
    e.sql("INSERT INTO p (id, v) VALUES ('a', 1), ('b', 2)")
    e.sql("BEGIN")
    e.sql("DELETE FROM p WHERE id = 'a'")
    e.sql("INSERT INTO p (id, v) VALUES ('z', 9)")
    assert ids(e) == ["b", "z"]
    other = Engine(e.spark, e._root)
    assert ids(other) == ["a", "b"]
    e.sql("ROLLBACK")
    assert ids(e) == ["a", "b"]
    with pytest.raises(ZeroDivisionError):
        e.transaction(lambda x: (x.sql("DELETE FROM p"), 1 / 0))
    e.transaction(lambda x: x.sql("DELETE FROM p WHERE id = 'b'"))
    assert ids(e) == ["a"]
    with pytest.raises(EngineError):
        e.sql("COMMIT")


def test_alter_and_views(e):
    e.sql("INSERT INTO p (id, v) VALUES ('a', 1)")
    assert e.sql("ALTER COLLECTION p ADD FIELD w = 'n'") == {"changed": 1} and e.sql("ALTER COLLECTION p ADD FIELD w = 'm'") == {"changed": 0}
    e.sql("ALTER COLLECTION p RENAME FIELD v TO x")
    e.sql("CREATE VIEW big AS SELECT id, x FROM p WHERE x > 0")
    assert [tuple(r) for r in e.sql("SELECT * FROM big").collect()] == [("a", 1)] and e.sql("SELECT COUNT(*) FROM big") == 1
    with pytest.raises(EngineError):
        e.sql("CREATE VIEW p AS SELECT * FROM big")
    for bad in ("id", "_version"):
        with pytest.raises(EngineError):
            e.sql(f"ALTER COLLECTION p DROP FIELD {bad}")
    e.store.views["loop"] = "SELECT * FROM loop"
    with pytest.raises(EngineError):
        e.sql("SELECT * FROM loop")
    e.sql("ALTER COLLECTION p RENAME TO r")
    e.sql("DROP COLLECTION r")
    assert e.collections() == []
    for bad in ("../x", "a..b", "-a", "x" * 200, "a/b"):
        with pytest.raises(EngineError):
            e.store.create(bad)


def test_exchange(e, tmp_path):
    e.sql("INSERT INTO p (id, n, f, b, t) VALUES ('a', 1, 1.5, TRUE, 'x, \"y\"'), ('b', NULL, 2.0, FALSE, 'ñ')")
    for kind in ("json", "csv"):
        e.export("p", str(tmp_path / f"o.{kind}"))
        assert e.import_(kind, str(tmp_path / f"o.{kind}")) == 2
        got = {r["id"]: (r["n"], r["f"], r["b"], r["t"]) for r in e.read(kind).collect()}
        assert got == {"a": (1, 1.5, True, 'x, "y"'), "b": (None, 2.0, False, "ñ")}
    (tmp_path / "list.json").write_text('[{"id": "q", "v": 1}, {"id": "r", "v": 2}]')
    assert e.import_("list", str(tmp_path / "list.json")) == 2
    with pytest.raises(EngineError):
        e.export("p", "x.xml")


def test_document_sources(spark, tmp_path):
    from tesserae.sources.exchange import document_folder, document_log

    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.json").write_text('{"id": "a",\n "v": 1}')
    (folder / "b.json").write_text('{"id": "other", "v": 2}')
    (folder / "_meta.json").write_text('{"id": "_meta"}')
    assert [r["id"] for r in document_folder(spark, str(folder)).collect()] == ["a"]
    log = tmp_path / "log.json"
    log.write_text('{"n":1,"op":"put","id":"a","doc":{"id":"a","v":1}}\n{"n":2,"op":"put","id":"a","doc":{"id":"a","v":2}}\n{"n":3,"op":"put","id":"b","doc":{"id":"b","v":1}}\n{"n":4,"op":"del","id":"b"}\n')
    assert [tuple(r) for r in document_log(spark, str(log)).collect()] == [("a", 2)]


def test_backups(e, tmp_path):
    e.sql("INSERT INTO p (id, v) VALUES ('a', 1)")
    first = e.store.backup(str(tmp_path / "full"))
    e.sql("INSERT INTO q (id, v) VALUES ('z', 1)")
    second = e.store.backup(str(tmp_path / "more"), str(tmp_path / "full"))
    assert second["copied"] == second["files"] - first["files"] or second["copied"] < second["files"]
    e.sql("DELETE FROM p")
    e.store.restore(str(tmp_path / "more"))
    assert ids(e) == ["a"] and ids(e, "q") == ["z"]
    e.store.restore(str(tmp_path / "full"))
    assert e.collections() == ["p"]
    assert [tuple(r) for r in e.checkup().collect()] == [("p", 1, 1, True)]


def test_equal_ids_in_one_insert(e):
    assert e.sql("INSERT INTO p (id, a, b) VALUES ('x', 1, 5), ('y', 3, 6), ('x', 2, NULL)") == {"inserted": 3}
    assert {r["id"]: (r["a"], r["b"]) for r in e.read("p").collect()} == {"x": (2, None), "y": (3, 6)}
    e.merge("p", e.spark.createDataFrame([("x", 7), ("z", 1), ("x", 8)], "id string, a long").coalesce(1))
    assert {r["id"]: r["a"] for r in e.read("p").collect()} == {"x": 8, "y": 3, "z": 1}


def test_schema_holds_for_every_write(e, tmp_path):
    e.define_schema("s", {"n": {"tipo": "entero", "obligatorio": True}, "t": {"tipo": "texto", "defecto": "none"}})
    e.sql("INSERT INTO s (id, n, t) VALUES ('a', 1, 'x')")
    (tmp_path / "bad.json").write_text('[{"id": "b", "t": "y"}]')
    (tmp_path / "good.json").write_text('[{"id": "b", "n": 2}, {"id": "b", "n": 3}]')
    for bad in (lambda: e.sql("UPDATE s SET n = 'text'"), lambda: e.sql("UPDATE s SET n = NULL"), lambda: e.import_("s", str(tmp_path / "bad.json")), lambda: e.put("s", "a", {"n": 1.5})):
        with pytest.raises(EngineError):
            bad()
    assert dict(e.read("s").dtypes)["n"] == "bigint" and [r["n"] for r in e.read("s").collect()] == [1]
    e.import_("s", str(tmp_path / "good.json"))
    assert {r["id"]: (r["n"], r["t"]) for r in e.read("s").collect()} == {"a": (1, "x"), "b": (3, "none")}


def test_two_engines_lose_no_write(e):
    e.sql("INSERT INTO p (id, v) VALUES ('a', 1)")
    other = Engine(e.spark, e._root)
    e.sql("BEGIN")
    e.sql("UPDATE p SET v = 10")
    e.sql("INSERT INTO q (id, v) VALUES ('n', 1)")
    other.sql("UPDATE p SET v = 20")
    other.define_ttl("r", 5)
    with pytest.raises(EngineError):
        e.sql("COMMIT")
    assert [r["v"] for r in e.read("p").collect()] == [20] and e.collections() == ["p", "r"]
    e.sql("INSERT INTO p (id, v) VALUES ('b', 2)")
    assert ids(other) == ["a", "b"]
    e.store.set("p", ttl=None)
    assert set(Engine(e.spark, e._root).store.collections) == {"p", "r"}


def test_locks(e, tmp_path):
    from tesserae.sources import store

    e.sql("INSERT INTO p (id, v) VALUES ('a', 1)")
    lock = tmp_path / "db" / "write.lock"
    lock.write_text("{}")
    before = store.PATIENCE, store.LEASE
    try:
        store.PATIENCE = 0.2
        with pytest.raises(EngineError):
            e.sql("DELETE FROM p")
        store.LEASE = -1  # its writer is dead
        e.sql("DELETE FROM p")
    finally:
        store.PATIENCE, store.LEASE = before
    assert ids(e) == [] and not lock.exists()


def test_vacuum_and_damaged_backups(e, tmp_path):
    e.sql("INSERT INTO p (id, v) VALUES ('a', 1)")
    e.sql("UPDATE p SET v = 2")
    assert e.store.vacuum() == 0 and e.store.vacuum(-1) == 1 and [r["v"] for r in e.read("p").collect()] == [2]
    e.backup(str(tmp_path / "b"))
    part = next((tmp_path / "b" / "files").rglob("*.parquet"))
    whole = part.read_bytes()
    part.write_bytes(whole[:-1] + b"x")
    with pytest.raises(EngineError):
        e.restore(str(tmp_path / "b"))
    part.write_bytes(whole)
    e.sql("DELETE FROM p")
    e.restore(str(tmp_path / "b"))
    assert ids(e) == ["a"]
