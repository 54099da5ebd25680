"""Statements over the shared collections, errors, plans and similarity."""

import pytest

from tesserae.engine import Engine
from tesserae.errors import EngineError
from tesserae.functions.embed import HashEmbedder
from tesserae.plans.parser import parse
from tests import fixtures


@pytest.fixture(scope="module")
def e(spark):
    return fixtures.engine(spark)


def rows(e, sql):
    return [tuple(r) for r in e.sql(sql).collect()]


def test_projection(e):
    assert rows(e, "SELECT weight * 2, UPPER(label) AS u, 'x' FROM tools WHERE id = 't3'") == [(8, "LöTER", "x")]
    assert e.sql("SELECT weight * 2, UPPER(label), SUM(weight), 'x' FROM tools GROUP BY weight, label").columns == ["weight * 2", "UPPER(label)", "SUM(weight)", "'x'"]
    assert e.sql("SELECT *, weight + 1 AS weight FROM tools").columns == ["id", "label", "weight", "kind", "spare", "metal", "marks"]
    assert rows(e, "SELECT absent, 7 / 2 AS d, 7 % 0 AS m, 'a' + 'b' AS s, 'a' + 1 AS z FROM tools LIMIT 1") == [(None, 3.5, None, "ab", None)]


def test_aggregates(e):
    got = rows(e, "SELECT site, SUM(pay) AS s, AVG(pay) AS a, COUNT(*) AS n, COUNT(pay) AS c FROM jobs GROUP BY site ORDER BY site")
    assert got == [(None, None, None, 1, 0), ("North", 100.0, 50.0, 2, 2), ("South", 42.5, 21.25, 2, 2)]
    assert rows(e, "SELECT site FROM jobs GROUP BY site HAVING SUM(pay) > 50") == [("North",)]
    assert rows(e, "SELECT site, SUM(pay) AS s FROM jobs GROUP BY site HAVING s < 50 AND site IS NOT NULL") == [("South", 42.5)]
    assert rows(e, "SELECT COUNT(*) AS n, SUM(pay) AS s FROM jobs WHERE pay > 1000") == [(0, None)]
    assert rows(e, "SELECT site, who FROM jobs GROUP BY site ORDER BY site") == [(None, "max"), ("North", "kim"), ("South", "lee")]
    assert rows(e, "SELECT DISTINCT who FROM jobs ORDER BY who") == [("kim",), ("lee",), ("max",)]
    assert e.sql("SELECT COUNT(*) FROM jobs WHERE who = 'lee'") == 2


def test_dates(e):
    assert rows(e, "SELECT YEAR(made), MONTH(made), DAY(made), HOUR(made), DATE(made) FROM jobs WHERE id = 'j3'") == [(2025, 7, 31, 23, "2025-07-31")]
    assert rows(e, "SELECT YEAR(made) AS y, DATE(pay) AS d FROM jobs WHERE id = 'j5'") == [(None, None)]
    assert rows(e, "SELECT id FROM jobs WHERE MONTH(made) = 7 ORDER BY id") == [("j2",), ("j3",)]
    assert rows(e, "SELECT DATEDIFF('2025-03-06T12:00:00', made) AS n FROM jobs WHERE id = 'j1'") == [(8,)]


def test_texts(e):
    q = "SELECT LENGTH('ñu') AS a, SUBSTR('abcdef', 2, 3) AS b, SUBSTR('abcdef', -2) AS c, CONCAT('a', NULL, 1, TRUE, 2.0) AS d, TRIM('  x ') AS t, REPLACE('aXa', 'X', '-') AS r, SUBSTR('abcdef', 1, -2) AS s, UPPER('ñandú') AS u FROM tools LIMIT 1"
    assert rows(e, q) == [(3, "cde", "ef", "a1true2", "x", "a-a", "bcd", "ñANDú")]
    assert rows(e, "SELECT ROUND(2.5) AS a, ROUND(-2.5) AS b, CEIL(1.2) AS c, FLOOR(-1.2) AS d, ABS(-3) AS f, ROUND('7') AS g, LENGTH(marks) AS h FROM tools WHERE id = 't1'") == [(3.0, -3.0, 2.0, -2.0, 3, None, 2)]


def test_joins(e):
    got = rows(e, "SELECT c.name, p.name FROM loans p JOIN people c ON p.who = c.id ORDER BY p.name")
    assert sorted(got) == [("Kim", "axe"), ("Kim", "saw"), ("Lee", "rope")]
    left = rows(e, "SELECT p.name AS n, c.name AS c FROM loans p LEFT JOIN people c ON c.id = p.who ORDER BY n")
    assert left == [("axe", "Kim"), ("rope", "Lee"), ("saw", "Kim"), ("tent", None)]
    assert rows(e, "SELECT c.name AS n, SUM(p.fee) AS s FROM people c LEFT JOIN loans p ON c.id = p.who GROUP BY c.name ORDER BY n") == [("Kim", 10.0), ("Lee", 1.5), ("Max", None)]
    assert e.sql("SELECT * FROM people c JOIN loans p ON c.id = p.who").columns == ["id", "name", "site", "c.id", "c.name", "c.site", "p.id", "p.who", "p.name", "p.fee"]
    assert e.sql("SELECT COUNT(*) FROM loans p JOIN people c ON p.who = c.id") == 3


def test_subqueries(e):
    assert rows(e, "SELECT name FROM people WHERE id IN (SELECT who FROM loans WHERE fee > 3) ORDER BY name") == [("Kim",)]
    assert rows(e, "SELECT name FROM people WHERE id NOT IN (SELECT who FROM loans) ORDER BY name") == [("Max",)]
    assert rows(e, "SELECT name FROM people WHERE NOT id IN (SELECT who FROM loans WHERE fee > 900) AND site IS NULL") == [("Max",)]
    assert e.sql("SELECT COUNT(*) FROM people WHERE EXISTS (SELECT id FROM loans WHERE fee > 900)") == 0
    assert e.sql("SELECT COUNT(*) FROM people WHERE EXISTS (SELECT id FROM loans WHERE fee > 3)") == 3
    assert e.sql("SELECT COUNT(*) FROM people WHERE NOT EXISTS (SELECT id FROM loans WHERE fee > 900) AND site IS NULL") == 1
    assert e.sql("SELECT COUNT(*) FROM people WHERE EXISTS (SELECT id FROM loans WHERE fee > 900) OR name = 'Kim'") == 1
    assert rows(e, "SELECT site FROM jobs GROUP BY site HAVING site IN (SELECT site FROM people WHERE name = 'Kim')") == [("North",)]
    with pytest.raises(EngineError):
        e.sql("SELECT id FROM people c WHERE EXISTS (SELECT id FROM loans WHERE who = c.id)")


@pytest.mark.parametrize(
    "bad",
    ["", "SELECT", "SELECT * FROM", "SELECT * FROM p WHERE", "SELECT * FROM p WHERE n ==", "SELECT * FROM p LIMIT -1", "SELECT * FROM p; SELECT 1", "SELECT NOPE(n) FROM p",
     "SELECT UPPER() FROM p", "SELECT * FROM p WHERE COUNT(*) > 1", "SELECT n FROM p HAVING n = 1", "SELECT * FROM p JOIN jobs ON a > b", "DROP", "SELECT * FROM p WHERE n = 'x", "SELECT * FROM p ORDER BY UPPER(n)",
     "SELECT to FROM p", "SELECT * FROM p WHERE " + "(" * 300 + "n = 1" + ")" * 300, "SELECT '" + "x" * 300_000 + "' FROM p"],
)
def test_errors(bad):
    with pytest.raises(EngineError):
        parse(bad)


def test_order_and_slices(e):
    assert [r[0] for r in rows(e, "SELECT id, weight FROM tools ORDER BY weight DESC")] == ["t6", "t4", "t1", "t3", "t2", "t5"]
    assert [r[0] for r in rows(e, "SELECT id FROM tools ORDER BY spare")] == ["t2", "t4", "t1", "t5", "t3", "t6"]
    assert [r[0] for r in rows(e, "SELECT id FROM tools ORDER BY id LIMIT 2 OFFSET 3")] == ["t4", "t5"]
    assert rows(e, "SELECT id FROM tools LIMIT 0") == []
    q = e.find("tools").where("kind", "measure").order_by("weight", "desc")
    assert [r["id"] for r in q.get()] == ["t4", "t2", "t5"] and q.limit(1).count() == 3 and q.first()["id"] == "t4"
    assert q.limit(-3).get() == [] and e.find("tools").select("id", "absent").df().columns == ["id"]


def test_explain_and_reach(e):
    said = e.sql("EXPLAIN SELECT id FROM jobs WHERE who = 'lee'")
    assert said["explain"] and "Filter" in said["plan"]
    assert e.sql("EXPLAIN DELETE FROM jobs")["coleccion"] == "jobs"
    assert e.reach("SELECT * FROM a JOIN b ON a.x = b.y WHERE z IN (SELECT q FROM c WHERE EXISTS (SELECT w FROM d))") == {"a", "b", "c", "d"}
    assert e.reach("DELETE FROM a WHERE x IN (SELECT y FROM b)") == {"a", "b"} and e.reach("rubbish") == {"\0"}
    guarded = Engine(e.spark, guard=lambda name: (_ for _ in ()).throw(EngineError("no")) if name == "tools" else None)
    guarded.given = e.given
    with pytest.raises(EngineError):
        guarded.sql("SELECT id FROM jobs WHERE id IN (SELECT id FROM tools)")


ARTICLES = [
    ("a1", "Sharpening kitchen knives", "steel", True), ("a2", "Planting tulips", "garden", True),
    ("a3", "Tulips in water", "home", False), ("a4", "How lighthouses were built", "coast", True),
]


def test_similarity(spark):
    e = Engine(spark, embedder=HashEmbedder(256)).register("art", spark.createDataFrame(ARTICLES, "id string, title string, topic string, out boolean"))
    with pytest.raises(EngineError):
        e.similar("art", "tulip")
    e.enable_vectors("art", auto=("title",))
    assert {r["id"] for r in e.similar("art", "tulips", 2).collect()} == {"a2", "a3"}
    assert [r["id"] for r in e.similar("art", "tulips", 2, e.find("art").where("out", True)).collect()][0] == "a2"
    got = e.sql("SELECT id FROM art WHERE out = TRUE AND parecido > 0.2 ORDER BY EMBEDDING <-> 'tulips' LIMIT 5")
    assert got.columns == ["_score", "id"] and [r["id"] for r in got.collect()] == ["a2"]
    assert e.sql("SELECT * FROM art ORDER BY EMBEDDING <-> 'tulips'").columns[-1] == "_score"
    fused = e.hybrid("art", "tulips", 3).collect()
    assert [r["id"] for r in fused][:2] == ["a2", "a3"] or [r["id"] for r in fused][:2] == ["a3", "a2"]
    assert fused[0]["en"] == ["significado", "palabra"]
    for bad in ("parecido > 0.1 OR id = 'a1'", "NOT parecido > 0.1", "parecido > 0.1 AND parecido < 0.9"):
        with pytest.raises(EngineError):
            e.sql(f"SELECT id FROM art WHERE {bad} ORDER BY EMBEDDING <-> 'x'")


def test_filters_and_columns_reach_the_scan(spark):
    e = Engine(spark).register_folder("/root/testdata/sf0.001", "orders")
    said = e.sql("EXPLAIN SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderdate <= '1997-01-01' AND o_custkey IN (1, 2) AND (o_orderstatus = 'F' OR o_custkey BETWEEN 3 AND 5)")["plan"]
    pushed = next(x for x in said.splitlines() if "PushedFilters" in x)
    for part in ("GreaterThan(o_totalprice", "LessThanOrEqual(o_orderdate", "In(o_custkey", "EqualNullSafe(o_orderstatus"):
        assert part in pushed, pushed
    schema = next(x for x in said.splitlines() if "ReadSchema" in x)
    assert "o_orderpriority" not in schema


def test_planning_runs_no_job(spark):
    e = Engine(spark).register_folder("/root/testdata/sf0.001", "orders", "nation")
    tracker, group = spark.sparkContext.statusTracker(), "planning"
    spark.sparkContext.setJobGroup(group, group)
    e.sql("EXPLAIN SELECT o_orderkey FROM orders WHERE EXISTS (SELECT n_name FROM nation WHERE n_nationkey > 3) OR o_orderkey = 1")
    assert not tracker.getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
