"""Small collections that the tests share: a tool library."""

from tesserae.engine import Engine

TOOLS = [
    ("t1", "Hammer", 7, "strike", 3, True, ["steel", "old"]),
    ("t2", "Ruler", 1, "measure", None, False, ["wood"]),
    ("t3", "Löter", 4, "care", 9, True, []),
    ("t4", "Level", 9, "measure", 0, False, ["glass", "old"]),
    ("t5", "Scale", None, "measure", 6, True, ["steel"]),
    ("t6", None, 12, None, 15, None, None),
]
JOBS = [
    ("j1", "North", "kim", 40.0, "2025-03-15T08:00:00+00:00"),
    ("j2", "South", "lee", 12.5, "2025-07-09T16:45:00+00:00"),
    ("j3", "North", "lee", 60.0, "2025-07-31T23:59:59+00:00"),
    ("j4", "South", "max", 30.0, "2025-11-02T00:00:00+00:00"),
    ("j5", None, "max", None, "someday"),
]
PEOPLE = [("u1", "Kim", "North"), ("u2", "Lee", "South"), ("u3", "Max", None)]
LOANS = [("l1", "u1", "saw", 4.0), ("l2", "u1", "axe", 6.0), ("l3", "u2", "rope", 1.5), ("l4", "u9", "tent", 2.0)]


def engine(spark) -> Engine:
    e = Engine(spark)
    e.register("tools", spark.createDataFrame(TOOLS, "id string, label string, weight long, kind string, spare long, metal boolean, marks array<string>"))
    e.register("jobs", spark.createDataFrame(JOBS, "id string, site string, who string, pay double, made string"))
    e.register("people", spark.createDataFrame(PEOPLE, "id string, name string, site string"))
    e.register("loans", spark.createDataFrame(LOANS, "id string, who string, name string, fee double"))
    return e
