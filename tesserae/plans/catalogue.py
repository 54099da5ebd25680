"""Queries for the driver, one or more for each operator, with the SQL that checks them.

Most entries are a statement of the query language and the standard SQL of the
same meaning. Nulls, which the tables lack, come from left joins and from
division by zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import EngineError
from ..functions.embed import HashEmbedder
from ..sources.scratch import scratch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the tables at sf_dir, with views that hold nulls, lists and ISO texts."""
    e = Engine(spark)
    e.given = _Lazy(spark, sf_dir)
    return e


class _Lazy(dict):
    """Tables that are opened when a query names them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir
        self.made = {
            # labels are missing for part of the documents
            "doclabels": lambda: self["documents"].join(self["labels"], "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "quality", "toxic"),
            "doclists": lambda: self["documents"].select("doc_id", "lang", F.split("text", " ").alias("words")),
            "isoorders": lambda: self["orders"].select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso")),
            "sizes": lambda: self["part"].select("p_partkey", F.col("p_size").cast("string").alias("size_text"), "p_size"),
        }

    def __contains__(self, name) -> bool:
        return name in TABLES or name in self.made

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.made[name]() if name in self.made else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]


#: DuckDB text of the engine's derived collections.
_VIEWS = {
    "doclabels": "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
    "doclists": "(SELECT doc_id, lang, string_split(text, ' ') AS words FROM documents)",
    "isoorders": "(SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders)",
    "sizes": "(SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text, p_size FROM part)",
}


def add(name: str, statement: str, sql: str | None = None) -> None:
    """An entry whose two texts are one where the language and SQL agree."""
    QUERIES[name] = lambda spark, sf_dir, s=statement: engine(spark, sf_dir).query(s)
    sql = statement if sql is None else sql
    for v, body in _VIEWS.items():
        sql = sql.replace(f"{{{v}}}", body)
    SQL[name] = sql


FLAGSHIP = """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty, ROUND(AVG(l_discount), 4) AS disc, COUNT(*) AS n
    FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query(FLAGSHIP)


add("flagship", FLAGSHIP, FLAGSHIP.replace("'1998-09-02'", "TIMESTAMP '1998-09-02'"))

# scans and projections
add("scan_all", "SELECT * FROM nation")
add("project_fields", "SELECT o_orderkey, o_orderstatus FROM orders")
add("project_expr_alias", "SELECT p_partkey, p_size * 2 AS twice FROM part", "SELECT p_partkey, CAST(p_size * 2 AS BIGINT) AS twice FROM part")
add("default_column_name", "SELECT p_partkey, p_size * 2 FROM part", 'SELECT p_partkey, CAST(p_size * 2 AS BIGINT) AS "p_size * 2" FROM part')
add("absent_field_null", "SELECT n_nationkey, IFNULL(nothing, 'none') AS v FROM nation", "SELECT n_nationkey, 'none' AS v FROM nation")
add("star_plus_expr", "SELECT *, r_regionkey + 1 AS nxt FROM region", "SELECT *, CAST(r_regionkey + 1 AS BIGINT) AS nxt FROM region")
add("arith_precedence", "SELECT p_partkey, p_size + 2 * 3 - -1 AS v FROM part", "SELECT p_partkey, CAST(p_size + 7 AS BIGINT) AS v FROM part")
add("arith_brackets", "SELECT p_partkey, (p_size + 2) * 3 AS v FROM part", "SELECT p_partkey, CAST((p_size + 2) * 3 AS BIGINT) AS v FROM part")
add("unary_minus", "SELECT n_nationkey, -n_nationkey AS v FROM nation", "SELECT n_nationkey, CAST(-n_nationkey AS BIGINT) AS v FROM nation")
add("div_by_zero_null", "SELECT n_nationkey, ROUND(10 / n_regionkey, 6) AS v FROM nation", "SELECT n_nationkey, ROUND(CASE WHEN n_regionkey = 0 THEN NULL ELSE 10.0::DOUBLE / n_regionkey END, 6) AS v FROM nation")
add("modulo_fmod", "SELECT n_nationkey, (n_nationkey - 12) % 5 AS v FROM nation", "SELECT n_nationkey, CAST((n_nationkey - 12) % 5 AS DOUBLE) AS v FROM nation")
add("string_plus_concat", "SELECT n_nationkey, n_name + '!' AS v FROM nation", "SELECT n_nationkey, n_name || '!' AS v FROM nation")
add("string_plus_number_null", "SELECT n_nationkey FROM nation WHERE n_name + 1 IS NULL", "SELECT n_nationkey FROM nation")
add("literals", "SELECT r_regionkey, 'it''s' AS t, 7 AS i, 2.5 AS d, TRUE AS b FROM region", "SELECT r_regionkey, 'it''s' AS t, 7 AS i, CAST(2.5 AS DOUBLE) AS d, TRUE AS b FROM region")

# predicates
add("eq", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
add("neq_null_rows", "SELECT doc_id FROM doclabels WHERE quality != 1", "SELECT doc_id FROM {doclabels} WHERE quality IS DISTINCT FROM 1")
add("eq_null_literal", "SELECT doc_id FROM doclabels WHERE quality = NULL", "SELECT doc_id FROM {doclabels} WHERE quality IS NULL")
add("lt_null_lowest", "SELECT doc_id FROM doclabels WHERE quality < 1", "SELECT doc_id FROM {doclabels} WHERE quality < 1 OR quality IS NULL")
add("lte", "SELECT doc_id FROM doclabels WHERE quality <= 0", "SELECT doc_id FROM {doclabels} WHERE quality <= 0 OR quality IS NULL")
add("gt", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
add("gte", "SELECT doc_id FROM doclabels WHERE quality >= 1", "SELECT doc_id FROM {doclabels} WHERE quality >= 1")
add("in_list", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
add("not_in_list", "SELECT doc_id FROM doclabels WHERE quality NOT IN (0)", "SELECT doc_id FROM {doclabels} WHERE NOT COALESCE(quality IN (0), FALSE)")
add("in_list_with_null", "SELECT doc_id FROM doclabels WHERE quality IN (1, NULL)", "SELECT doc_id FROM {doclabels} WHERE quality = 1 OR quality IS NULL")
add("like_ci", "SELECT p_partkey FROM part WHERE p_name LIKE '%RED%'", "SELECT p_partkey FROM part WHERE p_name ILIKE '%RED%'")
add("like_underscore", "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE '_uild%'", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '_uild%'")
add("like_number_false", "SELECT p_partkey FROM part WHERE p_size LIKE '1%'", "SELECT p_partkey FROM part WHERE FALSE")
add("not_like_null", "SELECT p_partkey FROM part WHERE nothing NOT LIKE 'x'", "SELECT p_partkey FROM part")
add("contains_text", "SELECT p_partkey FROM part WHERE p_type CONTAINS 'econ'", "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'econ')")
add("contains_list", "SELECT doc_id FROM doclists WHERE words CONTAINS 'the'", "SELECT doc_id FROM {doclists} WHERE list_contains(words, 'the')")
add("not_contains", "SELECT p_partkey FROM part WHERE p_type NOT CONTAINS 'econ'", "SELECT p_partkey FROM part WHERE NOT contains(lower(p_type), 'econ')")
add("between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
add("not_between", "SELECT doc_id FROM doclabels WHERE quality NOT BETWEEN 1 AND 2", "SELECT doc_id FROM {doclabels} WHERE NOT COALESCE(quality BETWEEN 1 AND 2, FALSE)")
add("is_null", "SELECT doc_id FROM doclabels WHERE quality IS NULL", "SELECT doc_id FROM {doclabels} WHERE quality IS NULL")
add("is_not_null", "SELECT doc_id FROM doclabels WHERE quality IS NOT NULL", "SELECT doc_id FROM {doclabels} WHERE quality IS NOT NULL")
add("and_or_not_precedence", "SELECT p_partkey FROM part WHERE p_size = 1 OR p_size = 2 AND NOT p_brand = 'Brand#11' OR NOT (p_size < 49)", "SELECT p_partkey FROM part WHERE p_size = 1 OR (p_size = 2 AND p_brand <> 'Brand#11') OR p_size >= 49")
add("field_vs_field", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > l_discount")
add("expr_in_where", "SELECT o_orderkey FROM orders WHERE MONTH(o_orderdate) = 4 AND o_totalprice / 2 > 50000")
add("num_text_coercion", "SELECT p_partkey FROM sizes WHERE size_text = 7", "SELECT p_partkey FROM {sizes} WHERE p_size = 7")
add("num_text_order", "SELECT p_partkey FROM sizes WHERE size_text < 7", "SELECT p_partkey FROM {sizes} WHERE p_size < 7")
add("text_time_compare", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1997-01-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
add("bool_never_number", "SELECT n_nationkey FROM nation WHERE n_regionkey = TRUE", "SELECT n_nationkey FROM nation WHERE FALSE")

# joins
add("join_inner", "SELECT n_name, r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT n_name, r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
QUERIES["join_inner"] = lambda spark, d: engine(spark, d).query("SELECT n_name, r.r_name AS r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
add("join_left", "SELECT c_custkey, o.o_orderkey AS o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey, o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
_UNMATCHED = "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL"
add("join_left_unmatched", f"SELECT d.doc_id AS doc_id {_UNMATCHED}")
_THREE = "FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'"
add("join_three_way", f"SELECT c_custkey, n.n_name AS nation {_THREE}", f"SELECT c_custkey, n.n_name AS nation {_THREE}")
add("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
add("join_reversed_on", "SELECT n_name, r.r_name AS region FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey", "SELECT n_name, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
add("join_bare_on", "SELECT n_name, r.r_name AS region FROM nation n JOIN region r ON n_regionkey = r_regionkey", "SELECT n_name, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
add("join_prefixed_names", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", 'SELECT n.n_name AS "n.n_name", r.r_name AS "r.r_name" FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey')
add("join_star", "SELECT * FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey",
    'SELECT r.r_regionkey, r.r_name, r.r_regionkey AS "r.r_regionkey", r.r_name AS "r.r_name", n.n_nationkey AS "n.n_nationkey", n.n_name AS "n.n_name", n.n_regionkey AS "n.n_regionkey" FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey')
add("join_filter_right", "SELECT o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'", "SELECT o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
add("join_group", "SELECT c.c_mktsegment AS seg, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment", "SELECT c.c_mktsegment AS seg, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment")
add("join_left_having", "SELECT c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c_custkey HAVING n < 3")
SQL["join_left_having"] = "SELECT c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c_custkey HAVING COUNT(o.o_orderkey) < 3"
add("join_mixed_type_key", "SELECT s.p_partkey AS a, n_nationkey FROM nation n JOIN sizes s ON n.n_nationkey = s.size_text", "SELECT s.p_partkey AS a, n_nationkey FROM nation n JOIN {sizes} s ON n.n_nationkey = s.p_size")

# aggregates
add("count_bare", "SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F'", "SELECT COUNT(*) AS \"COUNT(*)\" FROM orders WHERE o_orderstatus = 'F'")
add("count_star_row", "SELECT COUNT(*) AS n, MIN(o_orderkey) AS lo FROM orders")
add("count_field", "SELECT COUNT(quality) AS n FROM doclabels", "SELECT COUNT(quality) AS n FROM {doclabels}")
add("sum", "SELECT SUM(p_size) AS s FROM part", "SELECT CAST(SUM(p_size) AS BIGINT) AS s FROM part")
add("avg_float", "SELECT ROUND(AVG(p_size), 6) AS a FROM part")
add("min_max", "SELECT MIN(o_orderpriority) AS lo, MAX(o_totalprice) AS hi FROM orders")
add("group_by", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
add("group_multi", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
add("group_null_key", "SELECT quality, COUNT(*) AS n FROM doclabels GROUP BY quality", "SELECT quality, COUNT(*) AS n FROM {doclabels} GROUP BY quality")
add("agg_over_expr", "SELECT l_returnflag, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS v FROM lineitem GROUP BY l_returnflag")
add("expr_over_agg", "SELECT o_orderstatus, ROUND(SUM(o_totalprice) / COUNT(*), 2) AS v FROM orders GROUP BY o_orderstatus")
add("having_agg", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
add("having_alias", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
add("having_right_side", "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus HAVING 100 < COUNT(*)")
add("agg_empty_input", "SELECT COUNT(*) AS n, SUM(p_size) AS s FROM part WHERE p_size > 100000", "SELECT COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS s FROM part WHERE p_size > 100000")
add("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add("group_no_agg", "SELECT p_brand FROM part GROUP BY p_brand")

# order and limit
add("order_multi", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey ASC LIMIT 50")
add("order_by_alias", "SELECT p_partkey, p_size * -1 AS neg FROM part ORDER BY neg, p_partkey LIMIT 20", "SELECT p_partkey, CAST(p_size * -1 AS BIGINT) AS neg FROM part ORDER BY neg, p_partkey LIMIT 20")
add("order_by_unprojected", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
add("order_nulls", "SELECT doc_id, quality FROM doclabels ORDER BY quality, doc_id LIMIT 20", "SELECT doc_id, quality FROM {doclabels} ORDER BY quality NULLS FIRST, doc_id LIMIT 20")
add("order_nulls_desc", "SELECT doc_id, quality FROM doclabels ORDER BY quality DESC, doc_id LIMIT 20", "SELECT doc_id, quality FROM {doclabels} ORDER BY quality DESC NULLS LAST, doc_id LIMIT 20")
add("limit", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5")
add("offset_only", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
add("limit_offset", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 7")
add("limit_zero", "SELECT n_nationkey FROM nation LIMIT 0")
add("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")

# functions
_AZ = "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_ZA = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
add("fn_upper", "SELECT doc_id, UPPER(text) AS v FROM documents", f"SELECT doc_id, translate(text, {_AZ}) AS v FROM documents")
add("fn_lower", "SELECT doc_id, LOWER(text) AS v FROM documents", f"SELECT doc_id, translate(text, {_ZA}) AS v FROM documents")
add("fn_trim", "SELECT n_nationkey, TRIM('  ' + n_name + ' ') AS v FROM nation", "SELECT n_nationkey, n_name AS v FROM nation")
add("fn_length", "SELECT doc_id, LENGTH(text) AS v FROM documents", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS v FROM documents")
add("fn_length_list", "SELECT doc_id, LENGTH(words) AS v FROM doclists", "SELECT doc_id, CAST(len(words) AS BIGINT) AS v FROM {doclists}")
add("fn_concat", "SELECT n_nationkey, CONCAT(n_name, '-', n_regionkey, NULL, TRUE) AS v FROM nation", "SELECT n_nationkey, n_name || '-' || n_regionkey || 'true' AS v FROM nation")
add("fn_substr", "SELECT p_partkey, SUBSTR(p_name, 2, 3) AS a, SUBSTR(p_name, -3) AS b FROM part", "SELECT p_partkey, substr(p_name, 3, 3) AS a, right(p_name, 3) AS b FROM part")
add("fn_replace", "SELECT p_partkey, REPLACE(p_type, 'ECO', 'x') AS v FROM part", "SELECT p_partkey, replace(p_type, 'ECO', 'x') AS v FROM part")
add("fn_round", "SELECT o_orderkey, ROUND(o_totalprice) AS v FROM orders", "SELECT o_orderkey, ROUND(o_totalprice) AS v FROM orders")
add("fn_abs", "SELECT n_nationkey, ABS(n_nationkey - 12) AS v FROM nation", "SELECT n_nationkey, CAST(abs(n_nationkey - 12) AS BIGINT) AS v FROM nation")
add("fn_ceil", "SELECT o_orderkey, CEIL(o_totalprice) AS v FROM orders", "SELECT o_orderkey, CAST(ceil(o_totalprice) AS DOUBLE) AS v FROM orders")
add("fn_floor", "SELECT o_orderkey, FLOOR(o_totalprice) AS v FROM orders", "SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS v FROM orders")
QUERIES["fn_now"] = lambda spark, d: engine(spark, d).query("SELECT r_regionkey, NOW() AS v FROM region")
QUERIES["fn_curdate"] = lambda spark, d: engine(spark, d).query("SELECT r_regionkey, CURDATE() AS v FROM region")
add("fn_date", "SELECT o_orderkey, DATE(o_orderdate) AS v FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS v FROM orders")
add("fn_date_text", "SELECT o_orderkey, DATE(iso) AS v FROM isoorders", "SELECT o_orderkey, substr(iso, 1, 10) AS v FROM {isoorders}")
for _f in ("YEAR", "MONTH", "DAY", "HOUR"):
    add(f"fn_{_f.lower()}", f"SELECT event_id, {_f}(ts) AS v FROM events", f"SELECT event_id, CAST({_f}(ts) AS BIGINT) AS v FROM events")
add("fn_datediff", "SELECT o_orderkey, DATEDIFF(o_orderdate, '1998-01-01T12:00:00') AS v FROM orders", "SELECT o_orderkey, CAST(trunc((epoch(TIMESTAMP '1998-01-01 12:00:00') - epoch(o_orderdate)) / 86400) AS BIGINT) AS v FROM orders")
add("fn_ifnull", "SELECT doc_id, IFNULL(quality, 9) AS v FROM doclabels", "SELECT doc_id, COALESCE(quality, 9) AS v FROM {doclabels}")

# subqueries
add("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
add("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
add("in_subquery_or", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
add("exists_true", "SELECT r_name FROM region WHERE EXISTS (SELECT n_name FROM nation WHERE n_nationkey = 3)")
add("exists_false", "SELECT r_name FROM region WHERE EXISTS (SELECT n_name FROM nation WHERE n_nationkey = 999)")
add("not_exists", "SELECT r_name FROM region WHERE NOT EXISTS (SELECT n_name FROM nation WHERE n_nationkey = 999)")
add("in_subquery_agg", "SELECT o_orderkey FROM orders WHERE o_totalprice IN (SELECT MAX(o_totalprice) FROM orders)")
add("in_subquery_mixed_types", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT size_text FROM sizes)", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT p_size FROM part)")


def _query(name: str, sql: str | None = None):
    """Register a Python query; sql is its check."""

    def put(f):
        QUERIES[name] = f
        if sql:
            for v, body in _VIEWS.items():
                sql_ = SQL.get(name, sql).replace(f"{{{v}}}", body)
                SQL[name] = sql_
        return f

    return put


# fluent queries


@_query("fluent_where_chain", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def _fluent_chain(spark, d):
    return engine(spark, d).find("orders").where("o_orderstatus", "F").where("o_totalprice", ">", 100000).select("o_orderkey").df()


@_query("fluent_where_expr", "SELECT p_partkey FROM part WHERE p_size = 1 OR p_brand LIKE 'Brand#1%'")
def _fluent_expr(spark, d):
    return engine(spark, d).find("part").where_expr("p_size = 1 OR p_brand LIKE 'brand#1%'").select("p_partkey").df()


@_query("fluent_join", 'SELECT n.n_name, r.r_name AS "region.r_name" FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey')
def _fluent_join(spark, d):
    return engine(spark, d).find("nation").join("region", "n_regionkey", "r_regionkey").select("n_name", "region.r_name").df()


@_query("fluent_select_order_limit", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 10 OFFSET 5")
def _fluent_slice(spark, d):
    q = engine(spark, d).find("part").order_by("p_size", "desc").order_by("p_partkey").limit(10).offset(5)
    return q.select("p_partkey", "p_size", "absent").df()


@_query("fluent_count", "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def _fluent_count(spark, d):
    return spark.createDataFrame([(engine(spark, d).find("orders").where("o_orderstatus", "O").limit(3).count(),)], "n long")


@_query("by_field", "SELECT * FROM nation WHERE n_regionkey = 2")
def _by(spark, d):
    return engine(spark, d).by("nation", "n_regionkey", 2)


def _keyed(spark, d) -> Engine:
    e = engine(spark, d)
    e.given["n"] = e.given["nation"].withColumn("id", F.col("n_nationkey").cast("string"))
    e.given.made["n"] = lambda: e.given["n"]
    return e


@_query("get_by_id", "SELECT n_name FROM nation WHERE n_nationkey = 7")
def _get(spark, d):
    return _keyed(spark, d).get("n", "7").select("n_name")


@_query("ids", "SELECT CAST(n_nationkey AS VARCHAR) AS id FROM nation ORDER BY 1")
def _ids(spark, d):
    return _keyed(spark, d).ids("n")


@_query("group_representative", "SELECT n_regionkey, arg_min(n_name, CAST(n_nationkey AS VARCHAR)) AS n_name FROM nation GROUP BY n_regionkey")
def _representative(spark, d):
    return _keyed(spark, d).query("SELECT n_regionkey, n_name FROM n GROUP BY n_regionkey")


# views and writes, on a managed copy of nation


def _managed(spark, d) -> Engine:
    e = Engine(spark, scratch(spark))
    nation = spark.read.parquet(f"{d}/nation.parquet")
    e.store.create("nation")
    e.merge("nation", nation.select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("id"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey")), False)
    return e


_NATION = "(SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation)"


def _after(name: str, sql: str, *statements: str, then: str = "SELECT id, n_name, n_regionkey FROM nation") -> None:
    """The state of the managed collection after some statements."""

    def run(spark, d):
        e = _managed(spark, d)
        for s in statements:
            e.sql(s)
        return e.query(then)

    QUERIES[name], SQL[name] = run, sql.replace("{nation}", _NATION)


_after("view_select", "SELECT id, n_name FROM {nation} WHERE n_regionkey = 1", "CREATE VIEW v AS SELECT id, n_name FROM nation WHERE n_regionkey = 1", then="SELECT * FROM v")
_after("view_filter_over", "SELECT id FROM {nation} WHERE n_regionkey = 1 AND n_name > 'B'", "CREATE VIEW v AS SELECT * FROM nation WHERE n_regionkey = 1", then="SELECT id FROM v WHERE n_name > 'B'")
_after("view_nested", "SELECT id FROM {nation} WHERE n_regionkey > 1 AND n_regionkey < 4", "CREATE VIEW a AS SELECT * FROM nation WHERE n_regionkey > 1", "CREATE VIEW b AS SELECT * FROM a WHERE n_regionkey < 4", then="SELECT id FROM b")
_after("view_count", "SELECT COUNT(*) AS \"COUNT(*)\" FROM {nation} WHERE n_regionkey = 1", "CREATE VIEW v AS SELECT * FROM nation WHERE n_regionkey = 1", then="SELECT COUNT(*) FROM v")
_after("insert_multi", "SELECT * FROM {nation} UNION ALL VALUES ('98', 'X', 7), ('99', 'Y', NULL)", "INSERT INTO nation (id, n_name, n_regionkey) VALUES ('98', 'X', 7), ('99', 'Y', NULL)")
_after("insert_replaces", "SELECT id, CASE WHEN id = '03' THEN 'X' ELSE n_name END AS n_name, CASE WHEN id = '03' THEN NULL ELSE n_regionkey END AS n_regionkey FROM {nation}", "INSERT INTO nation (id, n_name) VALUES ('03', 'X')")
_after("upsert", "SELECT id, CASE WHEN id = '03' THEN 'X' ELSE n_name END AS n_name, n_regionkey FROM {nation}", "INSERT INTO nation (id, n_name) VALUES ('03', 'X') ON DUPLICATE UPDATE")
_after("update_expr", "SELECT id, n_name, CASE WHEN n_regionkey = 2 THEN n_regionkey * 10 + 1 ELSE n_regionkey END AS n_regionkey FROM {nation}", "UPDATE nation SET n_regionkey = n_regionkey * 10 + 1 WHERE n_regionkey = 2")
_after("update_limit", "SELECT id, CASE WHEN id IN (SELECT id FROM {nation} WHERE n_regionkey = 2 ORDER BY id LIMIT 2) THEN 'z' ELSE n_name END AS n_name, n_regionkey FROM {nation}", "UPDATE nation SET n_name = 'z' WHERE n_regionkey = 2 LIMIT 2")
_after("delete_where", "SELECT * FROM {nation} WHERE NOT n_regionkey = 2", "DELETE FROM nation WHERE n_regionkey = 2")
_after("delete_limit", "SELECT * FROM {nation} WHERE id >= '03'", "DELETE FROM nation LIMIT 3")
_after("delete_not_in_subquery", "SELECT * FROM {nation} WHERE n_regionkey IN (0, 1)", "DELETE FROM nation WHERE id NOT IN (SELECT id FROM nation WHERE n_regionkey < 2)")
_after("alter_add_field", "SELECT id, 5 AS extra FROM {nation}", "ALTER COLLECTION nation ADD FIELD extra = 5", then="SELECT id, extra FROM nation")
_after("alter_drop_field", "SELECT id, 'gone' AS v FROM {nation}", "ALTER COLLECTION nation DROP FIELD n_name", then="SELECT id, IFNULL(n_name, 'gone') AS v FROM nation")
_after("alter_rename_field", "SELECT id, n_name AS label FROM {nation}", "ALTER COLLECTION nation RENAME FIELD n_name TO label", then="SELECT id, label FROM nation")
_after("alter_rename_collection", "SELECT id FROM {nation}", "ALTER COLLECTION nation RENAME TO lands", then="SELECT id FROM lands")
_after("tx_commit", "SELECT * FROM {nation} WHERE n_regionkey <> 1 UNION ALL VALUES ('98', 'X', 7)", "BEGIN", "DELETE FROM nation WHERE n_regionkey = 1", "INSERT INTO nation (id, n_name, n_regionkey) VALUES ('98', 'X', 7)", "COMMIT")
_after("tx_rollback", "SELECT * FROM {nation}", "BEGIN", "DELETE FROM nation", "ROLLBACK")
_after("tx_overlay_scan", "SELECT * FROM {nation} WHERE n_regionkey <> 1", "BEGIN", "DELETE FROM nation WHERE n_regionkey = 1")
_after("write_version", "SELECT id, CAST(CASE WHEN n_regionkey = 2 THEN 2 ELSE 1 END AS BIGINT) AS _version FROM {nation}", "UPDATE nation SET n_name = 'z' WHERE n_regionkey = 2", then="SELECT id, _version FROM nation")


# writes on a managed copy of orders


_ORDERS = "(SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey, o_totalprice, o_orderstatus FROM orders)"


def _orders(spark, d, root: str | None = None) -> Engine:
    e = Engine(spark, root or scratch(spark))
    rows = spark.read.parquet(f"{d}/orders.parquet")
    e.merge("orders", rows.select(F.col("o_orderkey").cast("string").alias("id"), "o_custkey", "o_totalprice", "o_orderstatus"), False)
    return e


def _refused(work) -> bool:
    try:
        work()
    except EngineError:
        return True
    return False


@_query("insert_repeated_id", f"SELECT * FROM {_ORDERS} WHERE id <> '1' UNION ALL VALUES ('1', 8, NULL, 'Y'), ('x', 9, NULL, 'Z')")
def _repeated(spark, d):
    e = _orders(spark, d)
    e.sql("INSERT INTO orders (id, o_custkey, o_orderstatus) VALUES ('1', 7, 'X'), ('x', 7, 'X'), ('1', 8, 'Y'), ('x', 9, 'Z')")
    return e.query("SELECT id, o_custkey, o_totalprice, o_orderstatus FROM orders")


@_query("schema_on_update", f"SELECT id, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, TRUE AS refused FROM {_ORDERS}")
def _schema_on_update(spark, d):
    e = _orders(spark, d)
    e.define_schema("orders", {"o_custkey": {"tipo": "entero", "obligatorio": True}})
    refused = all([_refused(lambda: e.sql("UPDATE orders SET o_custkey = 'text' LIMIT 3")), _refused(lambda: e.sql("UPDATE orders SET o_custkey = NULL WHERE id = '2'"))])
    e.sql("UPDATE orders SET o_custkey = o_custkey + 1 WHERE o_orderstatus = 'F'")
    return e.query("SELECT id, o_custkey FROM orders").withColumn("refused", F.lit(refused))


@_query("import_schema", f"SELECT id, o_custkey, 'none' AS kind, TRUE AS refused FROM {_ORDERS}")
def _import_schema(spark, d):
    e = _orders(spark, d)
    path = scratch(spark) + "/orders.json"
    e.export("orders", path)
    e.define_schema("copy", {"o_custkey": {"tipo": "entero"}, "kind": {"tipo": "texto", "defecto": "none"}})
    e.define_schema("strict", {"o_custkey": {"tipo": "texto"}, "absent": {"obligatorio": True}})
    refused = _refused(lambda: e.import_("strict", path))
    e.import_("copy", path)
    return e.query("SELECT CONCAT(id) AS id, o_custkey, kind FROM copy").withColumn("refused", F.lit(refused))


@_query("tx_conflict", f"SELECT id, CASE WHEN o_orderstatus = 'F' THEN 20 ELSE o_custkey END AS o_custkey, TRUE AS refused FROM {_ORDERS}")
def _conflict(spark, d):
    root = scratch(spark)
    e, other = _orders(spark, d, root), Engine(spark, root)
    e.sql("BEGIN")
    e.sql("UPDATE orders SET o_custkey = 10")
    other.sql("UPDATE orders SET o_custkey = 20 WHERE o_orderstatus = 'F'")
    refused = _refused(lambda: e.sql("COMMIT"))
    return e.query("SELECT id, o_custkey FROM orders").withColumn("refused", F.lit(refused))


@_query("create_index_values", "SELECT COUNT(DISTINCT n_regionkey) AS n FROM nation")
def _index(spark, d):
    return spark.createDataFrame([(_managed(spark, d).sql("CREATE INDEX ON nation (n_regionkey)")["values"],)], "n long")


@_query("unique_violation", "SELECT 'n_regionkey' AS field, TRUE AS refused")
def _violation(spark, d):
    try:
        _managed(spark, d).sql("CREATE UNIQUE INDEX ON nation (n_regionkey)")
        refused = False
    except EngineError:
        refused = True
    return spark.createDataFrame([("n_regionkey", refused)], "field string, refused boolean")


@_query("schema_default", "SELECT 'a' AS id, 'none' AS kind")
def _schema(spark, d):
    e = Engine(spark, scratch(spark))
    e.define_schema("things", {"kind": {"tipo": "texto", "defecto": "none"}})
    e.insert("things", {"id": "a", "n": 1})
    return e.query("SELECT id, kind FROM things")


@_query("ttl_filter", f"SELECT id FROM {_NATION} WHERE FALSE")
def _ttl(spark, d):
    e = _managed(spark, d)
    e.define_ttl("nation", -1)
    return e.query("SELECT id FROM nation")


@_query("describe", "SELECT * FROM (VALUES ('r_name', 'texto', NULL::VARCHAR, 5::BIGINT, 5::BIGINT), ('r_regionkey', 'entero', NULL, 5, 5)) t(campo, tipo, declarado, documentos, de)")
def _describe(spark, d):
    return engine(spark, d).sql("DESCRIBE region")


@_query("show_collections", "SELECT 'nation' AS coleccion")
def _show(spark, d):
    return _managed(spark, d).sql("SHOW COLLECTIONS")


@_query("show_indexes", "SELECT 'nation' AS coleccion, 'n_name' AS campo, TRUE AS unico")
def _show_indexes(spark, d):
    e = _managed(spark, d)
    e.sql("CREATE UNIQUE INDEX ON nation (n_name)")
    return e.sql("SHOW INDEXES ON nation")


def _round_trip(kind: str):
    def run(spark, d):
        e = _managed(spark, d)
        path = scratch(spark) + f"/out.{kind}"
        e.export("nation", path)
        e.import_("copy", path)
        return e.query("SELECT CONCAT(id) AS id, n_name, n_regionkey FROM copy")

    return run


QUERIES["export_import_json"], SQL["export_import_json"] = _round_trip("json"), f"SELECT * FROM {_NATION}"
QUERIES["export_import_csv"], SQL["export_import_csv"] = _round_trip("csv"), f"SELECT CAST(CAST(id AS BIGINT) AS VARCHAR) AS id, n_name, n_regionkey FROM {_NATION}"


@_query("backup_restore", f"SELECT * FROM {_NATION}")
def _backup(spark, d):
    e = _managed(spark, d)
    path = scratch(spark)
    e.store.backup(path)
    e.sql("DELETE FROM nation")
    e.store.restore(path)
    return e.query("SELECT id, n_name, n_regionkey FROM nation")


@_query("checkup", "SELECT 'nation' AS coleccion, 25::BIGINT AS documentos, 1::BIGINT AS version, TRUE AS bien")
def _checkup(spark, d):
    return _managed(spark, d).checkup()


# vectors


def _vectors(spark, d, precision: str = "exacta") -> Engine:
    return engine(spark, d).enable_vectors("embeddings", "embedding", dims=64, precision=precision, key="vec_id")


def _probe(spark, d, at: int = 3) -> list[float]:
    return list(spark.read.parquet(f"{d}/embeddings.parquet").where(F.col("vec_id") == at).first()["embedding"])


_SCORED = "SELECT e.vec_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4) AS score, e.label FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.round("score", 4).alias("score"))


@_query("vec_exact_topk", f"SELECT vec_id, score FROM ({_SCORED}) ORDER BY score DESC, vec_id LIMIT 10")
def _exact(spark, d):
    return _shown(_vectors(spark, d).similar("embeddings", _probe(spark, d), 10, places=4))


@_query("vec_two_stage", f"SELECT vec_id, score FROM ({_SCORED}) ORDER BY score DESC, vec_id LIMIT 3")
def _two_stage(spark, d):
    return _shown(_vectors(spark, d, "equilibrada").similar("embeddings", _probe(spark, d), 3, places=4))


@_query("vec_filtered", f"SELECT vec_id, score FROM ({_SCORED}) WHERE label = 1 ORDER BY score DESC, vec_id LIMIT 5")
def _filtered(spark, d):
    e = _vectors(spark, d)
    return _shown(e.similar("embeddings", _probe(spark, d), 5, e.find("embeddings").where("label", 1), places=4))


@_query("vec_threshold", f"SELECT vec_id, score FROM (SELECT * FROM ({_SCORED}) ORDER BY score DESC, vec_id LIMIT 20) WHERE score > 0.3")
def _threshold(spark, d):
    return _shown(_vectors(spark, d).similar("embeddings", _probe(spark, d), 20, places=4).where("score > 0.3"))


@_query("hamming_sieve", """SELECT e.vec_id, CAST(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: CASE WHEN (x[1] > 0) <> (x[2] > 0) THEN 1 ELSE 0 END)) AS BIGINT) AS h
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q""")
def _sieve(spark, d):
    import numpy as np

    from ..operators.similarity import hamming

    q = np.array(_probe(spark, d))
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", hamming(F.col("embedding"), q).cast("long").alias("h"))


def _texts(spark, d) -> Engine:
    return Engine(spark, embedder=HashEmbedder(256)).register("documents", spark.read.parquet(f"{d}/documents.parquet")).enable_vectors("documents", auto=("text",), precision="exacta", key="doc_id")


@_query("hash_embed_topk")
def _embed(spark, d):
    return _texts(spark, d).similar("documents", "the licence of the work", 10).select("doc_id", "score")


@_query("sql_order_by_embedding")
def _by_embedding(spark, d):
    return _texts(spark, d).query("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND parecido > 0.05 ORDER BY EMBEDDING <-> 'the licence of the work' LIMIT 7")


@_query("hybrid_rrf")
def _hybrid(spark, d):
    return _texts(spark, d).hybrid("documents", "licensed under", 10).select("doc_id", "puntos", F.concat_ws(",", "en").alias("en"))


@_query("explain_select", "SELECT TRUE AS planned")
def _explain(spark, d):
    said = engine(spark, d).sql("EXPLAIN SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
    return spark.createDataFrame([("PushedFilters" in said["plan"],)], "planned boolean")


# documents under encryption, streams, requests and audits


@_query("sealed_scan", "SELECT id, n_name FROM " + _NATION)
def _sealed(spark, d):
    from ..sources.sealed import seal, unseal

    df = spark.read.parquet(f"{d}/nation.parquet").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("id"), "n_name")
    key = bytes(range(32))
    return unseal(seal(df, "nation", key), "nation", key, "id string, n_name string")


@_query("stream_ingest", "SELECT id, n_name FROM " + _NATION)
def _stream(spark, d):
    from ..streaming.ingest import ingest

    e = Engine(spark, scratch(spark))
    schema = spark.read.parquet(f"{d}/nation.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "nation.parquet").parquet(d)
    stream = stream.select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("id"), "n_name")
    ingest(e, stream, "nation", scratch(spark)).awaitTermination()
    return e.query("SELECT id, n_name FROM nation")


@_query("request_find", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey > 2 ORDER BY n_nationkey LIMIT 4")
def _request(spark, d):
    from ..agents import request

    body = {"accion": "find", "coleccion": "nation", "donde": [["n_regionkey", ">", 2]], "orden": [["n_nationkey"]], "limite": 4, "campos": ["n_nationkey", "n_name"]}
    rows = request(engine(spark, d), body)["result"]
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in rows], "n_nationkey int, n_name string")
