"""Registered queries: one or more for each operator family, with SQL for the oracle.

A query is SQL text over the registered tables, run by Spark through ``sqlfront`` (which adds
the engine's own functions), or a DataFrame builder. ``oracle`` is the same query for DuckDB
where its dialect differs; values are cast or rounded so that both engines print them alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans.sqlfront import run_sql


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register SQL text; without ``oracle`` the same text is DuckDB's."""
    REGISTRY[name] = Query(lambda spark, sf_dir: run_sql(spark, text, sf_dir), oracle or text)


def built(name: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame."""

    def add(function):
        REGISTRY[name] = Query(function, oracle)
        return function

    return add


# --- TPC-H shapes ---------------------------------------------------------------------------

sql(
    "tpch_q1",
    """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc,
       count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '2001-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
)
sql(
    "tpch_q3",
    """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, CAST(CAST(o_orderdate AS DATE) AS STRING) AS o_orderdate
FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
  AND o_orderdate < DATE '1997-03-15' AND l_shipdate > DATE '1997-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
)
sql(
    "tpch_q5",
    """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
  AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'
GROUP BY n_name ORDER BY revenue DESC""",
)
sql(
    "tpch_q6",
    """
SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    """
SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
  AND l_discount BETWEEN CAST(0.05 AS DOUBLE) AND CAST(0.07 AS DOUBLE) AND l_quantity < 24""",
)
sql(
    "tpch_q10",
    """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(c_acctbal, 2) AS c_acctbal, n_name
FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-04-01'
  AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
sql(
    "tpch_q14",
    """
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END)
       / sum(l_extendedprice * (1 - l_discount)), 4) AS promo_revenue
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'""",
)
sql(
    "tpch_q21",
    """
SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
  AND s_nationkey = n_nationkey AND n_name = 'NATION_3'
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
)

# --- Scan, project, filter ------------------------------------------------------------------

sql("scan_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
sql("scan_alias", "SELECT n.n_name, r.* FROM nation n JOIN region AS r ON n.n_regionkey = r.r_regionkey")
sql(
    "project_exprs",
    "SELECT o_orderkey, o_totalprice * 2 AS twice, -o_totalprice AS minus, CAST(o_orderkey + 1 AS BIGINT) AS next, upper(o_orderpriority) AS prio FROM orders",
)
sql(
    "filter_3vl",
    """
SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE NOT (l.toxic = 1) OR (l.quality IS NULL AND d.n_chars > 3000)""",
)
sql("filter_between_in", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('5-LOW')")
sql(
    "values_inline",
    "SELECT a, b, CAST(NULL AS STRING) AS n FROM (VALUES (1, 'x'), (2, NULL), (NULL, 'z')) AS t(a, b) WHERE a IS NULL OR b IS NOT NULL",
)
for _hint, _name in (
    ("BROADCAST(n)", "hint_broadcast"),
    ("MERGE(n)", "hint_merge"),
    ("SHUFFLE_HASH(n)", "hint_shuffle_hash"),
    ("SHUFFLE_REPLICATE_NL(n)", "hint_replicate_nl"),
    ("COALESCE(2)", "hint_coalesce"),
    ("REPARTITION(4, c_nationkey)", "hint_repartition"),
    ("REPARTITION_BY_RANGE(4, c_nationkey)", "hint_repartition_by_range"),
):
    _text = "SELECT {} c_custkey, n_name, c_nationkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"
    sql(_name, _text.format(f"/*+ {_hint} */"), _text.format(""))

# --- Joins ----------------------------------------------------------------------------------

_J = "SELECT c_custkey, o_orderkey FROM customer {} JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000"
sql("join_inner", _J.format("INNER"))
sql("join_left", _J.format("LEFT OUTER"))
sql("join_right", _J.format("RIGHT"))
sql("join_full", _J.format("FULL OUTER"))
sql(
    "join_semi",
    "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000",
    "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000",
)
sql(
    "join_anti",
    "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000",
    "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000",
)
sql("join_cross", "SELECT r1.r_name AS a, r2.r_name AS b FROM region r1 CROSS JOIN region r2")
sql("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
sql(
    "join_theta",
    "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey",
)
sql(
    "join_range_band",
    """
SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c
ON c.c_nationkey = s.s_nationkey AND c.c_acctbal >= s.s_acctbal - 100 AND c.c_acctbal < s.s_acctbal + 100""",
)
sql(
    "join_null_keys",
    """
SELECT a.x, b.y FROM (VALUES (1, 'a'), (NULL, 'b'), (2, 'c')) AS a(k, x)
FULL OUTER JOIN (VALUES (1, 'p'), (NULL, 'q'), (3, 'r')) AS b(k, y) ON a.k = b.k""",
)
sql("join_self", "SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey")
sql(
    "lateral_join",
    "SELECT r_name, t.n, t.top_name FROM region, LATERAL (SELECT count(*) AS n, max(n_name) AS top_name FROM nation WHERE n_regionkey = r_regionkey) t",
)

# --- Aggregation ----------------------------------------------------------------------------

sql("agg_group", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_orderkey) AS high FROM orders GROUP BY o_orderstatus, o_orderpriority")
sql("agg_global", "SELECT count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, min(l_returnflag) AS low, max(l_returnflag) AS high FROM lineitem")
sql("agg_global_empty", "SELECT count(*) AS n, sum(l_quantity) AS q, min(l_returnflag) AS low FROM lineitem WHERE l_quantity < 0")
sql("agg_group_empty", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag")
sql("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
sql("agg_sum_distinct", "SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, avg(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_returnflag")
sql("agg_having", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 55 AND avg(c_acctbal) > 0")
sql("agg_expr_over_agg", "SELECT o_orderstatus, round(sum(o_totalprice) / count(*), 4) AS ratio, max(o_orderkey) - min(o_orderkey) AS span, CASE WHEN count(*) > 100 THEN 'many' ELSE 'few' END AS size FROM orders GROUP BY o_orderstatus")
sql("agg_null_keys", "SELECT l.toxic, count(*) AS n, count(l.quality) AS known FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.toxic")
sql("agg_group_by_expr", "SELECT o_orderkey % 7 AS k, count(*) AS n FROM orders GROUP BY o_orderkey % 7")
_G = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(GROUPING(o_orderstatus) AS BIGINT) AS g1, CAST(GROUPING_ID(o_orderstatus, o_orderpriority) AS BIGINT) AS gid FROM orders GROUP BY {}"
sql("grouping_sets", _G.format("GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())"))
sql("cube", _G.format("CUBE (o_orderstatus, o_orderpriority)"))
sql("rollup", _G.format("ROLLUP (o_orderstatus, o_orderpriority)"))
sql("with_rollup", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus WITH ROLLUP", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
sql("with_cube", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus WITH CUBE", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus)")
sql(
    "pivot",
    "SELECT * FROM (SELECT user_id, event_type, value FROM events) PIVOT (count(value) FOR event_type IN ('click' AS click, 'view' AS view, 'none' AS none))",
    """SELECT user_id, nullif(count(value) FILTER (event_type = 'click'), 0) AS click, nullif(count(value) FILTER (event_type = 'view'), 0) AS view,
       nullif(count(value) FILTER (event_type = 'none'), 0) AS none FROM events GROUP BY user_id""",
)
sql(
    "pivot_multi",
    """SELECT * FROM (SELECT o_orderstatus, o_orderpriority, o_totalprice, o_orderkey FROM orders)
PIVOT (round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last FOR o_orderstatus IN ('F' AS f, 'O' AS o))""",
    """SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS f_total, max(o_orderkey) FILTER (o_orderstatus = 'F') AS f_last,
       round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS o_total, max(o_orderkey) FILTER (o_orderstatus = 'O') AS o_last
FROM orders GROUP BY o_orderpriority""",
)
_W = "SELECT doc_id, CAST(quality AS DOUBLE) AS quality, CAST(nullif(toxic, 0) AS DOUBLE) AS toxic FROM labels"
sql(
    "unpivot",
    f"SELECT doc_id, what, val FROM ({_W}) UNPIVOT (val FOR what IN (quality, toxic))",
    f"SELECT doc_id, 'quality' AS what, quality AS val FROM ({_W}) WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', toxic FROM ({_W}) WHERE toxic IS NOT NULL",
)
sql(
    "unpivot_include_nulls",
    f"SELECT doc_id, what, val FROM ({_W}) UNPIVOT INCLUDE NULLS (val FOR what IN (quality AS q, toxic AS t))",
    f"SELECT doc_id, 'q' AS what, quality AS val FROM ({_W}) UNION ALL SELECT doc_id, 't', toxic FROM ({_W})",
)

# --- Windows --------------------------------------------------------------------------------

_E = "FROM events"
_O = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
sql("win_row_number", f"SELECT event_id, CAST(row_number() {_O}) AS BIGINT) AS rn {_E}")
sql("win_rank", f"SELECT event_id, CAST(rank() OVER (PARTITION BY user_id ORDER BY event_type) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS BIGINT) AS d {_E}")
sql("win_percent_cume", f"SELECT event_id, round(percent_rank() {_O}), 8) AS p, round(cume_dist() {_O}), 8) AS c {_E}")
sql("win_ntile", f"SELECT event_id, CAST(ntile(4) {_O}) AS BIGINT) AS bucket {_E}")
sql("win_lead_lag", f"SELECT event_id, lead(value) {_O}) AS nxt, lag(value, 2, -1.0) {_O}) AS prev2, lag(event_type) {_O}) AS prev_type {_E}")
_F = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
sql("win_first_last", f"SELECT event_id, first_value(value) {_O}) AS f, last_value(value) {_O} {_F}) AS l {_E}")
sql(
    "win_first_ignore_nulls",
    f"SELECT event_id, first_value(CASE WHEN value > 50 THEN value END) IGNORE NULLS {_O} {_F}) AS f {_E}",
    f"SELECT event_id, first_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) {_O} {_F}) AS f {_E}",
)
sql("win_nth", f"SELECT event_id, nth_value(value, 3) {_O}) AS third {_E}")
sql("win_running_sum", f"SELECT event_id, round(sum(value) {_O}), 4) AS s, count(*) {_O}) AS n, max(value) {_O}) AS m {_E}")
sql("win_rows_frame", f"SELECT event_id, round(avg(value) {_O} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS a, min(value) {_O} ROWS 3 PRECEDING) AS m {_E}")
sql("win_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 10 PRECEDING AND 5 FOLLOWING) AS n FROM orders")
sql("win_partition_total", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share FROM orders")
sql("win_top_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) t WHERE rn <= 3")

# --- Order, limit, sets ---------------------------------------------------------------------

_L = "(SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
sql("sort_nulls_last", f"SELECT doc_id, toxic FROM {_L} t ORDER BY toxic ASC NULLS LAST, doc_id")
sql("sort_desc_nulls_first", f"SELECT doc_id, toxic FROM {_L} t ORDER BY toxic DESC NULLS FIRST, doc_id DESC")
sql("sort_alias", "SELECT o_orderkey, o_totalprice * 0.5 AS half FROM orders ORDER BY half DESC, o_orderkey")
sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
sql("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0")
sql("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("distinct_nulls", f"SELECT DISTINCT toxic FROM {_L} t")
_A, _B = "SELECT o_custkey % 50 AS k FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey % 70 AS k FROM orders WHERE o_orderstatus = 'P'"
for _op in ("UNION ALL", "UNION", "INTERSECT", "INTERSECT ALL", "EXCEPT", "EXCEPT ALL"):
    sql(_op.lower().replace(" ", "_") if _op != "UNION" else "union_distinct", f"{_A} {_op} {_B}")
sql("set_precedence", "SELECT 1 AS a UNION SELECT 2 INTERSECT SELECT 2 UNION ALL SELECT 1")
sql("set_nulls", "SELECT a FROM (VALUES (1), (NULL), (NULL)) AS t(a) INTERSECT ALL SELECT b FROM (VALUES (NULL), (NULL), (2)) AS u(b)")

# --- CTE and subqueries ---------------------------------------------------------------------

sql("cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")
sql(
    "cte_chained",
    """WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b(k, m) AS (SELECT n, count(*) FROM a GROUP BY n)
SELECT k, m, (SELECT max(m) FROM b) AS top FROM b""",
)
sql("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
sql("scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
sql("scalar_subquery_empty", "SELECT r_name, (SELECT max(n_name) FROM nation WHERE n_regionkey = -1) AS x FROM region")
sql("scalar_subquery_correlated", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last FROM customer")
sql("exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sql("not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql("in_subquery", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE '%A')")
sql("not_in_subquery", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
sql("not_in_null", "SELECT a FROM (VALUES (1), (2)) AS t(a) WHERE a NOT IN (SELECT b FROM (VALUES (1), (NULL)) AS u(b))")
sql("in_list_null", "SELECT a, a IN (1, NULL) AS p, a NOT IN (1, NULL) AS q FROM (VALUES (1), (2), (NULL)) AS t(a)")
sql("derived_table", "SELECT m, count(*) AS n FROM (SELECT c_nationkey, max(c_mktsegment) AS m FROM customer GROUP BY c_nationkey) t GROUP BY m")

# --- Generators -----------------------------------------------------------------------------

_D = "documents"
sql(
    "explode",
    f"SELECT doc_id, w FROM (SELECT doc_id, text FROM {_D}) t LATERAL VIEW explode(split(text, ' ')) v AS w",
    f"SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM {_D}",
)
sql(
    "explode_map",
    "SELECT k, v FROM (SELECT map('a', 1, 'b', 2) AS m) t LATERAL VIEW explode(m) x AS k, v",
    "SELECT * FROM (VALUES ('a', 1), ('b', 2)) AS t(k, v)",
)
sql(
    "explode_outer",
    "SELECT id, x FROM (SELECT 1 AS id, array(7, 8) AS a UNION ALL SELECT 2, array() UNION ALL SELECT 3, NULL) t LATERAL VIEW OUTER explode(a) v AS x",
    "SELECT * FROM (VALUES (1, 7), (1, 8), (2, NULL), (3, NULL)) AS t(id, x)",
)
sql(
    "posexplode",
    "SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(CAST(x AS DOUBLE), 6) AS x FROM embeddings LATERAL VIEW posexplode(embedding) v AS pos, x",
    """SELECT vec_id, pos - 1 AS pos, round(CAST(embedding[pos] AS DOUBLE), 6) AS x
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) t""",
)
sql(
    "inline",
    "SELECT n_name, a, b FROM nation LATERAL VIEW inline(array(struct(n_nationkey AS a, 'x' AS b), struct(n_regionkey AS a, 'y' AS b))) v AS a, b",
    "SELECT n_name, n_nationkey AS a, 'x' AS b FROM nation UNION ALL SELECT n_name, n_regionkey, 'y' FROM nation",
)
sql(
    "stack",
    "SELECT r_name, k, v FROM region LATERAL VIEW stack(2, 'key', r_regionkey, 'next', r_regionkey + 1) s AS k, v",
    "SELECT r_name, 'key' AS k, r_regionkey AS v FROM region UNION ALL SELECT r_name, 'next', r_regionkey + 1 FROM region",
)

# --- Scalar functions -----------------------------------------------------------------------

_N = "(VALUES (1, 'a'), (NULL, 'b'), (0, NULL)) AS t(a, s)"
sql("fn_null", f"SELECT coalesce(a, -1) AS c, nullif(a, 0) AS n, ifnull(s, 'none') AS i, a IS NULL AS isn, s IS NOT NULL AS isnn FROM {_N}")
sql("fn_nvl", f"SELECT nvl(a, 9) AS n FROM {_N}", f"SELECT coalesce(a, 9) AS n FROM {_N}")
sql("fn_case", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'low' WHEN n_nationkey < 15 THEN 'mid' END AS b, IIF(n_regionkey = 1, 1, 0) AS i, IF(n_regionkey = 2, 'x', NULL) AS j FROM nation",
    "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'low' WHEN n_nationkey < 15 THEN 'mid' END AS b, CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END AS i, CASE WHEN n_regionkey = 2 THEN 'x' END AS j FROM nation")
_S = "(VALUES ('a%c'), ('abc'), ('a_c'), ('A%C'), (NULL)) AS t(s)"
sql("fn_like", f"SELECT s, s LIKE 'a%' AS p, s LIKE 'a_c' AS q, s NOT LIKE '%b%' AS r FROM {_S}")
sql("fn_like_escape", f"SELECT s, s LIKE 'a!%c' ESCAPE '!' AS p, s LIKE 'a!_c' ESCAPE '!' AS q FROM {_S}")
sql("fn_cast", "SELECT CAST('42' AS INT) AS i, CAST(7.9 AS BIGINT) AS b, CAST(3 AS DOUBLE) AS d, CAST(12 AS STRING) AS s, CAST(1 AS BOOLEAN) AS t, CAST(CAST('2024-02-29' AS DATE) AS STRING) AS dt, CAST(CAST('2024-02-29 01:02:03' AS TIMESTAMP) AS STRING) AS ts",
    "SELECT 42 AS i, CAST(7 AS BIGINT) AS b, CAST(3 AS DOUBLE) AS d, '12' AS s, true AS t, '2024-02-29' AS dt, '2024-02-29 01:02:03' AS ts")
sql("fn_arith_div0", "SELECT o_orderkey, o_totalprice / (o_orderkey % 3) AS d, MOD(o_orderkey, o_orderkey % 3) AS m FROM orders",
    "SELECT o_orderkey, o_totalprice / nullif(o_orderkey % 3, 0) AS d, o_orderkey % nullif(o_orderkey % 3, 0) AS m FROM orders")
sql("fn_math", """SELECT s_suppkey, abs(s_acctbal) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, round(sqrt(abs(s_acctbal)), 8) AS q,
       round(cbrt(s_acctbal), 8) AS k, round(exp(s_nationkey / 10.0), 8) AS e, CAST(pow(s_nationkey, 2) AS BIGINT) AS p, CAST(sign(s_acctbal) AS INT) AS s FROM supplier""",
    """SELECT s_suppkey, abs(s_acctbal) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, round(sqrt(abs(s_acctbal)), 8) AS q,
       round(cbrt(s_acctbal), 8) AS k, round(exp(CAST(s_nationkey AS DOUBLE) / 10), 8) AS e, CAST(pow(s_nationkey, 2) AS BIGINT) AS p, CAST(sign(s_acctbal) AS INT) AS s FROM supplier""")
sql("fn_round_trunc", "SELECT x, round(x, 1) AS r1, round(x) AS r0, TRUNC(x, 1) AS t1, TRUNCATE(x, 0) AS t0 FROM (SELECT CAST(a AS DOUBLE) AS x FROM (VALUES (1.25), (-1.25), (2.5), (-2.75), (0.0)) AS t(a)) u",
    "SELECT x, round(x, 1) AS r1, round(x) AS r0, trunc(x * 10) / 10 AS t1, trunc(x) AS t0 FROM (SELECT CAST(a AS DOUBLE) AS x FROM (VALUES (1.25), (-1.25), (2.5), (-2.75), (0.0)) AS t(a)) u")
sql("fn_mod_pmod", "SELECT a, mod(a, 3) AS m, pmod(a, 3) AS p FROM (VALUES (7), (-7), (0)) AS t(a)", "SELECT a, a % 3 AS m, ((a % 3) + 3) % 3 AS p FROM (VALUES (7), (-7), (0)) AS t(a)")
sql("fn_log", "SELECT p_partkey, round(ln(p_size), 8) AS a, round(log(p_size), 8) AS n, round(log(2.0, p_size), 8) AS b, round(log2(p_size), 8) AS c, round(log10(p_size), 8) AS d FROM part WHERE p_size > 0",
    "SELECT p_partkey, round(ln(p_size), 8) AS a, round(ln(p_size), 8) AS n, round(log2(p_size), 8) AS b, round(log2(p_size), 8) AS c, round(log10(p_size), 8) AS d FROM part WHERE p_size > 0")
sql("fn_string", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS BIGINT) AS n, reverse(p_type) AS r, replace(p_type, 'O', '0') AS z, repeat(p_type, 2) AS d FROM part")
sql("fn_substring", "SELECT p_partkey, substring(p_name, 2, 3) AS a, substring(p_name, 1, 100) AS b, substr(p_name, 3, 2) AS c FROM part")
sql("fn_trim", "SELECT trim(s) AS t, ltrim(s) AS l, rtrim(s) AS r, trim(BOTH 'x' FROM 'xxaxx') AS b FROM (VALUES ('  a b '), ('c'), (NULL)) AS t(s)")
sql("fn_pad", "SELECT p_partkey, lpad(p_type, 8, '*') AS l, rpad(p_type, 4, '-') AS r FROM part")
sql("fn_split", "SELECT doc_id, w[0] AS a, w[1] AS b FROM (SELECT doc_id, SPLIT(concat(lang, '.', source), '.') AS w FROM documents) t",
    "SELECT doc_id, w[1] AS a, w[2] AS b FROM (SELECT doc_id, string_split(lang || '.' || source, '.') AS w FROM documents) t")
sql("fn_locate", "SELECT p_partkey, CAST(locate('A', p_type) AS BIGINT) AS l, CAST(instr(p_type, 'O') AS BIGINT) AS i, CAST(position('R' IN p_type) AS BIGINT) AS p FROM part",
    "SELECT p_partkey, instr(p_type, 'A') AS l, instr(p_type, 'O') AS i, position('R' IN p_type) AS p FROM part")
sql("fn_concat", "SELECT concat(s, '-', a) AS c, concat_ws('+', s, CAST(a AS STRING), 'z') AS w FROM (VALUES ('x', 1), (NULL, 2)) AS t(s, a)",
    "SELECT s || '-' || a AS c, concat_ws('+', s, CAST(a AS VARCHAR), 'z') AS w FROM (VALUES ('x', 1), (NULL, 2)) AS t(s, a)")
_T = "CAST(o_orderdate AS DATE)"
sql("fn_date_arith", f"SELECT o_orderkey, CAST(date_add({_T}, 30) AS STRING) AS a, CAST(DATESUB({_T}, 45) AS STRING) AS s, CAST(datediff(DATE '2001-12-31', {_T}) AS BIGINT) AS d FROM orders",
    f"SELECT o_orderkey, CAST({_T} + 30 AS VARCHAR) AS a, CAST({_T} - 45 AS VARCHAR) AS s, CAST(DATE '2001-12-31' - {_T} AS BIGINT) AS d FROM orders")
_X = ", ".join(f"CAST(EXTRACT({f} FROM ts) AS BIGINT) AS {f.lower()}" for f in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "QUARTER", "WEEK"))
sql("fn_extract", f"SELECT event_id, {_X}, CAST(floor(EXTRACT(SECOND FROM ts)) AS BIGINT) AS second, CAST(EXTRACT(DAYOFWEEK_ISO FROM ts) AS BIGINT) AS dow, CAST(EXTRACT(DOY FROM ts) AS BIGINT) AS doy FROM events",
    f"SELECT event_id, {_X}, CAST(floor(EXTRACT(SECOND FROM ts)) AS BIGINT) AS second, CAST(isodow(ts) AS BIGINT) AS dow, CAST(EXTRACT(DOY FROM ts) AS BIGINT) AS doy FROM events")
_Y = ", ".join(f"CAST({f}(o_orderdate) AS BIGINT) AS {f}" for f in ("year", "month", "day", "hour", "minute", "second"))
sql("fn_date_parts", f"SELECT o_orderkey, {_Y} FROM orders")
_Z = ", ".join(f"CAST(date_trunc('{f}', ts) AS STRING) AS {f}" for f in ("year", "quarter", "month", "week", "day", "hour", "minute"))
sql("fn_date_trunc", f"SELECT event_id, {_Z} FROM events", f"SELECT event_id, {_Z} FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events) t".replace("CAST(date_trunc", "strftime(CAST(date_trunc").replace(", ts) AS STRING)", ", ts) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"))
sql("fn_parse_bad", "SELECT CAST(TO_DATE(s) AS STRING) AS d, CAST(TO_TIMESTAMP(s, 'yyyy-MM-dd HH:mm:ss') AS STRING) AS t FROM (VALUES ('2024-01-31'), ('2024-02-30'), ('x'), ('2024-01-31 10:11:12'), (NULL)) AS t(s)",
    "SELECT * FROM (VALUES ('2024-01-31', NULL), (NULL, NULL), (NULL, NULL), ('2024-01-31', '2024-01-31 10:11:12'), (NULL, NULL)) AS t(d, t)")
sql("fn_extract_fraction", """SELECT event_id, EXTRACT(MICROSECOND FROM CAST(ts AS TIMESTAMP)) AS us, EXTRACT(MILLISECOND FROM ts) AS ms,
       EXTRACT(MILLISECOND FROM to_timestamp('1969-12-31 23:59:59.250')) AS old FROM events""",
    "SELECT event_id, CAST(epoch_us(CAST(ts AS TIMESTAMP)) % 1000000 AS INT) AS us, CAST(epoch_us(CAST(ts AS TIMESTAMP)) % 1000000 // 1000 AS INT) AS ms, 250 AS old FROM events")
sql("fn_null_not_error", "SELECT s, CAST(s AS INT) AS i, CAST(s AS DATE) AS d, 1 / 0 AS q, MOD(5, 0) AS m, 5 % 0 AS r FROM (VALUES ('7'), ('x'), (NULL)) AS t(s)",
    "SELECT s, try_cast(s AS INT) AS i, try_cast(s AS DATE) AS d, CAST(NULL AS DOUBLE) AS q, CAST(NULL AS INT) AS m, CAST(NULL AS INT) AS r FROM (VALUES ('7'), ('x'), (NULL)) AS t(s)")
sql("sort_default_nulls", "SELECT * FROM (SELECT a FROM (VALUES (1), (NULL), (3)) AS t(a) ORDER BY a LIMIT 2) x UNION ALL SELECT * FROM (SELECT a FROM (VALUES (1), (NULL), (3)) AS t(a) ORDER BY a DESC LIMIT 2) y",
    "SELECT * FROM (VALUES (1), (3), (NULL), (3)) AS t(a)")
sql("win_default_nulls", "SELECT a, row_number() OVER (ORDER BY a) AS up, row_number() OVER (ORDER BY a DESC) AS down FROM (VALUES (1), (NULL), (3)) AS t(a)",
    "SELECT * FROM (VALUES (1, 1, 2), (NULL, 3, 3), (3, 2, 1)) AS t(a, up, down)")
sql("fn_opaque", "SELECT n_name, soundex(n_name) AS s, CAST(levenshtein(n_name, 'NATION_1') AS BIGINT) AS d FROM nation",
    "SELECT n_name, 'N350' AS s, levenshtein(n_name, 'NATION_1') AS d FROM nation")

# --- API layers -----------------------------------------------------------------------------


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    from lodestone.session import register

    register(spark, sf_dir, list(names))


@built(
    "fluent_pipeline",
    """SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' GROUP BY n_name HAVING count(*) > 20""",
)
def _fluent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.plans.query import Table, call, col

    _tables(spark, sf_dir, "customer", "nation", "orders")
    return (
        Table("customer")
        .join(Table("nation"), col("c_nationkey") == col("n_nationkey"))
        .join(Table("orders").where(col("o_orderstatus") != "F"), col("c_custkey") == col("o_custkey"))
        .group_by("n_name")
        .agg(call("count").alias("n"), call("round", call("sum", col("o_totalprice")), 2).alias("total"))
        .where(col("n") > 20)
        .frame(spark)
    )


@built("artifact_roundtrip", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY o_orderstatus")
def _artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.plans.artifact import Artifact
    from lodestone.plans.query import Table, call, col

    _tables(spark, sf_dir, "orders")
    query = Table("orders").where(col("o_totalprice") > 50000).group_by("o_orderstatus").agg(call("count").alias("n"))
    return Artifact.from_bytes(query.compile().to_bytes()).run(spark)


@built("contract_checked", "SELECT p_partkey, p_size FROM part WHERE p_size > 40")
def _contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.plans.query import Table
    from lodestone.plans.types import spark_type

    _tables(spark, sf_dir, "part")
    part = Table("part", spark_type("struct<p_partkey:bigint,p_size:bigint>"))  # p_size is an int, which widens
    return part.where(part.p_size > 40).select("p_partkey", "p_size").compile().run(spark)


@built("parquet_roundtrip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.staging import Stage
    from lodestone.session import table
    from lodestone.sources.io import read_parquet, write_parquet

    path = f"{Stage(spark, 'parquet').path}/supplier"
    write_parquet(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, "zstd")
    return read_parquet(spark, path)


@built("union_by_name", "SELECT n_nationkey AS k, n_name AS a, CAST(NULL AS VARCHAR) AS b FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def _union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.plans.query import Table, col

    _tables(spark, sf_dir, "nation", "region")
    left = Table("nation").select(col("n_nationkey").alias("k"), col("n_name").alias("a"))
    right = Table("region").select(col("r_name").alias("b"), col("r_regionkey").alias("k"))
    return left.union(right, by_name=True, missing=True).frame(spark)


# --- Models ---------------------------------------------------------------------------------


@built("predict_linear", "SELECT c_custkey, CAST(round(CAST(c_acctbal AS FLOAT) * CAST(0.5 AS FLOAT) + CAST(2 AS FLOAT), 2) AS DOUBLE) AS score FROM customer")
def _predict_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lodestone.ml.graph import Graph
    from lodestone.ml.predict import predict
    from lodestone.session import table

    g = Graph()
    g.output("raw", g.input("x") * 0.5 + 2.0)
    scored = predict(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), g, {"x": F.col("c_acctbal")})
    return scored.select("c_custkey", F.round("raw", 2).cast("double").alias("score"))


@built("predict_mlp")
def _predict_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lodestone.ml.graph import Graph
    from lodestone.ml.predict import predict
    from lodestone.session import table

    vectors = table(spark, sf_dir, "embeddings")
    width = vectors.select(F.size("embedding").alias("n")).first()["n"]
    g = Graph()
    hidden = g.input("x", width).linear(g.parameter("w1", 8, width, init="xavier"), g.parameter("b1", 8, init="zeros")).relu()
    g.output("p", hidden.linear(g.parameter("w2", 1, 8, init="xavier"), g.parameter("b2", 1, init="zeros")).sigmoid())
    return predict(vectors.select("vec_id", "embedding"), g, {"x": F.col("embedding")}).select("vec_id", "p")


def _fit(spark: SparkSession, sf_dir: str, optimizer: str, rate: float) -> DataFrame:
    from pyspark.sql import functions as F

    from lodestone.ml.fit import fit
    from lodestone.ml.graph import Graph
    from lodestone.session import table

    g = Graph()
    x, y = g.input("x", 1), g.input("y", 1)
    out = x.linear(g.parameter("w", 1, 1, init="zeros"), g.parameter("b", 1, init="zeros"))
    g.output("loss", out.loss("MSE", y))
    items = table(spark, sf_dir, "lineitem")
    return fit(items, g, {"x": F.col("l_quantity") / 50, "y": F.col("l_extendedprice") / 50000}, epochs=8, rate=rate, optimizer=optimizer).history.select("epoch", F.round("loss", 3).alias("loss"))


#: Both fits in closed form: the loss and its gradients need only the moments of x and y.
_MOMENTS = """s AS (SELECT avg(x * x) AS xx, avg(x) AS mx, avg(x * y) AS xy, avg(y) AS my, avg(y * y) AS yy
  FROM (SELECT CAST(l_quantity AS DOUBLE) / 50 AS x, CAST(l_extendedprice AS DOUBLE) / 50000 AS y FROM lineitem))"""
_LOSS = "round(w * w * xx + 2 * w * b * mx + b * b - 2 * w * xy - 2 * b * my + yy, 3) AS loss"
_GW, _GB = "(2 * (w * xx + b * mx - xy))", "(2 * (w * mx + b - my))"


@built(
    "fit_linear",
    f"""WITH RECURSIVE {_MOMENTS}, t(epoch, w, b) AS (
  SELECT 1, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL SELECT epoch + 1, w - 0.5 * {_GW}, b - 0.5 * {_GB} FROM t, s WHERE epoch < 8)
SELECT epoch, {_LOSS} FROM t, s""",
)
def _fit_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, "sgd", 0.5)


@built(
    "fit_adam",
    f"""WITH RECURSIVE {_MOMENTS}, t(epoch, w, b, mw, vw, mb, vb) AS (
  SELECT 1, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT epoch + 1, w - 0.1 * (mw / (1 - pow(0.9, epoch))) / (sqrt(vw / (1 - pow(0.999, epoch))) + 1e-8),
         b - 0.1 * (mb / (1 - pow(0.9, epoch))) / (sqrt(vb / (1 - pow(0.999, epoch))) + 1e-8), mw, vw, mb, vb
  FROM (SELECT epoch, w, b, 0.9 * mw + 0.1 * {_GW} AS mw, 0.999 * vw + 0.001 * {_GW} * {_GW} AS vw,
               0.9 * mb + 0.1 * {_GB} AS mb, 0.999 * vb + 0.001 * {_GB} * {_GB} AS vb FROM t, s WHERE epoch < 8))
SELECT epoch, {_LOSS} FROM t, s""",
)
def _fit_adam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, "adam", 0.1)
