"""Plans, the fluent API, artifacts, contracts and the second engine."""

import datetime

import duckdb
import pytest

from lodestone.plans.artifact import Artifact, compatible, plan_hash
from lodestone.plans.contracts import Contract, ContractError, Field, fingerprint, validate
from lodestone.plans.expr import KINDS
from lodestone.plans.plan import NODES
from lodestone.plans.query import Table, call, col, exists, lit, opaque, outer, scalar, star, values, when, with_recursive, with_tables
from lodestone.plans.sqlfront import respell, run_sql
from lodestone.plans.transpile import NotTranspilable, transpile
from lodestone.plans.types import literal_decimal, spark_type, sum_type, type_name
from lodestone.session import TABLES, register

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    register(spark, SF)
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


orders, customer, nation, lineitem = Table("orders"), Table("customer"), Table("nation"), Table("lineitem")
agg = lambda name, e: e.alias(name)

BOTH = {
    "project": orders.select("o_orderkey", (col("o_totalprice") / (col("o_orderkey") % 3)).alias("d"), (-col("o_orderkey")).alias("n")),
    "filter": orders.where((col("o_orderstatus") == "F") & ~col("o_orderpriority").like("1%") | col("o_totalprice").between(1e4, 2e4)).select("o_orderkey"),
    "in": orders.where(col("o_orderstatus").isin("F", "P")).select("o_orderkey"),
    "star": nation.select(star(), lit(1).alias("one")),
    "aggregate": orders.group_by("o_orderstatus").agg(call("count").alias("n"), call("count", col("o_custkey"), distinct=True).alias("c"), call("max", col("o_orderkey")).alias("m")),
    "having": orders.group_by("o_custkey").agg(call("count").alias("n")).where(col("n") > 12),
    "global": orders.where(col("o_orderkey") < 0).agg(call("count").alias("n"), call("min", col("o_orderstatus")).alias("m")),
    "rollup": orders.rollup("o_orderstatus", "o_orderpriority").agg(call("count").alias("n"), call("grouping", col("o_orderstatus")).cast("bigint").alias("g")),
    "cube": orders.cube("o_orderstatus", "o_orderpriority").agg(call("count").alias("n")),
    "sets": orders.grouping_sets([[0], [1], []], "o_orderstatus", "o_orderpriority").agg(call("count").alias("n")),
    "sort": customer.order_by(col("c_acctbal").desc(), col("c_custkey").asc()).limit(7).select("c_custkey"),
    "distinct": orders.select("o_orderstatus").distinct(),
    "join": customer.join(nation, col("c_nationkey") == col("n_nationkey")).select("c_custkey", "n_name"),
    "left": customer.left_join(orders, (col("c_custkey") == col("o_custkey")) & (col("o_totalprice") > 1e5)).select("c_custkey", "o_orderkey"),
    "full": customer.full_join(orders, (col("c_custkey") == col("o_custkey")) & (col("o_totalprice") > 1e5)).select("c_custkey", "o_orderkey"),
    "semi": customer.semi_join(orders, col("c_custkey") == col("o_custkey")).select("c_custkey"),
    "anti": customer.anti_join(orders, col("c_custkey") == col("o_custkey")).select("c_custkey"),
    "cross": Table("region", alias="a").cross_join(Table("region", alias="b")).select(col("a.r_name").alias("x"), col("b.r_name").alias("y")),
    "union": orders.select("o_orderstatus").union(customer.select("c_mktsegment"), distinct=True),
    "intersect_all": orders.select(col("o_custkey") % 5).intersect(customer.select(col("c_custkey") % 7), all=True).select(star()),
    "except_all": orders.select((col("o_custkey") % 5).alias("k")).except_(customer.select((col("c_custkey") % 7).alias("k")), all=True),
    "window": orders.with_windows(
        call("row_number").over([col("o_custkey")], [col("o_orderkey")]).alias("rn"),
        call("sum", col("o_orderkey")).over([col("o_custkey")], [col("o_orderkey")], ("rows", -1, 1)).cast("bigint").alias("s"),
        call("lag", col("o_orderkey"), offset=2).over([col("o_custkey")], [col("o_orderkey")]).alias("p"),
    ).select("o_orderkey", "rn", "s", "p"),
    "case": nation.select("n_name", when(col("n_nationkey") < 5, "a").when(col("n_nationkey") < 9, "b").otherwise("c").alias("k"), when(col("n_nationkey") > 20, 1).end().alias("e")),
    "functions": customer.select(
        "c_custkey",
        call("upper", col("c_name")).alias("u"),
        call("concat", col("c_name"), lit("-"), col("c_mktsegment")).alias("c"),
        call("lpad", col("c_mktsegment"), 4, lit("*")).alias("l"),
        call("truncate", col("c_acctbal"), 1).alias("t"),
        call("position", lit("I"), col("c_mktsegment")).cast("bigint").alias("p"),
        call("pmod", -col("c_custkey"), 7).alias("m"),
        call("round", call("log", 2.0, (col("c_custkey") + 1).cast("double")), 6).alias("g"),
    ),
    "dates": orders.select(
        "o_orderkey",
        call("date_add", col("o_orderdate").cast("date"), 3).cast("string").alias("a"),
        call("extract", col("o_orderdate"), field="DOW").cast("bigint").alias("d"),
        call("extract", col("o_orderdate"), field="WEEK").cast("bigint").alias("w"),
        call("year", col("o_orderdate")).cast("bigint").alias("y"),
    ),
    "scalar": customer.where(col("c_acctbal") > scalar(customer.agg(call("avg", col("c_acctbal")).alias("m")))).select("c_custkey"),
    "exists": customer.where(exists(orders.where(col("o_custkey") == outer("c_custkey")).where(col("o_orderstatus") == "P"))).select("c_custkey"),
    "in_subquery": nation.where(col("n_nationkey").isin(Table("supplier").select("s_nationkey"))).select("n_name"),
    "not_in_nulls": values([(1,), (2,)], a="int").where(~col("a").isin(values([(1,), (None,)], b="int"))),
    "values": values([(1, "x", 1.5), (None, "y", None)], a="int", b="string", c="double").where(col("a").is_null()),
    "with": with_tables(Table("big").group_by("o_custkey").agg(call("count").alias("n")), big=orders.where(col("o_totalprice") > 1e5)),
    "recursive": with_recursive(
        Table("t").where(col("n") % 2 == 0),
        "t",
        values([(1, 1)], n="int", f="bigint"),
        Table("t").where(col("n") < 8).select((col("n") + 1).alias("n"), (col("f") * (col("n") + 1)).alias("f")),
    ),
    "recursive_distinct": with_recursive(Table("t"), "t", nation.select((col("n_nationkey") % 4).alias("k")), Table("t").select(((col("k") * 3 + 1) % 11).alias("k")), distinct=True),
    "opaque": nation.select("n_name", opaque("levenshtein", col("n_name"), lit("NATION")).cast("bigint").alias("d")),
    "hint": customer.join(nation.hint("broadcast"), col("c_nationkey") == col("n_nationkey")).select("c_custkey"),
}


@pytest.mark.parametrize("name", sorted(BOTH))
def test_both_engines_agree(spark, tables, name):
    query = BOTH[name]
    got = query.frame(spark)
    want = tables.execute(transpile(query.plan))
    have, data = rows(got.columns, got.collect())
    assert data == rows([d[0] for d in want.description], want.fetchall())[1]
    again = Artifact.from_bytes(query.compile().to_bytes())
    assert plan_hash(again.plan) == plan_hash(query.plan)
    assert rows(got.columns, again.run(spark).collect())[1] == data


def test_nodes_without_sql_form(spark, tables):
    q = values([("NYC", "Q1", 100), ("NYC", "Q2", 200), ("SF", "Q1", 300), ("SF", "Q2", 400)], city="string", quarter="string", revenue="int")
    wide = q.pivot(["city"], "quarter", ["Q1", "Q2", "Q3"], call("sum", col("revenue")))
    assert sorted(map(tuple, wide.frame(spark).collect())) == [("NYC", 100, 200, None), ("SF", 300, 400, None)]
    long = wide.unpivot([("Q1", "first"), "Q2", "Q3"], "q", "v")
    assert sorted(map(tuple, long.frame(spark).collect())) == [("NYC", "Q2", 200), ("NYC", "first", 100), ("SF", "Q2", 400), ("SF", "first", 300)]
    assert wide.unpivot(["Q1", "Q2", "Q3"], "q", "v", nulls=True).frame(spark).count() == 6
    made = values([(1, "a b"), (2, None)], id="int", t="string").generate(call("explode", call("split", col("t"), lit(" "))), "w", outer=True)
    assert sorted(map(str, (r["w"] for r in made.frame(spark).collect()))) == ["None", "a", "b"]
    side = Table("region").lateral_join(nation.where(col("n_regionkey") == outer("r_regionkey")).agg(call("count").alias("n")))
    assert sum(r["n"] for r in side.frame(spark).collect()) == 25
    for query in (wide, long, made, side):
        with pytest.raises(NotTranspilable):
            transpile(query.plan)
        assert Artifact.from_bytes(query.compile().to_bytes()).run(spark).count() == query.frame(spark).count()


def test_recursion_has_a_bound(spark):
    endless = with_recursive(Table("t"), "t", values([(1,)], n="int"), Table("t").select("n"), most=3)
    with pytest.raises(RecursionError):
        endless.frame(spark)
    assert with_recursive(Table("t"), "t", values([], n="int"), Table("t").select("n")).frame(spark).count() == 0


class User:
    name: str
    age: int
    salary: float | None


def test_contracts(spark):
    spark.createDataFrame([("Alice", 30, 80000.0)], "name string, age int, salary double").createOrReplaceTempView("users")
    users = Table("users", User)
    artifact = users.where(users.age > 20).select("name").compile()
    assert artifact.contracts[0].relation == "users"
    assert [r["name"] for r in artifact.run(spark).collect()] == ["Alice"]  # int widens to bigint
    with pytest.raises(ContractError):
        artifact.run(spark, strict=True)
    wrong = Table("users", spark_type("struct<name:string,nickname:string,age:date>")).select("name").compile()
    problems = {(v.problem, v.detail.split(":")[0]) for v in validate(spark, list(wrong.contracts))}
    assert problems == {("field missing", "nickname"), ("type", "age")}
    assert [v.problem for v in validate(spark, list(Table("nowhere_at_all", User).compile().contracts))] == ["table missing"]


def test_fingerprint():
    a, b = Field("a", "int", False), Field("b", "string")
    assert fingerprint((a, b)) == fingerprint((b, a))
    others = [(a,), (Field("a", "int"), b), (Field("a", "bigint", False), b), (Field("x", "int", False), b), (a, Field("b", "string", True, "m"))]
    assert len({fingerprint(x) for x in others} | {fingerprint((a, b))}) == 6
    schema = spark_type("struct<a:int,b:string>")
    assert Contract.of("r", schema).schema == schema


def test_artifact_container():
    data = orders.select("o_orderkey").compile().to_bytes()
    assert data[:5] == b"LODE\x01" and Artifact.inspect(data)["version"] == [1, 0, 0]
    assert compatible((1, 2, 0), (1, 1, 9)) and not compatible((1, 0, 0), (1, 1, 0)) and not compatible((2, 0, 0), (1, 0, 0))
    for bad in (b"XXXX" + data[4:], data[:4] + b"\x09" + data[5:], data.replace(b"o_orderkey", b"o_orderkez")):
        with pytest.raises(ValueError):
            Artifact.from_bytes(bad)
    when_ = datetime.datetime(2024, 1, 2, 3, 4, 5)
    kept = Artifact.from_bytes(values([(1,)], a="int").select(lit(when_).alias("t"), lit(b"\x00\xff").alias("b")).compile().to_bytes())
    assert [e.args[0].get("value") for e in kept.plan.get("exprs")] == [when_, b"\x00\xff"]


def test_types(spark):
    for name in "boolean tinyint smallint int bigint float double string binary date timestamp timestamp_ntz void variant interval".split():
        assert type_name(spark_type(name)) == name
    for name in ("decimal(10,2)", "array<int>", "map<string,double>", "struct<a:int,b:array<string>>", "interval day to second", "interval year to month", "time(6)", "char(3)", "varchar(9)"):
        assert type_name(spark_type(name)) == name
    assert literal_decimal("12.340").simpleString() == "decimal(5,3)" and literal_decimal("0.05").simpleString() == "decimal(3,2)"
    union = sum_type({"circle": "struct<r:double>", "square": "struct<a:double>"})
    df = spark.createDataFrame([("circle", (1.0,), None), ("square", None, (2.0,))], union)
    assert df.where("kind = 'square'").select("square.a").first()[0] == 2.0


def test_sql_spellings(spark):
    assert respell("SELECT IIF(a, 'IIF(x)', 1) -- IIF(\n, DATESUB(d, 1)") == "SELECT IF(a, 'IIF(x)', 1) -- IIF(\n, date_sub(d, 1)"
    row = run_sql(
        spark,
        "SELECT SAFE_DIVIDE(1, 0) AS d, SAFE_MOD(5, 0) AS m, TRUNCATE(-1.29, 1) AS t, SPLIT_LITERAL('a.b.', '.') AS s, PARSE_DATE('2024-02-30') AS p, "
        "EXTRACT(MICROSECOND FROM TIMESTAMP '2024-01-01 00:00:01.5') AS u",
    ).first()
    assert tuple(row) == (None, None, -1.2, ["a", "b", ""], None, 500000)


def test_inventory():
    assert len(NODES) == 23
    assert len(KINDS) >= 90
