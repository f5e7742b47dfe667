"""Query plans as plain data, built into DataFrames.

``frame`` declares a plan with the DataFrame API and leaves the rest to Catalyst: it builds no
physical plan and runs no job, but for ``fit``, which trains, and ``recursive``, which steps until no rows are new.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import relational
from lodestone.operators.staging import Stage
from lodestone.plans.expr import Expr, column, name_of
from lodestone.plans.types import spark_type


@dataclass(frozen=True)
class Plan:
    op: str
    children: tuple[Plan, ...] = ()
    props: tuple[tuple[str, Any], ...] = ()

    def get(self, name: str, default: Any = None) -> Any:
        return dict(self.props).get(name, default)


NODES = (
    "relation values project filter aggregate sort limit distinct alias join union intersect except window "
    "with recursive pivot unpivot lateral_join generate hint predict fit"
).split()


def node(op: str, *children: Plan, **props: Any) -> Plan:
    if op not in NODES:
        raise ValueError(f"unknown plan node {op}")
    return Plan(op, children, tuple(props.items()))


class Builder:
    """Builds one plan; ``tables`` overrides the session's tables by name."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.tables = {k.lower(): v for k, v in (tables or {}).items()}

    def frame(self, plan: Plan) -> DataFrame:
        return getattr(self, f"_{plan.op}")(plan, *plan.children)

    def _columns(self, exprs: list[Expr], df: DataFrame) -> list:
        return [column(e, self.frame, lambda: df.columns) for e in exprs]

    def _relation(self, p: Plan) -> DataFrame:
        found = self.tables.get(p.get("name").lower())
        df = self.spark.table(p.get("name")) if found is None else found
        return df.alias(p.get("alias") or p.get("name"))

    def _values(self, p: Plan) -> DataFrame:
        schema = T.StructType([T.StructField(n, spark_type(t), True) for n, t in p.get("fields")])
        return self.spark.createDataFrame([tuple(r) for r in p.get("rows")], schema)

    def _project(self, p: Plan, child: Plan) -> DataFrame:
        df = self.frame(child)
        out: list = []
        for e in p.get("exprs"):
            if e.op == "star":
                out.append(F.col(f"{e.get('of')}.*" if e.get("of") else "*"))
            else:
                out += self._columns([e], df)
        return df.select(*out)

    def _filter(self, p: Plan, child: Plan) -> DataFrame:
        df = self.frame(child)
        return df.where(self._columns([p.get("condition")], df)[0])

    def _aggregate(self, p: Plan, child: Plan) -> DataFrame:
        df = self.frame(child)
        keys, aggs = self._columns(p.get("keys"), df), self._columns(p.get("aggs"), df)
        return relational.aggregate(df, keys, aggs, p.get("sets"))

    def _sort(self, p: Plan, child: Plan) -> DataFrame:
        df = self.frame(child)
        return df.orderBy(*self._columns([e if e.op == "order" else e.asc() for e in p.get("orders")], df))

    def _limit(self, p: Plan, child: Plan) -> DataFrame:
        return self.frame(child).limit(p.get("n"))

    def _distinct(self, p: Plan, child: Plan) -> DataFrame:
        return self.frame(child).distinct()

    def _alias(self, p: Plan, child: Plan) -> DataFrame:
        return self.frame(child).alias(p.get("name"))

    def _join(self, p: Plan, left: Plan, right: Plan) -> DataFrame:
        a, b = self.frame(left), self.frame(right)
        if p.get("how") == "cross" or p.get("condition") is None:
            return a.crossJoin(b)
        return a.join(b, column(p.get("condition"), self.frame), p.get("how"))

    def _union(self, p: Plan, *arms: Plan) -> DataFrame:
        return relational.union([self.frame(a) for a in arms], p.get("by_name"), p.get("missing", False), p.get("distinct"))

    def _intersect(self, p: Plan, left: Plan, right: Plan) -> DataFrame:
        a, b = self.frame(left), self.frame(right)
        return a.intersectAll(b) if p.get("all") else a.intersect(b)

    def _except(self, p: Plan, left: Plan, right: Plan) -> DataFrame:
        a, b = self.frame(left), self.frame(right)
        return a.exceptAll(b) if p.get("all") else a.subtract(b)

    def _window(self, p: Plan, child: Plan) -> DataFrame:
        df = self.frame(child)
        return df.select("*", *self._columns(p.get("exprs"), df))

    def _with(self, p: Plan, *plans: Plan) -> DataFrame:
        """Common tables in order, then the query."""
        inner = Builder(self.spark, self.tables)
        for name, definition in zip(p.get("names"), plans):
            inner.tables[name.lower()] = inner.frame(definition)
        return inner.frame(plans[-1])

    def _recursive(self, p: Plan, start: Plan, step: Plan, query: Plan) -> DataFrame:
        """The start's rows, then the step's on the rows of the round before, until a round has none.

        Rounds are written tables. ``distinct`` drops rows that are there already. Columns have the
        start's names and types.
        """
        stage, name = Stage(self.spark, "recursive"), p.get("name").lower()
        first = self.frame(start)
        now = stage.write(first.distinct() if p.get("distinct") else first)
        rounds, kinds = [now], now.schema
        while not now.isEmpty():
            if len(rounds) > p.get("most"):
                raise RecursionError(f"{p.get('name')}: rows after {p.get('most')} rounds")
            got = Builder(self.spark, {**self.tables, name: now}).frame(step)
            got = got.toDF(*kinds.names).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in kinds])
            now = stage.write(got.subtract(relational.union(rounds, False, False, False)) if p.get("distinct") else got)
            rounds.append(now)
        return Builder(self.spark, {**self.tables, name: relational.union(rounds, False, False, False)}).frame(query)

    def _pivot(self, p: Plan, child: Plan) -> DataFrame:
        df = self.frame(child)
        keys, aggs = self._columns(p.get("keys"), df), self._columns(p.get("aggs"), df)
        return relational.pivot(df, keys, p.get("on"), list(p.get("values")), aggs)

    def _unpivot(self, p: Plan, child: Plan) -> DataFrame:
        return relational.unpivot(self.frame(child), [tuple(x) for x in p.get("columns")], p.get("name"), p.get("value"), p.get("nulls"))

    def _lateral_join(self, p: Plan, left: Plan, right: Plan) -> DataFrame:
        """The right side sees the left's columns as ``outer`` ones."""
        a, b = self.frame(left), self.frame(right)
        condition = p.get("condition")
        return a.lateralJoin(b, column(condition, self.frame) if condition is not None else None, p.get("how", "inner"))

    def _generate(self, p: Plan, child: Plan) -> DataFrame:
        df = self.frame(child)
        e: Expr = p.get("generator")
        return relational.generate(df, e.op, self._columns(list(e.args), df), list(p.get("names")), p.get("outer"))

    def _hint(self, p: Plan, child: Plan) -> DataFrame:
        return relational.hint(self.frame(child), p.get("name"), *p.get("args", ()))

    def _predict(self, p: Plan, child: Plan) -> DataFrame:
        from lodestone.ml.predict import predict

        df = self.frame(child)
        inputs = {name: self._columns([e], df)[0] for name, e in p.get("inputs")}
        return predict(df, p.get("graph"), inputs)

    def _fit(self, p: Plan, child: Plan) -> DataFrame:
        from lodestone.ml.fit import fit

        df = self.frame(child)
        inputs = {name: self._columns([e], df)[0] for name, e in p.get("inputs")}
        return fit(df, p.get("graph"), inputs, **dict(p.get("options", ()))).history


def frame(spark: SparkSession, plan: Plan, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    return Builder(spark, tables).frame(plan)


def visit(plan: Plan, f: Callable[[Plan], None]) -> None:
    """Call ``f`` on a plan, those below it and those in its subqueries."""
    f(plan)
    for child in plan.children:
        visit(child, f)

    def inside(value: Any) -> None:
        if isinstance(value, Plan):
            visit(value, f)
        elif isinstance(value, Expr):
            for x in (*value.args, *(v for _, v in value.props)):
                inside(x)
        elif isinstance(value, (list, tuple)):
            for x in value:
                inside(x)

    for _, value in plan.props:
        inside(value)


def output_names(exprs: list[Expr]) -> list[str | None]:
    return [name_of(e) for e in exprs]
