"""The fluent API: tables with a schema, queries that grow step by step, and compiled artifacts."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestone.plans.artifact import Artifact
from lodestone.plans.contracts import Contract
from lodestone.plans.expr import Expr, call, col, lit, opaque, ordinal, when, wrap
from lodestone.plans.plan import Plan, frame, node, visit
from lodestone.sources.encoders import schema_of

__all__ = ["Query", "Table", "call", "col", "exists", "lit", "opaque", "ordinal", "outer", "scalar", "star", "values", "when", "with_recursive", "with_tables"]


def star(of: str | None = None) -> Expr:
    return Expr("star", (), (("of", of),))


def exists(query: Query) -> Expr:
    return Expr("exists", (), (("plan", query.plan),))


def scalar(query: Query) -> Expr:
    return Expr("scalar_subquery", (), (("plan", query.plan),))


def outer(name: str) -> Expr:
    """A column of the query around a subquery."""
    return Expr("outer", (), (("name", name),))


class Query:
    def __init__(self, plan: Plan, contracts: tuple[Contract, ...] = ()):
        self.plan, self.contracts = plan, contracts

    def _next(self, op: str, *others: Query, **props: Any) -> Query:
        contracts = {c.relation: c for q in (self, *others) for c in q.contracts}
        return Query(node(op, self.plan, *(o.plan for o in others), **props), tuple(contracts.values()))

    def where(self, condition: Expr) -> Query:
        found: list[Contract] = []
        visit(Plan("filter", (), (("condition", condition),)), lambda p: found.extend(p.get("contract") or ()))
        return self._next("filter", condition=condition)

    filter = where

    def select(self, *exprs: Any) -> Query:
        return self._next("project", exprs=[col(e) if isinstance(e, str) else wrap(e) for e in exprs])

    def order_by(self, *orders: Expr) -> Query:
        return self._next("sort", orders=list(orders))

    def limit(self, n: int) -> Query:
        return self._next("limit", n=n)

    def distinct(self) -> Query:
        return self._next("distinct")

    def alias(self, name: str) -> Query:
        return self._next("alias", name=name)

    def hint(self, name: str, *args: Any) -> Query:
        return self._next("hint", name=name, args=list(args))

    def group_by(self, *keys: Any, sets: Any = None) -> Grouped:
        return Grouped(self, [col(k) if isinstance(k, str) else k for k in keys], sets)

    def rollup(self, *keys: Any) -> Grouped:
        return self.group_by(*keys, sets="rollup")

    def cube(self, *keys: Any) -> Grouped:
        return self.group_by(*keys, sets="cube")

    def grouping_sets(self, sets: list[list[int]], *keys: Any) -> Grouped:
        return self.group_by(*keys, sets=sets)

    def agg(self, *aggs: Expr) -> Query:
        return self.group_by().agg(*aggs)

    def join(self, other: Query, on: Expr | None = None, how: str = "inner") -> Query:
        return self._next("join", other, condition=on, how=how)

    def left_join(self, other: Query, on: Expr) -> Query:
        return self.join(other, on, "left")

    def right_join(self, other: Query, on: Expr) -> Query:
        return self.join(other, on, "right")

    def full_join(self, other: Query, on: Expr) -> Query:
        return self.join(other, on, "full")

    def semi_join(self, other: Query, on: Expr) -> Query:
        return self.join(other, on, "left_semi")

    def anti_join(self, other: Query, on: Expr) -> Query:
        return self.join(other, on, "left_anti")

    def cross_join(self, other: Query) -> Query:
        return self.join(other, None, "cross")

    def lateral_join(self, other: Query, on: Expr | None = None, how: str = "inner") -> Query:
        return self._next("lateral_join", other, condition=on, how=how)

    def union(self, *others: Query, distinct: bool = False, by_name: bool = False, missing: bool = False) -> Query:
        return self._next("union", *others, distinct=distinct, by_name=by_name, missing=missing)

    def intersect(self, other: Query, all: bool = False) -> Query:
        return self._next("intersect", other, all=all)

    def except_(self, other: Query, all: bool = False) -> Query:
        return self._next("except", other, all=all)

    def with_windows(self, *exprs: Expr) -> Query:
        return self._next("window", exprs=list(exprs))

    def pivot(self, keys: list[Any], on: str, values: list[Any], *aggs: Expr) -> Query:
        return self._next("pivot", keys=[col(k) if isinstance(k, str) else k for k in keys], on=on, values=values, aggs=list(aggs))

    def unpivot(self, columns: list, name: str, value: str, nulls: bool = False) -> Query:
        pairs = [(c, c) if isinstance(c, str) else tuple(c) for c in columns]
        return self._next("unpivot", columns=pairs, name=name, value=value, nulls=nulls)

    def generate(self, generator: Expr, *names: str, outer: bool = False) -> Query:
        return self._next("generate", generator=generator, names=list(names), outer=outer)

    def predict(self, graph: Any, **inputs: Expr) -> Query:
        return self._next("predict", graph=graph, inputs=list(inputs.items()))

    def fit(self, graph: Any, inputs: dict[str, Expr], **options: Any) -> Query:
        return self._next("fit", graph=graph, inputs=list(inputs.items()), options=list(options.items()))

    def compile(self) -> Artifact:
        return Artifact(self.plan, self.contracts)

    def frame(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        return frame(spark, self.plan, tables)


class Grouped:
    def __init__(self, query: Query, keys: list[Expr], sets: Any):
        self.query, self.keys, self.sets = query, keys, sets

    def agg(self, *aggs: Expr) -> Query:
        return self.query._next("aggregate", keys=self.keys, aggs=list(aggs), sets=self.sets)


class Table(Query):
    """A named relation. ``schema``: a StructType, or a class with annotated fields; it becomes a contract."""

    def __init__(self, name: str, schema: Any = None, alias: str | None = None):
        if schema is not None and not isinstance(schema, T.StructType):
            schema = schema_of(schema)
        contracts = (Contract.of(name, schema),) if schema is not None else ()
        super().__init__(node("relation", name=name, alias=alias), contracts)
        self.schema = schema

    def __getattr__(self, name: str) -> Expr:
        schema = self.__dict__.get("schema")
        if name.startswith("__") or schema is None or name not in schema.fieldNames():
            raise AttributeError(name)
        return col(name)


def values(rows: list[tuple], **fields: str) -> Query:
    return Query(node("values", rows=[list(r) for r in rows], fields=list(fields.items())))


def with_tables(query: Query, **tables: Query) -> Query:
    contracts = {c.relation: c for q in (query, *tables.values()) for c in q.contracts if c.relation not in tables}
    return Query(node("with", *(t.plan for t in tables.values()), query.plan, names=list(tables)), tuple(contracts.values()))


def with_recursive(query: Query, name: str, start: Query, step: Query, distinct: bool = False, most: int = 100) -> Query:
    """``query`` over a table that starts with ``start`` and grows by ``step``, which sees the last round's rows under ``name``."""
    contracts = {c.relation: c for q in (query, start, step) for c in q.contracts if c.relation != name}
    return Query(node("recursive", start.plan, step.plan, query.plan, name=name, distinct=distinct, most=most), tuple(contracts.values()))
