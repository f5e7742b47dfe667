"""Expressions as plain data, built into Spark columns.

An expression is an operation name, argument expressions and named properties, all of which
JSON can hold. ``column`` gives the Spark column with the engine's rules: division and modulo
by zero and text that is no date give NULL, orders say where NULLs go, LIKE and SPLIT honour
escape and limit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lodestone.functions import scalar
from lodestone.plans.types import spark_type


@dataclass(frozen=True)
class Expr:
    op: str
    args: tuple[Expr, ...] = ()
    props: tuple[tuple[str, Any], ...] = ()

    def get(self, name: str, default: Any = None) -> Any:
        return dict(self.props).get(name, default)

    # Operators of the fluent API.
    def _two(self, op: str, other: Any, flip: bool = False) -> Expr:
        pair = (self, wrap(other))
        return Expr(op, pair[::-1] if flip else pair)

    def __eq__(self, other: object) -> Any:  # type: ignore[override]
        return self._two("eq", other)

    def __ne__(self, other: object) -> Any:  # type: ignore[override]
        return self._two("ne", other)

    __hash__ = object.__hash__

    def __lt__(self, other: Any) -> Expr:
        return self._two("lt", other)

    def __le__(self, other: Any) -> Expr:
        return self._two("le", other)

    def __gt__(self, other: Any) -> Expr:
        return self._two("gt", other)

    def __ge__(self, other: Any) -> Expr:
        return self._two("ge", other)

    def __and__(self, other: Any) -> Expr:
        return self._two("and", other)

    def __or__(self, other: Any) -> Expr:
        return self._two("or", other)

    def __invert__(self) -> Expr:
        return Expr("not", (self,))

    def __add__(self, other: Any) -> Expr:
        return self._two("add", other)

    def __radd__(self, other: Any) -> Expr:
        return self._two("add", other, True)

    def __sub__(self, other: Any) -> Expr:
        return self._two("sub", other)

    def __rsub__(self, other: Any) -> Expr:
        return self._two("sub", other, True)

    def __mul__(self, other: Any) -> Expr:
        return self._two("mul", other)

    def __rmul__(self, other: Any) -> Expr:
        return self._two("mul", other, True)

    def __truediv__(self, other: Any) -> Expr:
        return self._two("div", other)

    def __mod__(self, other: Any) -> Expr:
        return self._two("mod", other)

    def __neg__(self) -> Expr:
        return Expr("neg", (self,))

    def is_null(self) -> Expr:
        return Expr("is_null", (self,))

    def is_not_null(self) -> Expr:
        return Expr("is_not_null", (self,))

    def isin(self, *values: Any) -> Expr:
        if len(values) == 1 and hasattr(values[0], "plan"):
            return Expr("in_subquery", (self,), (("plan", values[0].plan),))
        return Expr("in", (self, *map(wrap, values)))

    def between(self, low: Any, high: Any) -> Expr:
        return (self >= low) & (self <= high)

    def like(self, pattern: str, escape: str = "\\") -> Expr:
        return Expr("like", (self, wrap(pattern)), (("escape", escape),))

    def cast(self, kind: str) -> Expr:
        return Expr("cast", (self,), (("type", kind),))

    def alias(self, name: str) -> Expr:
        return Expr("alias", (self,), (("name", name),))

    def over(self, partition: list = (), order: list = (), frame: tuple | None = None) -> Expr:
        """A window; ``frame``: (rows or range, start, end), None for unbounded, 0 for the current row."""
        props = (("partition", len(partition)), ("frame", frame), ("order", len(order)))
        return Expr("window", (self, *map(wrap, partition), *map(wrap, order)), props)

    def _order(self, down: bool, first: bool) -> Expr:
        return Expr("order", (self,), (("down", down), ("nulls_first", first)))

    def asc(self) -> Expr:
        return self._order(False, False)

    def desc(self) -> Expr:
        return self._order(True, True)

    def asc_nulls_first(self) -> Expr:
        return self._order(False, True)

    def desc_nulls_last(self) -> Expr:
        return self._order(True, False)


def same(a: Expr, b: Expr) -> bool:
    """Structural equality (``==`` builds an expression)."""
    return a.op == b.op and len(a.args) == len(b.args) and str(a.props) == str(b.props) and all(map(same, a.args, b.args))


def wrap(value: Any) -> Expr:
    return value if isinstance(value, Expr) else lit(value)


def lit(value: Any, kind: str | None = None) -> Expr:
    return Expr("literal", (), (("value", value), ("type", kind)))


def col(name: str) -> Expr:
    return Expr("column", (), (("name", name),))


def ordinal(position: int) -> Expr:
    """The column at a place of the input, from 0."""
    return Expr("ordinal", (), (("position", position),))


def call(op: str, *args: Any, **props: Any) -> Expr:
    return Expr(op, tuple(map(wrap, args)), tuple(props.items()))


def opaque(name: str, *args: Any) -> Expr:
    """Any function that the session knows."""
    return Expr("opaque", tuple(map(wrap, args)), (("name", name),))


def when(condition: Expr, value: Any) -> Case:
    return Case([(condition, wrap(value))])


class Case:
    """CASE WHEN in the making; ``otherwise`` or ``end`` makes it an expression."""

    def __init__(self, branches: list[tuple[Expr, Expr]]):
        self.branches = branches

    def when(self, condition: Expr, value: Any) -> Case:
        return Case([*self.branches, (condition, wrap(value))])

    def otherwise(self, value: Any) -> Expr:
        return Expr("case", tuple(x for b in self.branches for x in b) + (wrap(value),))

    def end(self) -> Expr:
        return Expr("case", tuple(x for b in self.branches for x in b))


AGGREGATES = ("count", "sum", "avg", "min", "max")
GENERATORS = ("explode", "posexplode", "inline", "stack")


def _aggregate(e: Expr, a: list[Column]) -> Column:
    if e.op == "count" and not a:
        return F.count("*")
    if not e.get("distinct"):
        return getattr(F, e.op)(a[0])
    return {"count": F.count_distinct, "sum": F.sum_distinct, "min": F.min, "max": F.max, "avg": lambda c: F.call_function("avg_distinct", c)}[e.op](a[0])


def _case(a: list[Column]) -> Column:
    out = F.when(a[0], a[1])
    for i in range(2, len(a) - 1, 2):
        out = out.when(a[i], a[i + 1])
    return out.otherwise(a[-1]) if len(a) % 2 else out


def _literal(e: Expr) -> Column:
    value, kind = e.get("value"), e.get("type")
    return F.lit(value).cast(spark_type(kind)) if kind else F.lit(value)


_BUILD: dict[str, Callable[[Expr, list[Column]], Column]] = {
    "literal": lambda e, a: _literal(e),
    "column": lambda e, a: F.col(e.get("name")),
    "outer": lambda e, a: F.col(e.get("name")).outer(),
    "alias": lambda e, a: a[0].alias(e.get("name")),
    "cast": lambda e, a: a[0].cast(spark_type(e.get("type"))),
    "try_cast": lambda e, a: a[0].try_cast(spark_type(e.get("type"))),
    "eq": lambda e, a: a[0] == a[1],
    "ne": lambda e, a: a[0] != a[1],
    "lt": lambda e, a: a[0] < a[1],
    "le": lambda e, a: a[0] <= a[1],
    "gt": lambda e, a: a[0] > a[1],
    "ge": lambda e, a: a[0] >= a[1],
    "null_safe_eq": lambda e, a: a[0].eqNullSafe(a[1]),
    "and": lambda e, a: _fold(a, lambda x, y: x & y),
    "or": lambda e, a: _fold(a, lambda x, y: x | y),
    "not": lambda e, a: ~a[0],
    "is_null": lambda e, a: a[0].isNull(),
    "is_not_null": lambda e, a: a[0].isNotNull(),
    "coalesce": lambda e, a: F.coalesce(*a),
    "nullif": lambda e, a: F.nullif(*a),
    "in": lambda e, a: a[0].isin(*a[1:]),
    "like": lambda e, a: F.like(a[0], a[1], F.lit(e.get("escape", "\\"))),
    "case": lambda e, a: _case(a),
    "if": lambda e, a: F.when(a[0], a[1]).otherwise(a[2]),
    "neg": lambda e, a: -a[0],
    "add": lambda e, a: a[0] + a[1],
    "sub": lambda e, a: a[0] - a[1],
    "mul": lambda e, a: a[0] * a[1],
    "div": lambda e, a: scalar.safe_divide(*a),
    "mod": lambda e, a: scalar.mod(*a),
    "pmod": lambda e, a: scalar.pmod(*a),
    "round": lambda e, a: F.call_function("round", *a),
    "truncate": lambda e, a: scalar.truncate(*a),
    "log": lambda e, a: scalar.log(*a),
    "concat_ws": lambda e, a: F.call_function("concat_ws", *a),
    "trim": lambda e, a: scalar.trim(*a, side=e.get("side", "both")),
    "position": lambda e, a: F.call_function("locate", *a),
    "split": lambda e, a: scalar.split(a[0], a[1], e.get("limit", -1)),
    "extract": lambda e, a: scalar.extract(e.get("field"), a[0]),
    "date_trunc": lambda e, a: F.date_trunc(e.get("field"), a[0]),
    "to_date": lambda e, a: scalar.to_date(a[0], e.get("format")),
    "to_timestamp": lambda e, a: scalar.to_timestamp(a[0], e.get("format") or "yyyy-MM-dd HH:mm:ss"),
    "opaque": lambda e, a: F.call_function(e.get("name"), *a),
    "grouping": lambda e, a: F.grouping(a[0]) if len(a) == 1 else F.grouping_id(*a),
    "lead": lambda e, a: F.lead(a[0], e.get("offset", 1), e.get("default")),
    "lag": lambda e, a: F.lag(a[0], e.get("offset", 1), e.get("default")),
    "ntile": lambda e, a: F.ntile(e.get("n")),
    "nth_value": lambda e, a: F.nth_value(a[0], e.get("n")),
    "first_value": lambda e, a: F.first(a[0], e.get("ignore_nulls", False)),
    "last_value": lambda e, a: F.last(a[0], e.get("ignore_nulls", False)),
    "order": lambda e, a: getattr(a[0], f"{'desc' if e.get('down') else 'asc'}_nulls_{'first' if e.get('nulls_first') else 'last'}")(),
    **{n: _aggregate for n in AGGREGATES},
}
#: Operations whose Spark function has the same name and arguments.
PLAIN = (
    "abs ceil floor sqrt cbrt exp pow sign log2 log10 ln concat substring upper lower length replace lpad rpad reverse repeat "
    "current_date current_timestamp date_add date_sub datediff year month day hour minute second rank dense_rank percent_rank cume_dist "
    "explode posexplode inline stack greatest least"
).split()
KINDS = tuple(sorted({*_BUILD, *PLAIN, "window", "row_number", "ordinal", "scalar_subquery", "exists", "in_subquery"}))


def _fold(a: list[Column], f: Callable[[Column, Column], Column]) -> Column:
    out = a[0]
    for x in a[1:]:
        out = f(out, x)
    return out


def column(e: Expr, frame_of: Callable[[Any], Any] | None = None, columns: Callable[[], list[str]] | None = None) -> Column:
    """The Spark column. ``frame_of`` builds the plans of subqueries; ``columns`` gives the input's, for ordinals.

    They are asked for only then: a subquery with outer columns cannot be analyzed by itself.
    """
    build = lambda x: column(x, frame_of, columns)
    if e.op == "window":
        n = e.get("partition")
        spec = Window.partitionBy(*map(build, e.args[1 : 1 + n]))
        order = e.args[1 + n :]
        if order:
            spec = spec.orderBy(*[build(x if x.op == "order" else x.asc()) for x in order])
        if e.get("frame"):
            kind, low, high = e.get("frame")
            low = Window.unboundedPreceding if low is None else low
            high = Window.unboundedFollowing if high is None else high
            spec = spec.rowsBetween(low, high) if kind == "rows" else spec.rangeBetween(low, high)
        if e.args[0].op == "row_number":
            return F.row_number().over(spec).cast("bigint")
        return build(e.args[0]).over(spec)
    if e.op == "ordinal":
        return F.col(f"`{columns()[e.get('position')]}`")
    if e.op == "scalar_subquery":
        return frame_of(e.get("plan")).scalar()
    if e.op == "exists":
        return frame_of(e.get("plan")).exists()
    if e.op == "in_subquery":
        return build(e.args[0]).isin(frame_of(e.get("plan")))
    args = [build(x) for x in e.args]
    if e.op in _BUILD:
        return _BUILD[e.op](e, args)
    if e.op in PLAIN:
        return F.call_function(e.op, *args)
    raise ValueError(f"unknown expression {e.op}")


def name_of(e: Expr) -> str | None:
    """The output name that an expression gives itself."""
    if e.op == "alias":
        return e.get("name")
    return e.get("name").rpartition(".")[2] if e.op == "column" else None
