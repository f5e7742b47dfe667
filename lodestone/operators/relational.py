"""DataFrame operators whose rules differ from the DataFrame API's own."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot(df: DataFrame, columns: list[tuple[str, str]], name: str, value: str, nulls: bool = False) -> DataFrame:
    """Columns to rows; ``columns`` are (column, its name in the output). NULL values go unless asked for."""
    names = {c for c, _ in columns}
    ids = [c for c in df.columns if c not in names]
    if any(c != n for c, n in columns):
        df = df.withColumnsRenamed(dict(columns))
    out = df.unpivot(ids, [n for _, n in columns], name, value)
    return out if nulls else out.where(F.col(value).isNotNull())


def pivot(df: DataFrame, keys: list[Column], on: str, values: list[Any], aggs: list[Column]) -> DataFrame:
    """Rows to columns, for stated values: no job looks for them."""
    return df.groupBy(*keys).pivot(on, values).agg(*aggs)


def generate(df: DataFrame, generator: str, args: list[Column], names: list[str], outer: bool = False) -> DataFrame:
    """The rows that explode, posexplode, inline or stack make of each row, beside its columns."""
    made = F.call_function(generator + ("_outer" if outer and generator != "stack" else ""), *args)
    return df.select("*", made.alias(*names))


def aggregate(df: DataFrame, keys: list[Column], aggs: list[Column], sets: Any = None) -> DataFrame:
    """Keys, then aggregates. ``sets``: rollup, cube, or lists of key numbers."""
    if sets in ("rollup", "cube"):
        return getattr(df, sets)(*keys).agg(*aggs)
    if sets:
        return df.groupingSets([[keys[i] for i in s] for s in sets], *keys).agg(*aggs)
    if not keys:
        return df.select(*aggs)  # as it stays unanalyzed, it can be a subquery with outer columns
    return df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()


def hint(df: DataFrame, name: str, *args: Any) -> DataFrame:
    """A join strategy, or a number or keys of partitions."""
    name = name.lower()
    if name == "coalesce":
        return df.coalesce(*args)
    if name == "repartition":
        return df.repartition(*args)
    if name == "repartition_by_range":
        return df.repartitionByRange(*args)
    return df.hint(name, *args)


def union(frames: list[DataFrame], by_name: bool = False, missing: bool = False, distinct: bool = False) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, missing) if by_name else out.unionAll(other)
    return out.distinct() if distinct else out
