"""Python objects as rows: dataclasses and annotated classes <-> Spark schemas, tagged unions, opaque bytes."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import enum
import pickle
import types as pytypes
import typing
import uuid
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

BASIC = {
    bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(),
    decimal.Decimal: T.DecimalType(38, 18), datetime.date: T.DateType(), datetime.datetime: T.TimestampType(),
    datetime.timedelta: T.DayTimeIntervalType(), uuid.UUID: T.StringType(),
}


def type_of(kind: Any) -> tuple[T.DataType, bool]:
    """The Spark type of an annotation, and whether it can be null."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin is typing.Annotated:
        found = next((a for a in args[1:] if isinstance(a, T.DataType)), None)
        inner, null = type_of(args[0])
        return found or inner, null
    if origin in (typing.Union, pytypes.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1:
            return type_of(rest[0])[0], True
        return union_schema(tuple(rest)), len(rest) < len(args)
    if origin in (list, set, frozenset):
        inner, null = type_of(args[0])
        return T.ArrayType(inner, null), False
    if origin is tuple:
        if len(args) == 2 and args[1] is Ellipsis:
            inner, null = type_of(args[0])
            return T.ArrayType(inner, null), False
        return T.StructType([T.StructField(f"_{i + 1}", *type_of(a)) for i, a in enumerate(args)]), False
    if origin is dict:
        value, null = type_of(args[1])
        return T.MapType(type_of(args[0])[0], value, null), False
    if isinstance(kind, T.DataType):
        return kind, True
    if isinstance(kind, type) and issubclass(kind, enum.Enum):
        return T.StringType(), False
    if kind in BASIC:
        return BASIC[kind], False
    if isinstance(kind, type) and typing.get_type_hints(kind):
        return schema_of(kind), False
    raise TypeError(f"no row type for {kind}")


def schema_of(cls: type) -> T.StructType:
    """The schema of a dataclass, named tuple, typed dict or annotated class."""
    hints = typing.get_type_hints(cls, include_extras=True)
    return T.StructType([T.StructField(name, *type_of(kind)) for name, kind in hints.items()])


def union_schema(variants: tuple[type, ...]) -> T.StructType:
    """A tagged union of classes: the class's name, and one nullable struct for each."""
    return T.StructType([T.StructField("kind", T.StringType(), False)] + [T.StructField(v.__name__, schema_of(v), True) for v in variants])


def to_value(value: Any, kind: Any) -> Any:
    """A Python object as what Spark takes for the annotation."""
    if value is None:
        return None
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin is typing.Annotated:
        return to_value(value, args[0])
    if origin in (typing.Union, pytypes.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1:
            return to_value(value, rest[0])
        return (type(value).__name__, *(to_row(value, v) if isinstance(value, v) else None for v in rest))
    if origin in (list, set, frozenset) or origin is tuple and len(args) == 2 and args[1] is Ellipsis:
        return [to_value(v, args[0]) for v in value]
    if origin is tuple:
        return tuple(to_value(v, a) for v, a in zip(value, args))
    if origin is dict:
        return {to_value(k, args[0]): to_value(v, args[1]) for k, v in value.items()}
    if isinstance(value, enum.Enum):
        return value.name
    if isinstance(value, uuid.UUID):
        return str(value)
    return to_row(value, kind) if isinstance(kind, type) and kind not in BASIC else value


def to_row(value: Any, cls: type) -> tuple:
    read = value.__getitem__ if isinstance(value, dict) else lambda n: getattr(value, n)
    return tuple(to_value(read(n), k) for n, k in typing.get_type_hints(cls, include_extras=True).items())


def from_value(value: Any, kind: Any) -> Any:
    if value is None:
        return None
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin is typing.Annotated:
        return from_value(value, args[0])
    if origin in (typing.Union, pytypes.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1:
            return from_value(value, rest[0])
        cls = next(v for v in rest if v.__name__ == value["kind"])
        return from_row(value[cls.__name__], cls)
    if origin in (list, set, frozenset):
        return origin(from_value(v, args[0]) for v in value)
    if origin is tuple:
        kinds = [args[0]] * len(value) if len(args) == 2 and args[1] is Ellipsis else args
        return tuple(from_value(v, a) for v, a in zip(value, kinds))
    if origin is dict:
        return {from_value(k, args[0]): from_value(v, args[1]) for k, v in value.items()}
    if isinstance(kind, type) and issubclass(kind, enum.Enum):
        return kind[value]
    if kind is uuid.UUID:
        return uuid.UUID(value)
    if kind is bytes:
        return bytes(value)
    return from_row(value, kind) if isinstance(value, Row) else value


def from_row(row: Row, cls: type) -> Any:
    fields = {n: from_value(row[n], k) for n, k in typing.get_type_hints(cls, include_extras=True).items()}
    return fields if typing.is_typeddict(cls) else cls(**fields)


def frame_of(spark: SparkSession, objects: list, cls: type) -> DataFrame:
    return spark.createDataFrame([to_row(o, cls) for o in objects], schema_of(cls))


def objects_of(df: DataFrame, cls: type) -> list:
    """Objects of all rows; it gathers them, as any list does."""
    return [from_row(r, cls) for r in df.collect()]


def opaque_frame(spark: SparkSession, objects: list, column: str = "value") -> DataFrame:
    """Any objects as pickled bytes."""
    return spark.createDataFrame([(pickle.dumps(o),) for o in objects], T.StructType([T.StructField(column, T.BinaryType(), False)]))


def opaque_objects(df: DataFrame, column: str = "value") -> list:
    return [pickle.loads(r[column]) for r in df.select(column).collect()]


def ipc_stream(df: DataFrame, batch_rows: int = 10_000) -> typing.Iterator[bytes]:
    """Arrow IPC stream messages, one batch at a time: the schema first, the end of the stream last."""
    table = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        for batch in table.to_batches(max_chunksize=batch_rows):
            writer.write_batch(batch)
    reader = pa.ipc.MessageReader.open_stream(sink.getvalue())
    for message in reader:
        yield message.serialize().to_pybytes()


def is_record(cls: Any) -> bool:
    return dataclasses.is_dataclass(cls) or typing.is_typeddict(cls)
