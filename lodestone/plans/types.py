"""The engine's type names, as Spark types and back.

A type is a string in Spark's own DDL spelling, so that it can be stored in an artifact;
``sum`` types (tagged unions) are structs with a discriminator and one nullable field for each
variant, which Parquet and Arrow store as they are.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Widenings that a contract may accept: from -> to.
WIDENINGS = {
    ("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("smallint", "int"), ("smallint", "bigint"),
    ("int", "bigint"), ("float", "double"), ("int", "double"), ("bigint", "double"),
}

SIMPLE = {
    "boolean": T.BooleanType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "void": T.NullType(), "variant": T.VariantType(),
    "interval": T.CalendarIntervalType(),
}


def spark_type(name: str) -> T.DataType:
    """The Spark type of a DDL type name."""
    found = SIMPLE.get(name.strip().lower())
    return found if found is not None else T._parse_datatype_string(name)


def type_name(kind: T.DataType) -> str:
    return kind.simpleString()


def sum_type(variants: dict[str, str], discriminator: str = "kind") -> T.StructType:
    """A tagged union: the variant's name, and one nullable field for each variant."""
    return T.StructType([T.StructField(discriminator, T.StringType(), False)] + [T.StructField(n, spark_type(t), True) for n, t in variants.items()])


def literal_decimal(text: str) -> T.DecimalType:
    """The type of a decimal literal: its scale, and a precision of at least one digit more."""
    digits, _, fraction = text.lstrip("+-").partition(".")
    scale = len(fraction)
    precision = len((digits + fraction).lstrip("0")) or 1
    return T.DecimalType(max(precision, scale + 1), scale)


def widens(have: str, want: str) -> bool:
    return have == want or (have, want) in WIDENINGS
