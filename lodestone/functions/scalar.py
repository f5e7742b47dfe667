"""Column functions with the engine's rules, where Spark has none or another default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column) -> Column:
    """Fractional; NULL for a divisor of zero."""
    return F.try_divide(a, b)


def mod(a: Column, b: Column) -> Column:
    """With the dividend's sign; NULL for a divisor of zero."""
    return F.try_mod(a, b)


def pmod(a: Column, b: Column) -> Column:
    """Never negative for a positive divisor; NULL for a divisor of zero."""
    return F.when(b != 0, F.pmod(a, b))


def truncate(x: Column, scale: Column | int = 0) -> Column:
    """Toward zero, to a number of decimal places."""
    if isinstance(scale, int):
        digits = F.signum(x) * F.floor(F.abs(x.cast("decimal(38, 18)")), F.lit(scale))
        return F.when(F.abs(x) < 1e15, digits.cast("double")).otherwise(x.cast("double"))
    unit = F.pow(F.lit(10.0), scale)
    return F.signum(x) * F.floor(F.abs(x) * unit) / unit


def log(*args: Column) -> Column:
    """Natural for one argument, else with the first as base."""
    return F.ln(args[0]) if len(args) == 1 else F.call_function("log", *args)


def trim(s: Column, characters: Column | None = None, side: str = "both") -> Column:
    """Spaces, or the given characters, from both ends, the leading or the trailing one."""
    function = {"both": F.btrim if characters is not None else F.trim, "leading": F.ltrim, "trailing": F.rtrim}[side]
    return function(s) if characters is None else function(s, characters)


def split(s: Column, delimiter: Column, limit: int = -1) -> Column:
    """By a literal delimiter, into an array."""
    return F.split(s, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")), limit)


def extract(field: str, x: Column) -> Column:
    """A field of a date or timestamp as an int; days of the week run from Monday = 1, weeks are ISO weeks."""
    field = field.upper()
    if field in ("DOW", "DAYOFWEEK"):
        return F.weekday(x) + 1
    if field == "MICROSECOND":
        return F.pmod(F.unix_micros(x.cast("timestamp")), F.lit(1_000_000)).cast("int")
    if field == "MILLISECOND":
        return F.pmod(F.unix_millis(x.cast("timestamp")), F.lit(1000)).cast("int")
    return F.floor(F.extract(F.lit({"DAYOFYEAR": "DOY"}.get(field, field)), x)).cast("int")


def to_date(s: Column, pattern: str | None = None) -> Column:
    """NULL for text that is no date."""
    return F.try_to_date(s, pattern) if pattern else F.try_to_date(s)


def to_timestamp(s: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """NULL for text that is no timestamp."""
    return F.try_to_timestamp(s, F.lit(pattern))
