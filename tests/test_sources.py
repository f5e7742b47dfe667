"""Readers, writers and row encoders."""

import dataclasses
import datetime
import decimal
import enum
import typing
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.sources.encoders import frame_of, objects_of, opaque_frame, opaque_objects, schema_of
from lodestone.sources.io import (
    TBL, arrow_stream, collect_maps, from_arrow, parquet_metadata, read_parquet, read_tbl, register_parquet, to_arrow, write_parquet,
)


class Color(enum.Enum):
    RED = 1
    BLUE = 2


@dataclasses.dataclass
class Address:
    street: str
    zip: int | None


@dataclasses.dataclass
class Circle:
    r: float


@dataclasses.dataclass
class Square:
    side: float
    name: str | None


@dataclasses.dataclass
class Person:
    name: str
    age: int
    address: Address
    tags: list[str]
    scores: dict[str, float]
    born: datetime.date | None
    seen: datetime.datetime
    money: decimal.Decimal
    key: uuid.UUID
    color: Color
    pair: tuple[int, str]
    data: bytes
    shape: Circle | Square


class Point(typing.NamedTuple):
    x: int
    y: float | None


def person(i):
    return Person(
        f"p{i}", i, Address("s", None if i else 3), ["a"] * i, {"k": 1.5}, None if i else datetime.date(2024, 2, 29), datetime.datetime(2024, 1, 1, 2, 3, 4),
        decimal.Decimal("1.500000000000000000"), uuid.UUID(int=i), Color.BLUE, (i, "x"), b"\x00\x01", Circle(1.0) if i else Square(2.0, None),
    )


def test_dataclasses_round_trip(spark):
    people = [person(0), person(2)]
    df = frame_of(spark, people, Person)
    assert df.schema == schema_of(Person) and not df.schema["name"].nullable and df.schema["born"].nullable
    assert sorted(objects_of(df, Person), key=lambda p: p.age) == people
    assert df.where("shape.kind = 'Square'").select("shape.Square.side").first()[0] == 2.0


def test_other_records(spark):
    class Typed(typing.TypedDict):
        a: int
        b: str

    assert objects_of(frame_of(spark, [Point(1, None), Point(2, 0.5)], Point).orderBy("x"), Point) == [Point(1, None), Point(2, 0.5)]
    assert objects_of(frame_of(spark, [{"a": 1, "b": "x"}], Typed), Typed) == [{"a": 1, "b": "x"}]
    things = [{"any": {1, 2}}, Point(3, 4.0)]
    assert sorted(map(str, opaque_objects(opaque_frame(spark, things)))) == sorted(map(str, things))
    with pytest.raises(TypeError):
        schema_of(type("Bad", (), {"__annotations__": {"x": complex}}))


@pytest.mark.parametrize("codec", ["none", "snappy", "gzip", "zstd"])
def test_parquet(spark, tmp_path, codec):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") > 9, F.lit("x")).alias("s")).repartition(3)
    path = str(tmp_path / "t")
    write_parquet(df, path, codec, row_group=1 << 20, page=1 << 16)
    assert read_parquet(spark, path).orderBy("id").collect() == df.orderBy("id").collect()
    file = next((tmp_path / "t").glob("*.parquet"))
    assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == {"none": "UNCOMPRESSED"}.get(codec, codec.upper())
    meta = parquet_metadata(path)
    assert (meta.rows, meta.columns["id"].low, meta.columns["id"].high, meta.columns["s"].nulls) == (1000, 0, 999, 10)
    assert meta.schema.names == ["id", "k", "s"] and meta.bytes > 0
    register_parquet(spark, "reg_t", path)
    assert spark.sql("SELECT count(*) AS n FROM reg_t").first()["n"] == 1000
    with pytest.raises(ValueError):
        write_parquet(df, path, "lzo")


def test_tbl(spark, tmp_path):
    (tmp_path / "nation.tbl").write_text("0|ALGERIA|0|some text|\n1|ARGENTINA|1||\n")
    got = read_tbl(spark, "nation", str(tmp_path / "nation.tbl")).orderBy("n_nationkey").collect()
    assert [tuple(r) for r in got] == [(0, "ALGERIA", 0, "some text"), (1, "ARGENTINA", 1, None)]
    assert len(TBL) == 8


def test_arrow(spark):
    df = spark.range(25).select("id", F.array("id").alias("a"))
    table = to_arrow(df)
    assert from_arrow(spark, table).orderBy("id").collect() == df.orderBy("id").collect()
    parts = list(arrow_stream(df, 10))
    assert len(parts) >= 4  # the schema, then batches
    assert pa.ipc.open_stream(b"".join(parts)).read_all().num_rows == 25
    assert collect_maps(spark.sql("SELECT 1 AS a, 'x' AS b")) == [{"a": 1, "b": "x"}]
