"""Readers and writers: Parquet with footer metadata, delimited ``.tbl`` files, Arrow tables and streams, other engines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.encoders import ipc_stream

CODECS = ("none", "snappy", "gzip", "zstd")
ROW_GROUP = 128 << 20
PAGE = 1 << 20

#: The columns of dbgen's files, in their order (fixed values of the TPC-H specification).
TBL = {
    "region": "r_regionkey int, r_name string, r_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "supplier": "s_suppkey bigint, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal decimal(15,2), s_comment string",
    "customer": "c_custkey bigint, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal decimal(15,2), c_mktsegment string, c_comment string",
    "part": "p_partkey bigint, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice decimal(15,2), p_comment string",
    "partsupp": "ps_partkey bigint, ps_suppkey bigint, ps_availqty int, ps_supplycost decimal(15,2), ps_comment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice decimal(15,2), o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity decimal(15,2), l_extendedprice decimal(15,2), l_discount decimal(15,2), l_tax decimal(15,2), l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string",
}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def register_parquet(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Read and name a table in one call."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def write_parquet(df: DataFrame, path: str, codec: str = "snappy", row_group: int = ROW_GROUP, page: int = PAGE, partition_by: tuple[str, ...] = ()) -> None:
    if codec not in CODECS:
        raise ValueError(f"codec {codec} is none of {', '.join(CODECS)}")
    writer = df.write.mode("overwrite").option("compression", codec).option("parquet.block.size", row_group).option("parquet.page.size", page)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


@dataclass(frozen=True)
class ColumnStatistics:
    nulls: int | None
    low: object
    high: object


@dataclass(frozen=True)
class ParquetMetadata:
    schema: pa.Schema
    rows: int
    bytes: int
    columns: dict[str, ColumnStatistics]


def parquet_metadata(path: str) -> ParquetMetadata:
    """What the footers of a file or folder say; no data page is read."""
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(root)
    files = [root] if info.is_file else sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.path.endswith(".parquet"))
    schema, rows, size, found = None, 0, 0, {}
    for name in files:
        meta = pq.ParquetFile(name, filesystem=fs).metadata
        schema = schema or meta.schema.to_arrow_schema()
        rows += meta.num_rows
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            for c in range(group.num_columns):
                column = group.column(c)
                size += column.total_compressed_size
                stats = column.statistics
                if stats is not None:
                    found.setdefault(column.path_in_schema, []).append(stats)
    columns = {}
    for name, stats in found.items():
        known = [s for s in stats if s.has_min_max]
        nulls = [s.null_count for s in stats]
        columns[name] = ColumnStatistics(
            None if any(n is None for n in nulls) else sum(nulls),
            min((s.min for s in known), default=None),
            max((s.max for s in known), default=None),
        )
    return ParquetMetadata(schema, rows, size, columns)


def read_tbl(spark: SparkSession, table: str, path: str) -> DataFrame:
    """One of dbgen's files: fields end with a bar."""
    return spark.read.csv(path, sep="|", schema=TBL[table] + ", end string").drop("end")


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def to_arrow(df: DataFrame) -> pa.Table:
    """All rows as one Arrow table, on the driver."""
    return df.toArrow()


def arrow_stream(df: DataFrame, batch_rows: int = 10_000) -> Iterator[bytes]:
    return ipc_stream(df, batch_rows)


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Another engine's result by JDBC; its driver must be on the class path."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def collect_maps(df: DataFrame) -> list[dict]:
    """A result as name -> value maps."""
    return [r.asDict() for r in df.collect()]
