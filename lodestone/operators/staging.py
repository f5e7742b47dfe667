"""Written intermediate tables in the cluster's shared folder.

A staged table cuts lineage: what was written survives the loss of any executor, and each
round of an iterative operator reads only what its predecessor wrote.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

ROW_GROUP_BYTES = 32 << 20
COLLECTIONS = 3
#: The longest wait for the gateway's queue.
GATEWAY_SECONDS = 10


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only where that is unset and one machine runs all tasks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.conf.get("spark.lodestone.shared.dir", None) or "file://" + tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("spark.lodestone.shared.dir", own)
    return own


def collect_garbage(spark: SparkSession) -> None:
    """Collect the driver's garbage, as executors keep the shuffle files of frames that are gone until it is.

    Python's gateway tells the JVM what is gone from a queue, up to a second later, and what one collection there
    frees can hold the shuffles until the next: a single one, at once, mostly left them.
    """
    queue = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    for _ in range(COLLECTIONS):
        gc.collect()
        end = time.monotonic() + GATEWAY_SECONDS
        while queue and time.monotonic() < end:
            time.sleep(0.02)
        time.sleep(0.2)  # the last one leaves the queue before it is told
        spark.sparkContext._jvm.System.gc()


class Stage:
    """A private folder under the shared one; tables in it can be dropped when done with."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame, partition_by: list[str] | None = None, codec: str = "snappy") -> DataFrame:
        """Write a table and return it as read back; ``zstd`` is for tables of texts, many small files cost less without."""
        self._n += 1
        path = f"{self.path}/{self._n}"
        # A writing task holds one row group; these are small enough for executors of a few gigabytes.
        writer = df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).option("compression", codec)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        schema = self.spark.read.parquet(path).schema if partition_by else df.schema
        return self.spark.read.schema(schema).parquet(path)

    @property
    def last(self) -> int:
        """The number of the table written last."""
        return self._n

    def drop(self, *numbers: int) -> None:
        """Delete tables that no later reader needs; without numbers, all."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for place in [f"{self.path}/{n}" for n in numbers] or [self.path]:
            path = jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(conf).delete(path, True)
