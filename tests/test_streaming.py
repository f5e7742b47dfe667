from pyspark.sql import functions as F

from lodestone.plans.query import Table, call, col
from lodestone.streaming.queries import start, stream_parquet

SF = "/root/testdata/sf0.001"


def test_a_query_over_a_stream_equals_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = stream_parquet(spark, str(tmp_path / "in"), 1)
    query = Table("events").where(col("value") > 50).select("event_id", (col("value") * 2).alias("twice"))
    start(spark, query, {"events": stream}, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, query.frame(spark, {"events": events}).collect()))


def test_a_grouped_query_in_complete_mode(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = stream_parquet(spark, str(tmp_path / "in"))
    query = Table("events").group_by("event_type").agg(call("count").alias("n"))
    start(spark, query.compile(), {"events": stream}, "by_type", str(tmp_path / "c2"), mode="complete").awaitTermination()
    want = spark.read.parquet(f"{SF}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("by_type").collect())) == sorted(map(tuple, want.collect()))
