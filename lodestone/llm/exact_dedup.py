"""Exact de-duplication by distributed MSD radix partitioning.

Texts are split by successive runs of bytes ("digits"), most significant first. A round
groups the rows that are still undecided by (group so far, next digit); a group of one row
is decided, a group whose texts end within the digit is a class of equal texts, and only
the others go on to the next, wider digit with the bytes that are left. Two rows share a
class only if all their digits agreed, so equality rests on the bytes themselves. Rows are numbered
once, in a written table, and a group is named by its least row number; the SHA-256 column is
computed for the result and is part of no key.

Scale: the count per digit is combined before its shuffle, so a text that a third of all rows
share reaches the reducers once per map task; rows meet their group by a join, whose hot keys
adaptive execution splits. Each round is a written table that holds the undecided bytes only;
what a round has read is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.staging import Stage

#: Characters deleted before texts are compared.
SPACES = " \t\n\x0b\x0c\r"


def without_spaces(text):
    """The text without the characters of ``SPACES``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=without_spaces,
    first_digit: int = 32,
    growth: int = 8,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with most code points in its original text stays, then the
    smallest id, null ids last, then the first row: of each class exactly one row is ``kept``,
    of repeated rows with one id too. A null text is an empty one; empty texts form one class. Other columns are ignored, so their
    names cannot clash. An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    stage = Stage(spark, "exact-dedup")
    norm = normalise(F.col(text_col))
    rows = stage.write(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"),
            F.sha2(norm.cast("binary"), 256).alias("sha"),
            norm.cast("binary").alias("rest"),
        )
    )
    decided, keys, width = [], ["digit"], first_digit
    source = stage.last
    while True:
        rows = rows.withColumn("digit", F.substring("rest", 1, width)).withColumn(
            "rest", F.expr(f"substring(rest, {width + 1})")
        )
        # Written, the groups meet the rows by an exchange of their own, and a hot digit's rows can be split.
        groups = stage.write(
            rows.groupBy(*keys).agg(
                F.count("*").alias("n"),
                F.min("row").alias("next_group"),
                F.min(
                    F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("u"), F.col("id").alias("i"), F.col("row").alias("r"))
                ).alias("best"),
            )
        )
        done = (F.col("n") == 1) | (F.octet_length("digit") < width)
        joined = rows.join(groups, keys).select(
            "row",
            "id",
            "points",
            "sha",
            F.col("best.i").alias("keep_id"),
            F.col("n").alias("group_size"),
            (F.col("row") == F.col("best.r")).alias("kept"),
            done.alias("done"),
            F.when(~done, F.col("next_group")).alias("group"),
            F.when(~done, F.col("rest")).alias("rest"),
        )
        counted = stage.last
        written = stage.write(joined)
        stage.drop(counted, *([source] if keys == ["digit"] else []))
        decided.append(
            written.where("done").select(
                F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
            )
        )
        left = written.where("not done")
        if left.isEmpty():
            break
        rows, keys, width = left.select("row", "id", "points", "sha", "group", "rest"), ["group", "digit"], width * growth
    out = decided[0]
    for part in decided[1:]:
        out = out.unionAll(part)
    return out


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
k AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
