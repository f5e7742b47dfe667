"""The corpus pipeline: documents to token files, in five stages.

Each stage's result is written as Parquet in the cluster's shared folder and read again as the
next stage's documents, so that a stage never depends on what executors hold.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.decontaminate import drop_contaminated
from lodestone.llm.langid import UNKNOWN, fit, identify
from lodestone.llm.mixing import mix_sources
from lodestone.llm.ngram_join import similar_documents
from lodestone.llm.token_files import token_files
from lodestone.operators.staging import Stage

#: A document's language is identified if its posterior is so many times that of a guess (but not over 1) and
#: at least this share of its words tells languages apart.
LEAST_LIFT = 1.2
LEAST_KNOWN = 0.5
#: Most rows (a row number, or one with a small integer) that are broadcast; more meet by a sort-merge join.
BROADCAST_ROWS = 1_000_000


def fresh(name: str, columns: list[str]) -> str:
    """A column name that the documents do not have."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def numbered(spark: SparkSession, docs: DataFrame, label: str) -> tuple[Stage, DataFrame, str]:
    """The documents in a written table that numbers their rows, and the number's column.

    Rows are told apart by it, whatever ids they repeat or lack.
    """
    stage, row = Stage(spark, label), fresh("row", docs.columns)
    return stage, stage.write(docs.withColumn(row, F.monotonically_increasing_id()), codec="zstd"), row


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the model learns from the documents that have a language.

    Null texts, texts without a letter and texts in the letters of none of the languages go;
    without labelled documents all go. Repeated rows and null ids are documents like others.
    """
    columns = tuple(docs.columns)
    pred, score, known = (fresh(n, docs.columns) for n in ("lang_pred", "score", "known"))
    model = fit(docs)
    found = identify(docs, model, keep=columns, pred_col=pred, score_col=score, known_col=known)
    least = min(1.0, LEAST_LIFT / max(1, len(model.langs)))
    # Of a single language no word tells it apart from others.
    least_known = LEAST_KNOWN if len(model.langs) > 1 else 0.0
    return found.where((F.col(pred) != UNKNOWN) & (F.col(score) >= least) & (F.col(known) >= least_known)).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links of 0.8 or more of their 5-word shingles connect, the one with the smallest id.

    Exactly one row of a group stays: null ids come last, of equal ids the first row. Rows
    without words are linked with none and stay.
    """
    stage, rows, row = numbered(spark, docs, "near-duplicates")
    joined = Stage(spark, "ngram-join")
    found = similar_documents(rows, id_col=row, count_links=False, stage=joined).select(F.col(row).alias("n_row"), F.col("component_id").alias("n_group"))
    members = stage.write(rows.select(F.col(row).alias("n_row"), F.col("doc_id").alias("n_id")).join(found, "n_row"))
    joined.drop()
    first = F.min(F.struct(F.col("n_id").isNull().alias("u"), "n_id", "n_row")).alias("first")
    stays = stage.write(members.groupBy("n_group").agg(first, F.count("*").alias("n")).where("n > 1").select("n_group", "first.n_row"))
    gone = stage.write(members.join(stays.withColumnRenamed("n_row", "stays"), "n_group").where("n_row <> stays").select(F.col("n_row").alias(row)))
    small = gone.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if small else gone, row, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its words, up to 3 times; what is left of a whole
    time becomes one more with that chance, by a hash of the id. Documents without words go;
    rows that share an id or have none are mixed each on its own."""
    stage, rows, row = numbered(spark, docs, "source-mixing")
    times, copy = (fresh(n, rows.columns) for n in ("mix_times", "mix_copy"))
    mix = mix_sources(rows, row_col=row).where("taken > 0")
    share = F.pmod(F.xxhash64(F.lit(41), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    copies = mix.select(row, F.floor(F.col("taken") / F.col("size") + share).cast("int").alias(times))
    copies = stage.write(copies.where(F.col(times) > 0))
    joined = rows.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, row)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in Arrow files; one row per document as read back.

    Null and empty texts have the end id alone; repeated rows are written each, null ids come first.
    """
    return token_files(docs, Stage(spark, "token-files").path, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = Stage(spark, "pipeline")
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage.write(docs)
    return docs
