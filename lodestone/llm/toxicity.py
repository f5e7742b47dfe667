"""Toxicity by cumulative-link ordinal regression.

P(grade > j) = sigmoid(w . x - t_j) with one weight vector for all thresholds t_1 < t_2 < ...;
the severity is the sum of these probabilities, the expected grade. x holds the presence of
hashed words; words whose presence is not associated with the grade (likelihood ratio under
``LEAST_RATIO``) get no weight, or single documents' words would be learnt by heart. The model
is fitted by gradient steps on a bounded sample of labelled documents (``SAMPLE_DOCS``, by a
hash of the id); every document is scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.words import CACHE_WORDS, slices, words_of

#: Bounds of the fit: labelled documents in the sample, hashed features.
SAMPLE_DOCS = 10_000
BUCKETS = 1 << 18
STEPS = 300
#: Of some 100,000 words without association, about one has a likelihood ratio of 20 or more.
LEAST_RATIO = 20.0
LETTERS = re.compile(r"[^\W\d_]+")


class Features:
    """Sorted distinct feature numbers of texts; each distinct white-space word is hashed once while it is cached."""

    def __init__(self):
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.cache) > CACHE_WORDS // 2:
            self.cache.clear()
        out: set[int] = set()
        for raw in set(words_of(text, True)):
            found = self.cache.get(raw)
            if found is None:
                pieces = LETTERS.findall(raw.decode("utf-8", "surrogatepass").lower())
                found = self.cache[raw] = tuple(zlib.crc32(p.encode()) % BUCKETS for p in pieces)
            out.update(found)
        return np.array(sorted(out), np.int64)


@dataclass
class Model:
    weights: np.ndarray
    cuts: np.ndarray  # increasing

    def tails(self, features: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.cuts - self.weights[features].sum()))


def association(flat: np.ndarray, owner: np.ndarray, n_words: int, positive: np.ndarray) -> np.ndarray:
    """The likelihood ratio of each word's presence and a property of documents."""
    n, m = len(positive), positive.sum()
    a = np.bincount(flat, positive[owner], n_words)
    b = np.bincount(flat, minlength=n_words) - a
    cells = ((a, m), (b, n - m), (m - a, m), (n - m - b, n - m))
    row = (a + b, a + b, n - a - b, n - a - b)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * sum(np.where(x > 0, x * np.log(x * n / (r * t)), 0.0) for (x, t), r in zip(cells, row))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, steps: int = STEPS, rate: float = 0.1, decay: float = 5e-3) -> Model:
    """Adam on the cumulative-link likelihood of the words that grades over 0 have more often.

    The penalty draws a weight to the word's own log odds, so that a word that is found in such
    documents only counts fully even where it never stands alone. Thresholds are kept in order.
    """
    levels = np.arange(n_grades - 1)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, flat = np.unique(flat, return_inverse=True)
    chosen = np.zeros(len(used), bool)
    for j in levels:
        chosen |= association(flat, owner, len(used), (grades > j).astype(float)) >= LEAST_RATIO
    positive = (grades > 0).astype(float)
    a = np.bincount(flat, positive[owner], len(used))
    b = np.bincount(flat, minlength=len(used)) - a
    odds = np.log((a + 0.5) / (positive.sum() + 1)) - np.log((b + 0.5) / (len(grades) - positive.sum() + 1))
    chosen &= odds > 0
    number = np.cumsum(chosen) - 1
    keep = chosen[flat]
    flat, owner, used = number[flat[keep]], owner[keep], used[chosen]
    odds = odds[chosen]
    w = odds.copy()
    share = np.array([(np.sum(grades > j) + 0.5) / (len(grades) + 1) for j in levels])
    cut = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * levels)
    moments = [(np.zeros(len(w)), np.zeros(len(w))), (np.zeros(len(cut)), np.zeros(len(cut)))]
    n = max(1, len(rows))
    for step in range(1, steps + 1):
        z = np.bincount(owner, w[flat], len(rows))
        tails = 1 / (1 + np.exp(np.clip(cut[None, :] - z[:, None], -60, 60)))
        padded = np.concatenate([np.ones((len(rows), 1)), tails, np.zeros((len(rows), 1))], axis=1)
        p = np.take_along_axis(padded, grades[:, None], 1) - np.take_along_axis(padded, grades[:, None] + 1, 1)
        # P(grade) = tail below less tail above; both tails' slopes are tail (1 - tail).
        slope = tails * (1 - tails) / np.maximum(p, 1e-9)
        lower = (grades[:, None] - 1 == levels[None, :]) * slope
        upper = (grades[:, None] == levels[None, :]) * slope
        dz = (lower - upper).sum(axis=1)
        grads = (decay * (w - odds) - np.bincount(flat, dz[owner], len(w)) / n, (lower - upper).sum(axis=0) / n)
        for x, grad, (a, b) in zip((w, cut), grads, moments):
            a += 0.1 * (grad - a)
            b += 0.001 * (grad * grad - b)
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        cut[:] = np.maximum.accumulate(cut)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return Model(weights, cut)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Grades: 0 not toxic, 1 toxic, 2 toxic and of low quality. Rows with a null label or id are left out."""
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.when(F.col("toxic") > 0, F.when(F.col("quality") == 0, 2).otherwise(1)).otherwise(0)).alias("grade"))
    )
    total = known.count()
    if total > SAMPLE_DOCS:
        # The upper 53 bits of a hash against the rate to 2**-53, which no number of labels rounds to nothing.
        known = known.where(F.shiftrightunsigned(F.xxhash64(F.lit(5), "id"), 11) < max(1, int(SAMPLE_DOCS / total * (1 << 53))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id").select("text", "grade")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches, "text"):
            got = [features(t).astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), batch.column("grade")], names=["x", "grade"])

    got = sorted((bytes(r["x"]), r["grade"]) for r in rows.mapInArrow(extract, "x binary, grade int").collect())
    return fit_ordinal(
        [np.frombuffer(x, "<i4").astype(np.int64) for x, _ in got], np.array([g for _, g in got], np.int64), 3
    )


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """One row per document: id, ``severity`` (expected grade), ``p_toxic``, ``grade``, ``toxic`` (p_toxic over ``limit``).

    Null and empty texts have no features and get the base rate. ``grade`` is the most likely
    grade, the lowest of equals. Other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, fitted = Features(), shared.value
        for batch in slices(batches, "text"):
            tails = np.array([fitted.tails(features(t)) for t in batch.column("text").to_pylist()], np.float64)
            edge = np.ones((len(tails), 1))
            grade = np.argmax(np.hstack([edge, tails]) - np.hstack([tails, 0 * edge]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(tails.sum(axis=1)),
                    pa.array(tails[:, 0]),
                    pa.array(grade.astype(np.int32)),
                    pa.array(tails[:, 0] > limit),
                ],
                names=["id", "severity", "p_toxic", "grade", "toxic"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"id {kind}, severity double, p_toxic double, grade int, toxic boolean").withColumnRenamed("id", id_col)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
