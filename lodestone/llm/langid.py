"""Language identification by word-first backoff.

A word that was seen in training scores by its log frequency in each language; an unseen word
falls back to its character 4-grams, those failing to 3-, 2- and 1-grams, each by their log
frequency in each language. A document's score is the sum over its words.

The model is fitted on a bounded sample of labelled documents (``SAMPLE_DOCS``, dealt evenly over
the languages, by a hash of the id). It holds every word and gram of the sample, with a score for
each language that has it and none for the others, so its size follows the sample's text and not
the number of languages. Every document is scored whole.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.words import CACHE_WORDS, slices, tidy, words_of
from lodestone.operators.staging import Stage

#: Bounds of the fit: documents in the sample, at least so many of each language.
SAMPLE_DOCS = 20_000
LEAST_DOCS = 32
LONGEST = 4


def _not_letters() -> str:
    """Ranges of the characters that are of words to ``re`` but are numbers, not letters (``½ ² ① Ⅷ`` beside digits)."""
    out: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if (x := chr(c)).isalnum() and not x.isalpha():
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


LETTERS = re.compile(rf"[^\W_{_not_letters()}]+")
UNKNOWN = "und"


def held_out(id_col: str, parts: int = 5, which: int = 0):
    """Whether crc32 of the id as text, modulo ``parts``, is ``which``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == which


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between boundary marks; single characters without the marks."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Table:
    """Log scores by key and language: of key ``i`` the ``langs`` and ``scores`` from ``start[i]`` to ``start[i + 1]``, the others ``none``.

    Scores are less the key's largest; ``top`` is what was taken away.
    """

    keys: np.ndarray  # sorted
    start: np.ndarray
    langs: np.ndarray
    scores: np.ndarray
    top: np.ndarray
    none: np.ndarray  # by language

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores for each key, zeros for keys that the table has not, and which it has."""
        out = np.zeros((len(keys), len(self.none)), np.float32)
        if not len(self.keys) or not len(keys):
            return out, np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        rows, own = np.flatnonzero(found), at[found]
        out[rows] = self.none[None, :] - self.top[own][:, None]
        size = (self.start[own + 1] - self.start[own]).astype(np.int64)
        place = np.repeat(self.start[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        out[np.repeat(rows, size), self.langs[place]] = self.scores[place]
        return out, found


@dataclass
class Model:
    """Scores of words and of grams (by length), and of languages."""

    langs: list[str]
    words: Table
    grams: list[Table]  # by length - 1
    prior: np.ndarray

    def score(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word: its own, or the mean of its longest known grams, or zeros."""
        out, known = self.words.look_up(_keys(words))
        left = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            grams = [grams_of(words[i], n) for i in left.tolist()]
            owner = np.repeat(np.arange(len(left)), [len(g) for g in grams])
            rows, found = self.grams[n - 1].look_up(_keys([g for own in grams for g in own]))
            count = np.bincount(owner[found], minlength=len(left))
            total = np.stack([np.bincount(owner, rows[:, j], len(left)) for j in range(rows.shape[1])], axis=1) if rows.shape[1] else np.zeros((len(left), 0))
            some = count > 0
            out[left[some]] = total[some] / count[some, None]
            left = left[~some]
        return out


def _keys(texts: list[str]) -> np.ndarray:
    """The hashes that ``xxhash64`` of a string has in SQL."""
    return np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42) for t in texts), np.uint64, len(texts))


def _table(counts: pa.Table, langs: list[str]) -> Table:
    """From rows (key, lang, n): half a count is added to each key in each language."""
    key, n = counts.column("key").to_numpy().view(np.uint64), counts.column("n").to_numpy()
    number = {x: i for i, x in enumerate(langs)}
    own = np.array([number[x] for x in counts.column("lang").to_pylist()], np.int32)
    keys, inverse = np.unique(key, return_inverse=True)
    order = np.lexsort((own, inverse))
    inverse, own, n = inverse[order], own[order], n[order]
    total = np.bincount(own, n, len(langs)) + 0.5 * len(keys)
    none = np.log(0.5) - np.log(np.maximum(total, 0.5))
    score = np.log(n + 0.5) - np.log(total[own]) if len(n) else np.empty(0)
    start = np.searchsorted(inverse, np.arange(len(keys) + 1))
    top = np.maximum.reduceat(score, start[:-1]) if len(keys) else np.empty(0)
    # Where a language lacks the key, its score for none can be the largest.
    lacking = np.diff(start) < len(langs)
    if lacking.any():
        best = np.argsort(-none)
        have = np.zeros(len(keys), bool)
        most = np.full(len(keys), -np.inf)
        for lang in best.tolist():
            has = np.zeros(len(keys), bool)
            has[inverse[own == lang]] = True
            most[~has & ~have] = none[lang]
            have |= ~has
            if have[lacking].all():
                break
        top = np.maximum(top, most)
    return Table(keys, start, own.astype(np.int16), (score - top[inverse]).astype(np.float32), top.astype(np.float32), none.astype(np.float32))


def shares(counts: dict[str, int], most: int) -> dict[str, float]:
    """The share of each language's rows in a sample of about ``most``: equal numbers, smaller languages whole.

    Where there are so many languages that an equal number would be below ``LEAST_DOCS``, it is that.
    """
    left, quota = most, 0.0
    for i, n in enumerate(sorted(counts.values())):
        quota = left / (len(counts) - i)
        if n >= quota:
            break
        left -= n
    else:
        return dict.fromkeys(counts, 1.0)
    return {x: min(1.0, max(quota, LEAST_DOCS) / n) for x, n in counts.items()}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the rows with text and language; no rows, no languages."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    rates = shares(sizes, SAMPLE_DOCS)
    if any(rate < 1 for rate in rates.values()):
        # Rates are cut to 2**-53 and the hash to its upper 53 bits, so that no language's share can round to nothing.
        limits = docs.sparkSession.createDataFrame([(x, max(1, int(rate * (1 << 53)))) for x, rate in rates.items()], "lang string, limit long")
        chance = F.shiftrightunsigned(F.xxhash64(F.lit(8), "id", "text"), 11)
        rows = rows.join(F.broadcast(limits), "lang").where(chance < F.col("limit")).select("id", "text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            seen: dict[tuple, int] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                for word in LETTERS.findall(text.lower()):
                    seen[lang, word] = seen.get((lang, word), 0) + 1
            keys = list(seen)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([k[0] for k in keys], pa.string()),
                    "word": pa.array([k[1] for k in keys], pa.string()),
                    "n": pa.array(list(seen.values()), pa.int64()),
                }
            )

    words = rows.mapInArrow(tidy(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = Stage(docs.sparkSession, "langid").write(words)
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    tables = [_table(words.select(F.xxhash64("word").alias("key"), "lang", "n").toArrow(), langs)]
    for n in range(1, LONGEST + 1):
        marked = words.select("lang", "n", (F.col("word") if n == 1 else F.concat(F.lit("<"), "word", F.lit(">"))).alias("w"))
        pieces = marked.where(F.length("w") >= n).selectExpr(
            "lang", "n as times", f"explode(transform(sequence(1, length(w) - {n - 1}), i -> xxhash64(substr(w, i, {n})))) as key"
        )
        tables.append(_table(pieces.groupBy("lang", "key").agg(F.sum("times").alias("n")).toArrow(), langs))
    # A language counts by all its rows, of which the sample has a share.
    letters = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum(F.col("n") * F.length("word")).alias("n")).collect()}
    counts = np.array([letters[x] / rates[x] for x in langs], np.float64)
    prior = np.log((counts + 1) / (counts.sum() + len(langs))) if langs else np.zeros(0)
    return Model(langs, tables[0], tables[1:], prior.astype(np.float32))


class Scorer:
    """Scores texts; each distinct white-space word is looked up once while it is cached."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.rows = np.zeros((0, len(self.model.langs) + 2), np.float32)

    def _learn(self, new: list[bytes]) -> None:
        """Cached rows: the sum over a word's runs of letters, how many of them tell languages apart, and their number."""
        runs = [LETTERS.findall(raw.decode("utf-8", "surrogatepass").lower()) for raw in new]
        numbers: dict[str, int] = {}
        flat = np.array([numbers.setdefault(r, len(numbers)) for own in runs for r in own], np.int64)
        owner = np.repeat(np.arange(len(new)), [len(own) for own in runs])
        scores = self.model.score(list(numbers))
        rows = np.zeros((len(new), self.rows.shape[1]), np.float32)
        np.add.at(rows[:, :-2], owner, scores[flat])
        rows[:, -2] = np.bincount(owner, scores.any(axis=1)[flat], len(new)) if len(flat) else 0
        rows[:, -1] = np.bincount(owner, minlength=len(new))
        self.index.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.rows = np.concatenate([self.rows, rows])

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Each text's language, its posterior at a temperature of the root of the number of words, and the share of words that tell languages apart."""
        words = [words_of(t, False) for t in texts]
        seen = {w for own in words for w in own}
        if len(self.index) + len(seen) > CACHE_WORDS // 8:
            self.clear()
        self._learn([w for w in seen if w not in self.index])
        get, out = self.index.__getitem__, []
        for own in words:
            total = self.rows[np.fromiter(map(get, own), np.int64, len(own))].sum(axis=0, dtype=np.float64)
            if total[-1] == 0 or not self.model.langs:
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            logits = (total[:-2] + self.model.prior) / np.sqrt(total[-1])
            odds = np.exp(logits - logits.max())
            best = int(np.argmax(logits))
            out.append((self.model.langs[best], float(odds[best] / odds.sum()), float(total[-2] / total[-1])))
        return out


def identify(
    docs: DataFrame,
    model: Model,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    pred_col: str = "lang_pred",
    score_col: str = "score",
    known_col: str | None = None,
) -> DataFrame:
    """One row per document: the ``keep`` columns, ``lang_pred``, ``score`` and, if named, the share of known words.

    A word is known if it or grams of it have other scores in one language than in another. Null texts and texts without a letter are ``und`` with score 0, and so are all texts under
    a model without languages. Equal scores go to the language that sorts first.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, "text", 1 << 20):
            got = scorer(batch.column("text").to_pylist())
            kept = [batch.column(f"k{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([g[0] for g in got], pa.string()), *[pa.array([g[i] for g in got], pa.float64()) for i in (1, 2)]],
                names=[f"k{i}" for i in range(len(keep))] + ["lang_pred", "score", "known"],
            )

    fields = ", ".join(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    out = rows.mapInArrow(tidy(score), f"{fields}{', ' if fields else ''}lang_pred string, score double, known double")
    named = [("lang_pred", pred_col), ("score", score_col)] + ([("known", known_col)] if known_col else [])
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(a).alias(b) for a, b in named])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out("doc_id")))
    return identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
