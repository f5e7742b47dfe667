import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm.substring_dedup import anchors, levels, op9_substring_dedup, recompress, remove_repeats


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def brute(rows, window):
    seen = Counter()
    for r in rows:
        w = split(r["text"])
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for r in rows:
        w = split(r["text"])
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r["doc_id"], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark, docs):
    got = sorted(map(tuple, op9_substring_dedup(spark, "/root/testdata/sf0.01").collect()), key=str)
    want = brute(docs.collect(), 35)
    assert sum(w[2] for w in want) > 0
    assert got == want


def digest(rows):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows), key=str)


def test_odd_rows(odd, empty):
    assert digest(remove_repeats(odd).collect()) == brute(odd.collect(), 35)
    assert remove_repeats(empty).count() == 0


@pytest.mark.parametrize("window", [1, 3, 9, 21, 35])
def test_repetitive_texts(spark, window):
    """Small alphabets, long runs and periods, where boundaries of names matter most."""
    rng = random.Random(window)
    texts = []
    shared = [rng.choices("ab", k=60), ["a"] * 70, ["a", "b"] * 40, list("abc") * 30, rng.choices("abcdefgh", k=50)]
    for i in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choices("abcdefghijklmnop", k=rng.randint(0, 40))
            piece = rng.choice(shared)
            at = rng.randrange(len(piece))
            parts += piece[at : at + rng.randint(5, 60)]
        texts.append((i, " ".join(parts)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert digest(remove_repeats(frame, window=window).collect()) == brute(frame.collect(), window)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    rounds, context = levels(35)
    assert len(rounds) == 3 and context == 7
    for alphabet in (2, 3, 50):
        symbols = rng.integers(1, alphabet + 1, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for _ in range(30):
            a, b, n = rng.integers(0, 3900), rng.integers(0, 3900), rng.integers(35, 100)
            symbols[b : b + n] = symbols[a : a + n][: len(symbols[b : b + n])]
        starts = np.array([0, 700, 701, 2000, 4000])
        at, count, key = anchors(symbols, starts, 35)
        by = {}
        for s, c, k in zip(at.tolist(), count.tolist(), key.tolist()):
            for i in range(s, s + c):
                assert by.setdefault(symbols[i : i + 35].tobytes(), k) == k
        sizes = recompress(symbols, np.isin(np.arange(4000), starts), 35)[1]
        assert sizes.sum() == 4000 and sizes.max() <= 4


@pytest.mark.parametrize("bits", [1, 4, 12])
def test_clashing_hashes_change_nothing(spark, docs, bits):
    """With few bits nearly all words, names and windows clash; words decide."""
    rows = docs.select("doc_id", "text").limit(60).collect()
    rng = random.Random(bits)
    passage = " ".join(rng.choices("abcdefghij", k=50))
    rows = [(r["doc_id"], r["text"]) for r in rows] + [(10**6 + i, f"{i} start {passage} end {i}") for i in range(9)] + [(None, passage)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(remove_repeats(frame, hash_bits=bits).collect()) == brute(frame.collect(), 35)


def test_rows_without_id_and_with_one_id_stay_apart(spark):
    """Rows whose texts share a 32-bit hash, without an id or with the same id."""
    from pyspark.sql import functions as F

    shared = " ".join(f"word{i}" for i in range(40))
    own = spark.range(300_000).select(F.col("id").alias("i"), F.concat(F.lit(shared), F.lit(" and "), F.col("id")).alias("text")).withColumn("h", F.hash("text"))
    pairs = [r["t"] for r in own.groupBy("h").agg(F.collect_list("text").alias("t")).where("size(t) > 1").limit(3).collect()]
    assert pairs
    rows = [(None, t) for p in pairs for t in p] + [(7, t) for t in pairs[0]] + [(None, "x " * 60 + pairs[0][0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(remove_repeats(frame).collect()) == brute(frame.collect(), 35)


def test_ids_of_any_type(spark):
    rows = [("a", "w " * 40), ("b", "w " * 41), (None, None), ("c", "only once")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"))
    assert {(r["doc_id"], r["n_removed"]) for r in got.collect()} == {("a", 40), ("b", 41), (None, 0), ("c", 0)}
