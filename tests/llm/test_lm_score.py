import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm.langid import held_out
from lodestone.llm.lm_score import (
    CHUNK,
    GROUPS,
    HASHED,
    LOSSES,
    SIZES,
    STRENGTHS,
    best_strengths,
    corrected,
    dealt,
    log_softmax,
    losses,
    op1_lm_score,
    packed,
    score_documents,
    size_of,
    tokens_of,
    unpacked,
)
from lodestone.llm.words import words_of


def tokens(text):
    return [w for w in (text or "").encode().lower().split()] + [b"\n"]


def brute(rows, held):
    counts = Counter()
    for r in rows:
        if not held(r["doc_id"]):
            counts.update(tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    out = []
    for r in rows:
        t = tokens(r["text"])
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        out.append((r["doc_id"], bool(held(r["doc_id"])), len(t), sum(w in counts for w in t), n, pytest.approx(base, rel=1e-9, abs=1e-9)))
    return sorted(out, key=lambda x: str(x[:4]))


def plain(rows):
    return sorted((tuple(r)[:6] for r in rows), key=lambda x: str(x[:4]))


def test_base_scores_and_held_out_gain(spark, docs):
    rows = op1_lm_score(spark, "/root/testdata/sf0.01").collect()
    assert plain(rows) == brute(docs.collect(), lambda i: zlib.crc32(str(i).encode()) % 5 == 1)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.97 * sum(r["base_score"] for r in out)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_probabilities_sum_to_one(spark):
    """Over all words that can follow a text, one unknown word and the end."""
    train = [(5 * i, t) for i, t in enumerate(["a b c d", "b c a", "c c d e e", "xy zy b"] * 4)]
    words = sorted({w for _, t in train for w in t.split()})
    # P("a b w") / P("a b" and no end yet) is P(w | a b) P(end | b w); the last factor is P("b w") less its own start.
    tests = [(10**6, "a b")] + [(10**6 + 1 + i, "a b " + w) for i, w in enumerate([*words, "unseenqq"])]
    frame = spark.createDataFrame(train + tests, "doc_id long, text string")
    got = {r["doc_id"]: r for r in score_documents(frame, held=F.col("doc_id") >= 10**6, steps=20).collect()}
    assert got[10**6]["n_tokens"] == 3 and got[10**6 + 1 + len(words)]["n_known"] == 3
    whole = sum(10 ** r["score"] for i, r in got.items() if i >= 10**6)
    assert whole < 1 and all(got[i]["score"] < 0 for i in got)


def test_class_and_word_factors_are_distributions():
    weights = {
        "bias": np.random.default_rng(1).normal(size=GROUPS),
        "one": np.random.default_rng(2).normal(size=(GROUPS, GROUPS)),
        "skip": np.random.default_rng(3).normal(size=(GROUPS, GROUPS)),
        "pair": np.random.default_rng(4).normal(size=(HASHED, GROUPS)),
    }
    assert np.exp(log_softmax(weights, np.arange(0, GROUPS * GROUPS, 977))).sum(axis=1) == pytest.approx(1)


def test_odd_rows(odd, empty):
    rows = score_documents(odd, held=held_out("doc_id", 5, 1), steps=3).collect()
    assert plain(rows) == brute(odd.collect(), lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 5 == 1)
    assert score_documents(empty).count() == 0
    assert all(math.isfinite(r["score"]) for r in score_documents(odd, held=F.lit(True), steps=2).collect())


def test_rare_words_follow_their_own_words(spark):
    """Words of one class, all outside the most frequent: each follows its own word, or its own two before."""
    train = [(i * 200 + j, f"w{i:03d}qq v{i:03d}zz") for i in range(150) for j in range(4)]
    train += [(10**5 + i * 200 + j, f"s{i:03d}qq x{i}{j}mm t{i:03d}zz") for i in range(150) for j in range(4)]
    tests = [(10**6, "w140qq v140zz"), (10**6 + 1, "w140qq v139zz"), (10**6 + 2, "s140qq newnn t140zz"), (10**6 + 3, "s140qq newnn t139zz")]
    frame = spark.createDataFrame(train + tests, "doc_id long, text string")
    got = {r["doc_id"]: r for r in score_documents(frame, held=F.col("doc_id") >= 10**6, steps=5).collect()}
    for right, wrong in ((10**6, 10**6 + 1), (10**6 + 2, 10**6 + 3)):
        assert got[right]["base_score"] == pytest.approx(got[wrong]["base_score"])
        assert got[right]["score"] > got[wrong]["score"] + 0.3


def test_strengths_come_from_all_buckets(spark, docs):
    """More buckets deal the same counts out; whatever their number, all training tokens choose the strengths."""
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (4, 60):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rows = score_documents(docs.limit(400), held=held_out("doc_id", 5, 1), steps=2).collect()
            got.append({r["doc_id"]: r["score"] for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # The few others have a pair in a taken slot.
    same = [abs(got[0][k] - got[1][k]) < 1e-6 * abs(got[0][k]) for k in got[0]]
    assert len(same) == 400 and sum(same) > 0.9 * len(same)


def test_both_strengths_are_the_best_of_one_pass():
    """The sums over both strengths choose what one after the other chooses."""
    random = np.random.default_rng(1)
    n = 3 * CHUNK
    p = 10 ** -random.uniform(1, 8, n)
    one, skip = random.poisson(3, n), random.poisson(2, n)
    ones, skips = (x + random.integers(0, 10 ** random.integers(0, 6, n)) for x in (one, skip))
    at, sums = losses(p, one, ones, skip, skips)
    table = np.zeros((SIZES * SIZES, LOSSES), np.int64)
    table[at] = sums
    got = best_strengths(table.reshape(-1))
    for own, (pair, context) in zip(got, ((skip, skips), (one, ones))):
        size = size_of(context)
        for k in np.unique(size[context > 0]):
            here = size == k
            loss = [-np.log((pair[here] + m * p[here]) / (context[here] + m)).sum() for m in STRENGTHS]
            assert own[k] == STRENGTHS[np.argmin(loss)]
        p = corrected(p, pair, context, own)


def test_tokens_are_words_and_ends():
    texts = ["  Ab\x0bb\x0c c\r\nÄd\te\x1cf\x85g h  ", "", " ", None, "x", "b xyz AB"]
    table = pa.table({"text": pa.chunked_array([texts[:2], texts[2:]])})
    got = tokens_of(iter(table.to_batches()))
    want = [[*words_of(t, True), b"\n"] for t in texts]
    flat = [w for t in want for w in t]
    assert got.sizes.tolist() == [len(t) for t in want] and len(set(got.hashes.tolist())) == len(got.hashes)
    assert got.hashes[got.flat].tolist() == [xxhash.xxh64_intdigest(w) for w in flat]
    assert got.endings[got.flat].tolist() == [int.from_bytes(w[-2:], "little") for w in flat]


def test_steps_add_no_jobs(spark):
    """What the driver holds of jobs does not grow with the steps."""
    frame = spark.createDataFrame([(i, f"a b{i % 7} c{i % 3} d") for i in range(60)], "doc_id long, text string")
    jobs = []
    for steps in (1, 12):
        spark.sparkContext.setJobGroup(f"steps-{steps}", "steps")
        score_documents(frame, steps=steps).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"steps-{steps}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0


def test_nothing_shuffled_before_scoring_stays_on_disk(spark, docs):
    """Of the counts and the strengths' pass, the staged table is left when the lazy result is returned."""

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x.getName() for x in (files.apply(i) for i in range(files.size())) if x.getName().startswith("shuffle_")}

    before = shuffled()
    result = score_documents(docs.limit(300), held=held_out("doc_id", 5, 1), steps=1)
    end = time.monotonic() + 4
    while shuffled() - before and time.monotonic() < end:
        time.sleep(0.1)
    assert shuffled() <= before
    assert result.count() == 300


def test_packed_numbers():
    """All 64 bits come back, and random numbers take about as many bits as they need."""
    for x in ([], [0], [0, 0, 0], [-1, 5], [2**31, 2**32, 7], [2**63 - 1, -(2**63)], list(range(1000))):
        assert unpacked(pa.py_buffer(packed(np.array(x, np.int64)))).tolist() == x
    random = np.random.default_rng(1)
    hashes = random.integers(0, 2**64, 100_000, np.uint64)
    bucket, order = dealt(hashes, 200)
    assert bucket.min() == 0 and bucket.max() == 199 and (np.diff(bucket[order]) >= 0).all()
    own = np.sort(hashes[bucket == 7])
    raw = packed(np.diff(own, prepend=np.uint64(0)))
    assert np.cumsum(unpacked(pa.py_buffer(raw)).view(np.uint64)).tolist() == own.tolist()
    assert len(raw) < 7 * len(own)
    assert len(packed(np.diff(np.sort(random.integers(0, 2**28, 3000))))) < 2.7 * 3000
    assert len(packed(random.geometric(0.9, 3000))) < 0.2 * 3000
