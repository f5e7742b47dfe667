import math
import re
import zlib

import numpy as np

from lodestone.llm.toxicity import BUCKETS, Model, association, fit, fit_ordinal, op5_toxicity, score


def test_catches_toxic_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in op5_toxicity(spark, sf).collect()}
    known = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    toxic = [got[i]["severity"] for i, t in known.items() if t]
    clean = [got[i]["severity"] for i, t in known.items() if not t]
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in clean] for a in toxic])
    assert auc > 0.8


def test_thresholds_are_ordered_and_shared():
    rng = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(600):
        n = int(rng.integers(0, 4))
        rows.append(np.unique(np.concatenate([rng.integers(100, 140, 5), np.arange(n)])))
        grades.append(0 if n == 0 else 1 if n < 3 else 2)
    model = fit_ordinal(rows, np.array(grades), 3)
    assert model.cuts[0] < model.cuts[1]
    severity = [model.tails(r).sum() for r in rows]
    assert np.mean([severity[i] for i, g in enumerate(grades) if g == 2]) > np.mean([severity[i] for i, g in enumerate(grades) if g == 1]) + 0.3
    assert np.mean([severity[i] for i, g in enumerate(grades) if g == 0]) < 0.3


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, None), (7, None, 0), (None, 1, 1), (10, 0, 1), (11, 1, 0)], "doc_id long, quality int, toxic int")
    model = fit(odd, labels)
    rows = score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["severity"] <= 2 for r in rows)
    assert score(empty, model).count() == 0
    assert score(odd, fit(empty, labels)).count() == odd.count()


def test_held_out_documents(spark):
    """Half of the labels train, the other half is judged."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = score(docs.where(~half), fit(docs, labels.where(half))).join(labels.select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    toxic, clean = ([r for r in rows if r["truth"] == t] for t in (1, 0))
    assert np.mean([r["toxic"] for r in toxic]) > 0.8
    assert np.mean([r["toxic"] for r in clean]) < 0.01


def test_scores_against_brute_force(spark, odd, docs):
    """Severity, probability and grade from the weights, word by word, over whole texts."""
    rng = np.random.default_rng(3)
    model = Model(rng.normal(0, 0.3, BUCKETS).astype(np.float32), np.array([0.4, 1.1]))
    frame = odd.select("doc_id", "text").unionAll(docs.select("doc_id", "text").limit(100))
    want = []
    for r in frame.collect():
        words = {p for w in (r["text"] or "").encode().split() for p in re.findall(r"[^\W\d_]+", w.lower().decode().lower())}
        x = sum(float(model.weights[i]) for i in {zlib.crc32(p.encode()) % BUCKETS for p in words})
        one, two = (1 / (1 + math.exp(c - x)) for c in (0.4, 1.1))
        want.append((r["doc_id"], round(one + two, 4), round(one, 4), int(np.argmax([1 - one, one - two, two]))))
    got = [(r["doc_id"], round(r["severity"], 4), round(r["p_toxic"], 4), r["grade"]) for r in score(frame, model).collect()]
    assert [str(x[:1] + x[3:]) for x in sorted(got, key=str)] == [str(x[:1] + x[3:]) for x in sorted(want, key=str)]
    assert np.allclose(sorted(x[1:3] for x in got), sorted(x[1:3] for x in want), atol=2e-4)


def test_the_fit_is_an_optimum_of_the_ordinal_likelihood():
    """Steps away from the fitted weights and thresholds do not raise the penalized likelihood, computed grade by grade."""
    rng = np.random.default_rng(4)
    rows, grades = [], []
    for _ in range(400):
        x = np.unique(rng.integers(0, 12, 5))
        z = 1.5 * (x < 2).sum() - 1 + rng.logistic()
        rows.append(x)
        grades.append(0 if z < 0 else 1 if z < 1.5 else 2)
    grades = np.array(grades)
    model = fit_ordinal(rows, grades, 3, steps=3000, rate=0.01)
    used = np.flatnonzero(model.weights)
    positive = (grades > 0).astype(float)
    odds = {}
    for j in used:
        has = np.array([j in r for r in rows])
        odds[j] = math.log((positive[has].sum() + 0.5) / (positive.sum() + 1)) - math.log(((1 - positive)[has].sum() + 0.5) / ((1 - positive).sum() + 1))
    assert len(used) and all(x > 0 for x in odds.values())

    def loss(w, cuts):
        out = 0.0
        for r, g in zip(rows, grades):
            tails = [1.0, *(1 / (1 + math.exp(c - sum(w.get(j, 0.0) for j in r))) for c in cuts), 0.0]
            out -= math.log(tails[g] - tails[g + 1])
        return out / len(rows) + 0.5 * 5e-3 * sum((w[j] - odds[j]) ** 2 for j in used)

    w, cuts = {j: float(model.weights[j]) for j in used}, model.cuts.tolist()
    best = loss(w, cuts)
    for step in (-0.05, 0.05):
        for j in used:
            assert loss({**w, j: w[j] + step}, cuts) > best - 1e-6
        for k in range(2):
            assert loss(w, [c + step * (i == k) for i, c in enumerate(cuts)]) > best - 1e-6


def test_association_is_the_likelihood_ratio():
    rows = [[0, 1], [0], [1, 2], [2], [0, 2], [1]]
    positive = np.array([1.0, 1, 0, 0, 1, 0])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(6), [len(r) for r in rows])
    for j, got in enumerate(association(flat, owner, 3, positive)):
        want = 0.0
        for has in (True, False):
            for p in (1.0, 0.0):
                n = sum((j in r) == has and positive[i] == p for i, r in enumerate(rows))
                expected = sum((j in r) == has for r in rows) * (positive == p).sum() / 6
                want += 2 * n * math.log(n / expected) if n else 0.0
        assert abs(got - want) < 1e-9
