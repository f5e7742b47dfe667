import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from lodestone.llm.mixing import targets
from tests.llm.test_ngram_join import brute as components

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, docs):
    """Each stage's input and result."""
    out = []
    for name, function in pipeline.STAGES:
        got = function(spark, docs, SF).cache()
        out.append((name, docs, got))
        docs = got
    return out


def test_columns_and_names(stages):
    assert [s[0] for s in stages] == ["language_id", "near_duplicates", "decontamination", "source_mixing", "token_output"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_language_id_keeps_texts_with_words_of_a_language(stages):
    _, before, after = stages[0]
    kept = {r["doc_id"] for r in after.collect()}
    gone = [r for r in before.collect() if r["doc_id"] not in kept]
    assert len(gone) <= 0.02 * before.count()


def test_near_duplicates(stages):
    _, before, after = stages[1]
    want = {i for i, _, c, _ in components(before.collect(), 5, 80, 100) if i == c}
    assert {r["doc_id"] for r in after.collect()} == want


def test_decontamination(spark, stages):
    _, before, after = stages[2]
    squeeze = lambda s: " ".join(s.lower().split())
    items = [squeeze(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r["doc_id"] for r in before.collect() if not any(x in squeeze(r["text"]) for x in items)}
    assert {r["doc_id"] for r in after.collect()} == want != {r["doc_id"] for r in before.collect()}


def test_source_mixing(stages):
    _, before, after = stages[3]
    rows = {r["doc_id"]: r for r in before.collect()}
    size = {i: len((r["text"] or "").encode().split()) for i, r in rows.items()}
    names = sorted({r["source"] for r in rows.values()})
    have = [sum(size[i] for i, r in rows.items() if r["source"] == n) for n in names]
    goal = dict(zip(names, targets(have)))
    times = Counter(r["doc_id"] for r in after.collect())
    assert set(times) <= set(rows) and max(times.values()) <= 3
    words = defaultdict(int)
    for i, n in times.items():
        words[rows[i]["source"]] += n * size[i]
    for n in names:
        assert abs(words[n] - goal[n]) < 0.25 * goal[n] + max(size.values())


def test_token_output(stages):
    _, before, after = stages[4]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for r in sorted(before.collect(), key=lambda r: r["doc_id"]):
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, after.collect())) == sorted(want)


def test_run_equals_its_stages(spark, stages):
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][2].collect()))


def test_odd_and_empty_documents(spark, odd, empty):
    clash = odd.select("doc_id", "text", "lang", "source", *[F.lit("kept").alias(n) for n in ("score", "lang_pred", "mix_id", "mix_copy", "mix_times", "id", "row", "n_row", "known", "n_group", "size", "taken")])
    for docs in (clash, empty):
        for _, function in pipeline.STAGES[:-1]:
            columns, docs = docs.columns, function(spark, docs, SF).cache()
            assert docs.columns == columns
            assert docs is not clash and {r["score"] for r in docs.collect()} == {"kept"} if "score" in columns else docs.count() == 0
        assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    near = "one two three four five six seven eight nine ten " * 3
    rows = [(5, near), (5, near), (None, near), (None, near), (3, near + "eleven"), (None, "alone " * 9), (8, "pair " + "x y z w v " * 4), (8, "pair " + "x y z w v " * 4),
            (None, None), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, pipeline.near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == sorted([(3, near + "eleven"), (None, "alone " * 9), (8, "pair " + "x y z w v " * 4), (None, None), (None, None), (9, ""), (9, "")], key=str)


def test_rows_without_id_are_mixed_each_on_its_own(spark):
    rows = [(None, "w " * n, "a") for n in range(1, 60)] + [(1, "v " * 5, "b"), (1, "v " * 300, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = Counter((r["doc_id"], len(r["text"].split()), r["source"]) for r in pipeline.source_mixing(spark, docs, SF).collect())
    assert max(times.values()) <= 3
    words = sum(n * size for (_, size, source), n in times.items() if source == "a")
    goal = targets([sum(range(1, 60)), 305])[0]
    assert abs(words - goal) < 0.25 * goal + 60


def test_language_id_rejects_a_language_that_was_not_learnt(spark):
    rows = [(i, "the cat sat on the mat and looked", "en") for i in range(9)] + [(20 + i, "le chat est sur le tapis", "fr") for i in range(3)]
    rows += [(50, "αυτό είναι ένα κείμενο", None), (51, "the mat", None), (52, "½ 123", None), (53, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in pipeline.language_id(spark, docs, SF).collect()} == {*range(9), 20, 21, 22, 51}


def test_many_rows_meet_without_a_broadcast(spark, stages, monkeypatch):
    monkeypatch.setattr(pipeline, "BROADCAST_ROWS", 0)
    for (name, before, after), (_, function) in list(zip(stages, pipeline.STAGES))[1:4:2]:
        assert Counter(r["doc_id"] for r in function(spark, before, SF).collect()) == Counter(r["doc_id"] for r in after.collect()), name
