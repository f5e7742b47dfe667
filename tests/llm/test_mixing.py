import re
from collections import defaultdict

import pytest

from lodestone.llm.mixing import mix_sources, targets


def test_targets_share_all_and_respect_the_limit():
    sizes = [10, 1000, 10, 5, 0]
    goal = targets(sizes)
    assert sum(goal) == pytest.approx(1025)
    assert goal[0] == 30 and goal[2] == 30 and goal[4] == 0
    assert all(g <= 3 * s + 1e-9 for g, s in zip(goal, sizes))


def test_mix_on_documents(docs):
    rows = mix_sources(docs).collect()
    again = {r["doc_id"]: r["taken"] for r in mix_sources(docs.repartition(5)).collect()}
    text = {r["doc_id"]: r for r in docs.collect()}
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]]["text"]))
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert again[r["doc_id"]] == r["taken"]
        x = by[text[r["doc_id"]]["source"]]
        x[0] += r["size"]
        x[1] += r["taken"]
        x[2] = r["target"]
        assert x[0] <= r["source_size"]
    names = sorted(by)
    assert [by[n][2] for n in names] == pytest.approx(targets([by[n][0] for n in names]))
    for n in names:
        assert abs(by[n][1] - by[n][2]) <= 0.01 * by[n][2] + 64


def test_odd_rows(odd, empty):
    rows = mix_sources(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sum(r["size"] == 0 for r in rows) == 3
    assert mix_sources(empty).count() == 0


def test_repeated_rows_without_words(spark):
    rows = [(1, "", "x"), (1, "", "x"), (None, None, "x"), (None, " ", "x"), (2, "a few words", "x"), (2, "a few words", "x")]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 3), (2, 3)]
    assert all(r["taken"] == 0 for r in got if not r["size"])


def brute(spark, docs, block_words):
    """The mix by walking the schedule slot by slot."""
    from pyspark.sql import functions as F

    rows = [(r["h"], r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in docs.withColumn("h", F.xxhash64(F.lit(17), "doc_id", "text")).collect()]
    names = sorted({r[2] for r in rows}, key=lambda n: (n is None, n or ""))
    size = {n: sum(r[3] for r in rows if r[2] == n) for n in names}
    goal = dict(zip(names, targets([size[n] for n in names])))
    blocks = {n: max(1, round(size[n] / block_words)) if size[n] else 0 for n in names}
    weight = [goal[n] * blocks[n] / size[n] if size[n] else 0 for n in names]
    cuts = [round(sum(weight[: i + 1]) / sum(weight) * 2**31) for i in range(len(names))]
    rank = dict.fromkeys(names, 0)
    times = {n: [0] * blocks[n] for n in names}
    for slot in range(round(sum(weight))):
        point = slot * 1327217885 % 2**31
        name = next(n for n, c in zip(names, cuts) if point < c)
        if rank[name] < 3 * blocks[name]:
            times[name][rank[name] % blocks[name]] += 1
            rank[name] += 1
    out = []
    for n in names:
        block_of = [b for b in range(blocks[n]) for _ in range(size[n] // blocks[n] + (b < size[n] % blocks[n]))]
        at = 0
        # Buckets are the upper bits of the hash as an unsigned number.
        for h, doc_id, _, words in sorted((r for r in rows if r[2] == n), key=lambda r: ((r[0] & (2**64 - 1)) >> 48, r[0], r[1] is not None, r[1] or 0, r[3])):
            out.append((doc_id, words, size[n], round(goal[n], 6), sum(times[n][b] for b in block_of[at : at + words])))
            at += words
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [1, 7, 64])
def test_schedule_against_brute_force(spark, odd, docs, block_words):
    for frame in (odd.select("doc_id", "text", "source"), docs.select("doc_id", "text", "source").limit(400)):
        frame = spark.createDataFrame(frame.collect(), "doc_id long, text string, source string")
        got = mix_sources(frame.select("doc_id", "text", "source"), block_words=block_words).collect()
        assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got), key=str) == brute(spark, frame, block_words)
