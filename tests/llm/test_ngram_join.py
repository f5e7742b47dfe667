import random
from itertools import combinations

import pytest

import lodestone.llm.ngram_join as module
from lodestone.llm.ngram_join import op2_ngram_join, similar_documents


def grams(text, n):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(rows, n, num, den):
    sets = [grams(r["text"], n) for r in rows]
    ids = [r["doc_id"] for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {p for m in by.values() for p in combinations(m, 2)}
    links = [0] * len(rows)
    for i, j in pairs:
        if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
            links[i] += 1
            links[j] += 1
    for i, j in combinations(range(len(rows)), 2):
        if ids[i] is not None and ids[i] == ids[j] and sets[i] and sets[j]:
            root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return sorted(((ids[i], len(sets[i]), least.get(find(i)) if sets[i] else ids[i], links[i]) for i in range(len(rows))), key=str)


def test_matches_brute_force(spark, docs):
    got = sorted(map(tuple, op2_ngram_join(spark, "/root/testdata/sf0.01").collect()), key=str)
    want = brute(docs.collect(), 4, 85, 100)
    assert any(w[0] != w[2] for w in want)
    assert got == want


def test_odd_rows(odd, empty):
    got = sorted(map(tuple, similar_documents(odd).collect()), key=str)
    assert got == brute(odd.collect(), 5, 80, 100)
    assert similar_documents(empty).count() == 0


@pytest.mark.parametrize("n, share", [(4, (85, 100)), (2, (50, 100))])
def test_chains_and_crowds(spark, monkeypatch, n, share):
    """Chains whose ends differ, a crowd of near copies, and one passage that all share."""
    monkeypatch.setattr(module, "BLOCK", 20)
    monkeypatch.setattr(module, "STAR", 16)
    rng = random.Random(n)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 40))
    common = [word() for _ in range(12)]
    rows = []
    for c in range(12):
        text = [word() for _ in range(rng.randint(10, 80))]
        for _ in range(rng.randint(1, 12)):
            rows.append((len(rows), " ".join(text + common)))
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
    base = [word() for _ in range(60)]
    for _ in range(80):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = word()
        rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, similar_documents(frame, n=n, share=share).collect()), key=str) == brute(frame.collect(), n, *share)
