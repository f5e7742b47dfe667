import random
import string

import numpy as np

from lodestone.llm import decontaminate
from lodestone.llm.decontaminate import Matcher, align, drop_contaminated, edit_budget, find_contamination, normalised, op7_decontamination


def test_finds_all_exact_passages(spark, docs):
    sf = "/root/testdata/sf0.01"
    squeeze = lambda s: " ".join(s.lower().split())
    items = [(r["item_id"], squeeze(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items if x in squeeze(t)}
    got = op7_decontamination(spark, sf).collect()
    exact = {(r["doc_id"], r["item_id"]) for r in got if r["edits"] == 0}
    assert exact == want and want
    by = dict(items)
    for r in got:
        if r["edits"] == 0:
            assert squeeze(texts[r["doc_id"]][r["start"] : r["end"]]) == by[r["item_id"]]


def brute_edits(a, b):
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edited_passages():
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices(string.ascii_lowercase[:12] + "é", k=rng.randint(2, 8))) for _ in range(n))
    items = [(i, words(rng.randint(12, 50))) for i in range(20)]
    match = Matcher(items)
    for i, text in items:
        k = edit_budget(len(text), 0.1)
        chars = list(text)
        for _ in range(k):
            at, what = rng.randrange(len(chars)), rng.randrange(3)
            if what == 0:
                chars[at] = rng.choice("xyz")
            elif what == 1:
                chars.insert(at, "q")
            else:
                del chars[at]
        body = words(300) + " \n " + "".join(chars).upper() + "\t" + words(200)
        found = {x[1]: x[1:] for x in match([words(50), body, words(40)])}
        assert i in found, (i, k)
        want = brute_edits(text, "".join(map(chr, normalised(body)[0])))
        assert found[i][3] == want <= k
        assert not match([words(600), words(3)])


def test_align_on_small_cases():
    code = lambda s: np.array([ord(c) for c in s], np.uint32)
    assert align(code("abcdef"), code("xxabcdefyy"), 2) == (0, 2, 8)
    assert align(code("abcdef"), code("xxabXdefyy"), 2)[0] == 1
    assert align(code("abcdef"), code("zzzzzz"), 2) is None


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame(
        [(1, "the same long LINE the same  long line"), (2, None), (3, ""), (4, "hunter"), (5, "hunter22"), (6, "é")],
        "item_id long, text string",
    )
    got = sorted((r["doc_id"], r["item_id"]) for r in find_contamination(odd, bench).collect())
    assert got == [(6, 5), (6, 6), (10, 1), (11, 1)]
    kept = drop_contaminated(odd, bench)
    assert kept.schema == odd.schema and kept.count() == odd.count() - 3
    assert find_contamination(empty, bench).count() == 0
    assert find_contamination(odd, bench.limit(0)).count() == 0


def brute_bands(match, raw):
    """Half bands by listing all pairs of equal q-grams, then bands that reach the bound."""
    from collections import Counter

    text = [raw[i : i + 8] for i in range(len(raw) - 7)]
    out = set()
    for number, points in enumerate(match.points):
        own = decontaminate.fold(points)
        width = int(match.k[number]) + 1
        halves = Counter((i - j) // width for j in range(len(own) - 7) for i, x in enumerate(text) if x == own[j : j + 8])
        for half in {h for b in halves for h in (b, b - 1)}:
            if halves[half] + halves[half + 1] >= match.need[number]:
                out.add((number, half))
    return out


def test_bands_against_brute_force(monkeypatch):
    """Listed in small slices, convolved in small windows, or both: always the same bands."""
    rng = random.Random(11)
    items = [(0, "-" * 120), (1, "ab" * 50), (2, "a" * 40 + "b" * 40), (3, "".join(rng.choices("ab", k=90))), (4, "abcdefgh" * 9), (5, "x" * 9)]
    match = Matcher(items)
    raw = ("-" * 200 + "ab" * 80 + "\n" + "a" * 90 + "b" * 60 + "".join(rng.choices("ab", k=200)) + "abcdefgh" * 12 + items[3][1] + "x" * 30).encode()
    want = brute_bands(match, raw)
    assert {i for i, _ in want} == set(range(6))
    for slice_, dense, window in ((1 << 21, 1 << 21, 1 << 20), (50, 1 << 21, 64), (1 << 21, 1, 64), (64, 300, 33), (50, 1, 1 << 20)):
        for name, value in (("SLICE", slice_), ("DENSE", dense), ("WINDOW", window)):
            monkeypatch.setattr(decontaminate, name, value)
        assert set(zip(*(x.tolist() for x in match.bands(raw)))) == want


def test_a_long_run_of_one_character_stays_small():
    import time
    import tracemalloc

    match = Matcher([(1, "-" * 10_000), (2, "the quick brown fox jumps over the lazy dog " * 3)])
    tracemalloc.start()
    began = time.time()
    found = match(["-" * 1_000_000, "x" * 1000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x[:2] for x in found] == [(0, 1)] and found[0][4] == 0
    assert peak < 500 << 20 and time.time() - began < 60


def test_edited_items_in_a_table(spark):
    """Found exactly where the fewest edits of any part of the text are within the budget."""
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8))) for _ in range(n))
    items = [(i, words(rng.randint(20, 30))) for i in range(6)]
    texts = []
    for d in range(40):
        chars = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, len(chars) // 6)):
            chars[rng.randrange(len(chars))] = "#"
        texts.append((d, words(rng.randint(0, 30)) + " " + "".join(chars) + " " + words(rng.randint(0, 30))))
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in find_contamination(
        spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in texts:
        for i, x in items:
            edits = brute_edits(x, "".join(map(chr, normalised(t)[0])))
            if edits <= edit_budget(len(x), 0.1):
                want[d, i] = edits
    assert got == want and 5 < len(want) < 40
