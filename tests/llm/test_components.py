import random

from lodestone.llm.components import components
from lodestone.operators.staging import Stage


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {x: find(x) for x in root}


def run(spark, links, known=None):
    frame = components(spark.createDataFrame(links, "a long, b long"), Stage(spark, "test"), known)
    rows = frame.collect()
    out = {r["id"]: r["comp"] for r in rows}
    assert len(out) == len(rows)
    return frame, out


def test_chains_stars_repeats_and_loops(spark):
    rng = random.Random(5)
    chain = list(range(60))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(100, x) for x in range(101, 140)] * 2 + [(200, 200)] + [(300, 301), (301, 300)]
    assert run(spark, links)[1] == brute(links)


def test_known_components_are_joined(spark):
    rng = random.Random(7)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(50)]
    more = [(rng.randrange(120), rng.randrange(120)) for _ in range(25)]
    known, first = run(spark, links)
    assert first == brute(links)
    assert run(spark, more, known)[1] == brute(links + more)
    assert run(spark, [], known)[1] == first


def test_no_links(spark):
    assert run(spark, [])[1] == {}
