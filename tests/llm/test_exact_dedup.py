import hashlib
import re
from collections import defaultdict

from lodestone.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        for r in members:
            out.append((r["doc_id"], best["doc_id"], len(members), r is best, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(docs):
    assert sorted(map(tuple, exact_dedup(docs).collect()), key=str) == brute(docs.collect())


def test_odd_rows(odd):
    got = exact_dedup(odd, first_digit=4, growth=3)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(odd.collect())


def test_empty(empty):
    assert exact_dedup(empty).count() == 0


def test_one_row_of_each_class_is_kept(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "ab"), (None, "c"), (None, "c"), (2, None), (3, ""), (None, "x" * 500), (None, "x" * 500), (4, "x" * 501)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), first_digit=2, growth=2).collect()
    assert len(got) == len(rows)
    kept = [r for r in got if r["kept"]]
    assert sorted(r["text_sha256"] for r in kept) == sorted({r["text_sha256"] for r in got})
    assert all(r["keep_id"] == r["doc_id"] for r in kept)
