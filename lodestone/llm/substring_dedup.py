"""Substring de-duplication by restricted recompression.

Words are hashed to symbols. Each round names short runs of one symbol and pairs of a "left"
and a "right" symbol; a name is the 64-bit hash of what it stands for, so equal runs and pairs
have one name everywhere and a round needs no shuffle. Only symbols of at most a level's length
take part, so a boundary influences no more than ``context`` words, and the symbols inside of
two equal windows agree beyond that many words from either end.

Each window is anchored at its longest (then highest) inner symbol. A first exchange counts the
anchors: windows under an anchor that occurs once are unique. A second exchange brings the words
of the windows under shared anchors together: windows that a hash of their words puts together
are compared word by word, and those with a twin are repeats; the words that they cover are
removed. Names and hashes only choose what is compared: equal windows always have equal ones,
and a clash of unequal ones costs a comparison and changes no result.

Scale: exchanges carry packed arrays by bucket. Of a key a task sends two occurrences at most
and marks its others itself (windows after comparing them), so that a passage in a third of all
documents reaches its reducer twice for each task. Marks return by buckets of documents; the
exchange of the texts by these buckets serves both returns. Buckets follow
``spark.sql.shuffle.partitions``, which is to grow with the corpus (a gigabyte a partition at most).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.words import CACHE_WORDS, HashCache, hashes_of, mix64, slices, words_of

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PRIME = 2147483647
RUN = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("start", "<i4"), ("len", "<i4"), ("key", "<u8")])
EXCHANGE = "bucket int, counted boolean, k1 binary, k2 binary, start binary, len binary, key binary, words binary"
MARKS = "b int, runs binary"
BUCKETS_PER_PARTITION = 4


def levels(window: int) -> tuple[list[tuple[int, bool]], int]:
    """The rounds (longest symbol that takes part, whether runs are named) that a window allows, and the context."""
    out, context, longest, limit = [], 0, 1, 1
    for runs in [True] + [False] * 60:
        grown = context + limit * (3 if runs else 1)
        if 2 * grown + 2 * (2 * limit) - 1 > window:
            break
        out.append((limit, runs))
        context, longest = grown, 2 * limit
        if runs or out[-2][0] == limit:
            limit = longest
    return out, context


def recompress(symbols: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and lengths in words of the symbols that the rounds end with; ``first`` marks documents' first words."""
    sym, first = symbols.copy(), first.copy()
    size = np.ones(len(sym), np.int64)
    for number, (limit, runs) in enumerate(levels(window)[0]):
        if runs:
            same = np.zeros(len(sym), bool)
            same[1:] = (sym[1:] == sym[:-1]) & ~first[1:] & (size[1:] <= limit) & (size[:-1] <= limit)
            heads = np.flatnonzero(~same)
            count = np.diff(np.append(heads, len(sym)))
            short = (count > 1) & (count * size[heads] <= 2 * limit)
            keep = ~same
            # Runs that are too long stay as they are, symbol by symbol.
            keep |= np.repeat(~short, count)
            named = np.zeros(len(sym), bool)
            named[heads[short]] = True
            total = np.ones(len(sym), np.int64)
            total[heads[short]] = count[short]
            sym = np.where(named, mix64(sym * np.uint64(3) + total.astype(np.uint64)), sym)[keep]
            size, first = (size * total)[keep], first[keep]
        left = (mix64(sym + np.uint64(number + 1)) & np.uint64(1)).astype(bool)
        active = size <= limit
        pair = np.zeros(len(sym), bool)
        pair[:-1] = left[:-1] & ~left[1:] & active[:-1] & active[1:] & ~first[1:]
        second = np.zeros(len(sym), bool)
        second[1:] = pair[:-1]
        nxt = np.append(sym[1:], np.uint64(0))
        sym = np.where(pair, mix64(mix64(sym) + nxt), sym)[~second]
        size = np.where(pair, size + np.append(size[1:], 0), size)[~second]
        first = first[~second]
    return sym, size


def anchors(symbols: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, key) of each anchor; windows are named by their first word.

    ``starts`` has each document's first word and, last, the number of words.
    """
    n = len(symbols)
    first = np.zeros(n, bool)
    first[starts[:-1][starts[:-1] < n]] = True
    sym, size = recompress(symbols, first, window)
    context = levels(window)[1]
    key = (size.astype(np.uint64) << np.uint64(58)) | (sym >> np.uint64(6))
    begin = np.concatenate([[0], np.cumsum(size)])
    edge = np.zeros(n + 1, bool)
    edge[begin] = True
    before = np.concatenate([[0], np.cumsum(edge[:-1])])  # symbols that start before a word
    lengths = np.diff(starts)
    counts = np.maximum(lengths - window + 1, 0)
    at = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    if not len(at):
        return at, at, np.empty(0, np.uint64)
    lo, stop = before[at + context], at + window - context
    hi = before[stop] - ~edge[stop]
    # Sparse table of the leftmost highest key.
    table = [np.arange(len(key))]
    span = int((hi - lo).max())
    while 2 << (len(table) - 1) <= span:
        half = 1 << (len(table) - 1)
        a, b = table[-1][:-half], table[-1][half:]
        table.append(np.where(key[a] >= key[b], a, b))
    depth = np.log2(hi - lo).astype(np.int64)
    best = np.empty(len(at), np.int64)
    for d, rows in enumerate(table):
        own = np.flatnonzero(depth == d)
        if len(own):
            a, b = rows[lo[own]], rows[hi[own] - (1 << d)]
            best[own] = np.where(key[a] >= key[b], a, b)
    new = np.ones(len(at), bool)
    new[1:] = (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    return at[head], np.diff(np.append(head, len(at))), key[best[head]]


class Powers:
    """Powers of the base and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            n = max(n, 1 << 20)
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                steps = np.full(n + 1, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


class Words(dict):
    """Numbers of words as they come, and their hashes cut to some bits; equal numbers are equal words."""

    def __init__(self, bits: int = 64):
        super().__init__()
        self.shift, self.known, self.hashed = np.uint64(64 - bits), [], np.empty(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self.known)
        self.known.append(word)
        return out

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def symbols(self, numbers: np.ndarray) -> np.ndarray:
        new = self.known[len(self.hashed) :]
        if new:
            own = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
            self.hashed = np.concatenate([self.hashed, own >> self.shift])
        return self.hashed[numbers]


def confirmed(numbers: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows from the places ``a`` and those from ``b`` have the same words.

    Neighbouring windows that are paired at one distance are compared as one stretch.
    """
    if not len(a):
        return np.zeros(0, bool)
    new = np.concatenate([[True], (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(a))) + window - 1
    ends = np.cumsum(size)
    inside = np.arange(ends[-1]) - np.repeat(ends - size, size)
    differ = numbers[np.repeat(a[head], size) + inside] != numbers[np.repeat(b[head], size) + inside]
    sums = np.concatenate([[0], np.cumsum(differ)])
    at = np.arange(len(a)) + (np.cumsum(new) - 1) * (window - 1)
    return sums[at + window] == sums[at]


def _firsts(keys: np.ndarray) -> np.ndarray:
    """For each key the place of its first occurrence."""
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return first[inverse]


def twins(numbers: np.ndarray, at: np.ndarray, keys: np.ndarray, window: int) -> np.ndarray:
    """Which of the windows have the words of another of them. Equal windows have equal keys; clashing ones are told apart by words."""
    out, left = np.zeros(len(at), bool), np.arange(len(at))
    while len(left):
        first = _firsts(keys[left])
        other = np.flatnonzero(first != np.arange(len(left)))
        same = confirmed(numbers, at[left[other]], at[left[first[other]]], window)
        out[left[other[same]]] = out[left[first[other[same]]]] = True
        # Those that differ from the first of their key are compared among themselves.
        left = left[other[~same]]
    return out


def window_hashes(symbols: np.ndarray, at: np.ndarray, window: int, powers: Powers) -> np.ndarray:
    """The polynomial hash of ``window`` words from each given word."""
    up, down = powers(len(symbols))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * up[: len(symbols)], dtype=np.uint64)])
    return mix64((sums[at + window] - sums[at]) * down[at])


def _ranks(keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each one."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - head
    return out


def _shared(keys: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def _expand(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window's run, and its first word."""
    n = runs["len"].astype(np.int64)
    owner = np.repeat(np.arange(len(runs)), n)
    return owner, runs["start"][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def _recode(runs: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Runs of consecutive windows among the given ones."""
    if not len(owner):
        return np.empty(0, RUN)
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    out = runs[owner[head]].copy()
    out["start"], out["len"] = at[head], np.diff(np.append(head, len(owner)))
    return out


def document_bucket(k1: np.ndarray, buckets: int) -> np.ndarray:
    return k1 % PRIME * 48271 % PRIME % buckets


def _exchange(runs: np.ndarray, bucket: np.ndarray, counted: bool, words: list[bytes] | None) -> Iterator[pa.RecordBatch]:
    """Rows of ``EXCHANGE``; words: those of each run's windows, joined by spaces."""
    if not len(runs):
        return
    order = np.argsort(bucket, kind="stable")
    runs, bucket = runs[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    columns: list[list] = [[] for _ in range(8)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        part = runs[a:b]
        row = [int(bucket[a]), counted, *(np.ascontiguousarray(part[f]).tobytes() for f in RUN.names)]
        # Words are most of what is exchanged; the shuffle's own codec packs text less well.
        row.append(zstandard.compress(b" ".join([words[i] for i in order[a:b].tolist()]), 1) if words is not None else b"")
        for column, value in zip(columns, row):
            column.append(value)
    kinds = [pa.int32(), pa.bool_()] + [pa.binary()] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in EXCHANGE.split(", ")])


def _received(table: pa.Table) -> Iterator[tuple[bool, np.ndarray, bytes]]:
    for batch in table.to_batches():
        cols = {name: batch.column(name) for name in batch.schema.names}
        for i in range(batch.num_rows):
            parts = {f: np.frombuffer(cols[f][i].as_buffer(), RUN[f]) for f in RUN.names}
            runs = np.empty(len(parts["k1"]), RUN)
            for f in RUN.names:
                runs[f] = parts[f]
            yield cols["counted"][i].as_py(), runs, cols["words"][i].as_py()


def _marks(runs: np.ndarray, buckets: int) -> pa.Table:
    b = document_bucket(runs["k1"], buckets)
    order = np.argsort(b, kind="stable")
    runs, b = runs[order], b[order]
    cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, np.int64)
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    return pa.table(
        {"b": pa.array([int(b[x]) for x, _ in spans], pa.int32()), "runs": pa.array([runs[x:y].tobytes() for x, y in spans], pa.binary())}
    )


def _by_document(table: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    parts = [np.frombuffer(x.as_buffer(), RUN) for x in table.column("runs")]
    if not parts:
        return {}
    runs = np.concatenate(parts)
    runs = runs[np.lexsort((runs["start"], runs["k2"], runs["k1"]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs["k1"][1:] != runs["k1"][:-1]) | (runs["k2"][1:] != runs["k2"][:-1])
    cuts = np.append(np.flatnonzero(new), len(runs)).tolist()
    return {(int(runs["k1"][a]), int(runs["k2"][a])): runs[a:b] for a, b in zip(cuts[:-1], cuts[1:])}


def _same_rows(ids: list, keys: list[tuple], texts: list) -> None:
    """Rows are told apart by a 128-bit hash of id and text; rows that share it must be equal."""
    seen: dict[tuple, tuple] = {}
    for key, *row in zip(keys, ids, texts):
        if seen.setdefault(key, row) != row:
            raise ValueError(f"two rows have one hash: {row[0]!r}, {seen[key][0]!r}")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, hash_bits: int = 64) -> DataFrame:
    """One row per document: id, ``text`` (kept words joined by one space), ``n_words``, ``n_removed``, ``removed``.

    ``removed`` lists the removed stretches as (start, end) in words, end exclusive. A word
    goes if a window of ``window`` words of its document covers it and the same words start
    at any other place of any document; windows are judged on the input. Null and empty texts
    have no words. Repeated rows repeat each other; a null id is an id like others. Other
    columns are ignored; an empty table gives an empty result. Windows are equal if all their
    words are; ``hash_bits`` of the words' hashes choose what is compared, and the result is the
    same for any number of them.
    """
    spark: SparkSession = docs.sparkSession
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"),
        F.xxhash64(F.lit(9), F.col(text_col), F.col(id_col)).alias("k2"),
        F.col(text_col).alias("text"),
    ).withColumn("b", F.expr(f"cast(pmod(k1, {PRIME}) * 48271 % {PRIME} % {buckets} as int)"))
    shift = np.uint64(64 - hash_bits)

    def reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in slices(batches, "text"):
            lists = [words_of(t, False) for t in batch.column("text").to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            symbols = np.concatenate([hashes_of(x, cache) for x in lists]) >> shift if lists else np.empty(0, np.uint64)
            del lists
            at, count, key = anchors(symbols, starts, window)
            owner = np.searchsorted(starts, at, "right") - 1
            runs = np.empty(len(at), RUN)
            runs["k1"], runs["k2"] = (batch.column(c).to_numpy()[owner] for c in ("k1", "k2"))
            runs["start"], runs["len"], runs["key"] = at - starts[owner], count, key
            send = _ranks(key) < 2
            yield from _exchange(runs[send], (mix64(key[send]) % np.uint64(buckets)).astype(np.int64), True, None)
            rest = runs[~send]
            yield from _exchange(rest, document_bucket(rest["k1"], buckets), False, None)

    def shared_anchors(table: pa.Table) -> pa.Table:
        counted, marked = [], []
        for count, runs, _ in _received(table):
            (counted if count else marked).append(runs)
        if counted:
            runs = np.concatenate(counted)
            marked.append(runs[_shared(runs["key"])])
        return _marks(np.concatenate(marked), buckets)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found, out = _by_document(right), []
        words, powers = Words(hash_bits), Powers()
        if found:
            for batch in slices(iter(left.to_batches()), "text"):
                if len(words.known) > CACHE_WORDS:
                    words = Words(hash_bits)
                parts, at, texts, place = [], [], [], 0
                for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text"))):
                    runs = found.get((k1, k2))
                    if runs is None:
                        continue
                    # Repeated rows pool their marks: each mark counts once for each row.
                    runs = runs[np.unique(runs["start"], return_index=True)[1]]
                    parts.append(runs)
                    texts += words_of(text, False)
                    at.append(_expand(runs)[1] + place)
                    place = len(texts)
                if not parts:
                    continue
                runs, at = np.concatenate(parts), np.concatenate(at)
                numbers = words.numbers(texts)
                # Words follow each other across documents, but no window does.
                keys = window_hashes(words.symbols(numbers), at, window, powers)
                owner, start = _expand(runs)
                rank = _ranks(keys)
                rest, first = np.flatnonzero(rank > 1), _firsts(keys)
                same = rest[confirmed(numbers, at[rest], at[first[rest]], window)]
                send = np.ones(len(at), bool)
                send[same] = False
                # The first one has a twin here, whether or not the second one sent is its equal.
                known = ~send
                known[first[same]] = True
                some = _recode(runs, owner[send], start[send])
                # A document's first word among all: a window's place less its start.
                n = some["len"].astype(np.int64)
                heads = at[send][np.cumsum(n) - n]
                own = [b" ".join(texts[i : i + m + window - 1]) for i, m in zip(heads.tolist(), n.tolist())]
                out += _exchange(some, (mix64(some["key"]) % np.uint64(buckets)).astype(np.int64), True, own)
                rest = _recode(runs, owner[known], start[known])
                out += _exchange(rest, document_bucket(rest["k1"], buckets), False, None)
        return pa.Table.from_batches(out, pa.schema([(x.split()[0], {"int": pa.int32(), "boolean": pa.bool_()}.get(x.split()[1], pa.binary())) for x in EXCHANGE.split(", ")]))

    def shared_windows(table: pa.Table) -> pa.Table:
        counted, numbers, marked = [], [], []
        words, powers = Words(hash_bits), Powers()
        for count, runs, own in _received(table):
            if count:
                counted.append(runs)
                numbers.append(words.numbers(zstandard.decompress(own).split(b" ")))
            else:
                marked.append(runs)
        if counted:
            runs, numbers = np.concatenate(counted), np.concatenate(numbers)
            owner, start = _expand(runs)
            # A run's words follow those of the runs before it.
            size = runs["len"].astype(np.int64) + window - 1
            at = (np.cumsum(size) - size)[owner] + start - runs["start"][owner]
            twin = twins(numbers, at, window_hashes(words.symbols(numbers), at, window, powers), window)
            marked.append(_recode(runs, owner[twin], start[twin]))
        return _marks(np.concatenate(marked), buckets)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        found, rows = _by_document(right), []
        _same_rows(left.column("id").to_pylist(), list(zip(left.column("k1").to_pylist(), left.column("k2").to_pylist())), left.column("text").to_pylist())
        for doc_id, k1, k2, text in zip(*(left.column(c).to_pylist() for c in ("id", "k1", "k2", "text"))):
            words = words_of(text, False)
            runs = found.get((k1, k2))
            spans: list[dict] = []
            total = len(words)
            if runs is not None:
                end = np.maximum.accumulate(runs["start"] + runs["len"] + window - 1)
                new = np.concatenate([[True], runs["start"][1:] > end[:-1]])
                head = np.flatnonzero(new)
                spans = [
                    {"start": int(runs["start"][a]), "end": int(end[b - 1])}
                    for a, b in zip(head.tolist(), [*head[1:].tolist(), len(runs)])
                ]
                for span in reversed(spans):
                    del words[span["start"] : span["end"]]
            rows.append((doc_id, b" ".join(words).decode("utf-8", "surrogatepass"), total, total - len(words), spans))
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.table(
            {
                "id": pa.array(cols[0], left.schema.field("id").type),
                "text": pa.array(cols[1], pa.string()),
                "n_words": pa.array(cols[2], pa.int64()),
                "n_removed": pa.array(cols[3], pa.int64()),
                "removed": pa.array(cols[4], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            }
        )

    kind = keyed.schema["id"].dataType.simpleString()
    shared = keyed.select("k1", "k2", "text").mapInArrow(reveal, EXCHANGE).groupBy("bucket").applyInArrow(shared_anchors, MARKS)
    windows = (
        keyed.groupBy("b").cogroup(shared.groupBy("b")).applyInArrow(compare, EXCHANGE).groupBy("bucket").applyInArrow(shared_windows, MARKS)
    )
    out = keyed.groupBy("b").cogroup(windows.groupBy("b")).applyInArrow(
        remove, f"id {kind}, text string, n_words long, n_removed long, removed array<struct<start:int,end:int>>"
    )
    return out.withColumnRenamed("id", id_col)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
s AS (SELECT doc_id, i FROM p WHERE win IN (SELECT win FROM p GROUP BY win HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM s)),
v AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
k AS (
  SELECT v.doc_id, count(c.j) AS n_removed, string_agg(CASE WHEN c.j IS NULL THEN word END, ' ' ORDER BY v.j) AS kept
  FROM v LEFT JOIN c ON v.doc_id = c.doc_id AND v.j = c.j GROUP BY v.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
