"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters that occurs in a text with at most k edits shares at least
m + 1 - q (k + 1) of its q-grams with it, all on k + 1 neighbouring diagonals (text position
less item position). Shared q-grams are counted in diagonal bands of twice that width that
overlap by half, so that any k + 1 diagonals lie in one band; bands that reach the bound are
verified by banded alignment.

Texts are compared in lower case with each run of white space as one space. The q-grams are of
characters folded to a byte each; folding can only add candidates.

Of a q-gram that text and item have very often (runs of one character, short periods) the pairs
of places are not listed: their diagonals are counted by a convolution, window by window; other
pairs are listed ``SLICE`` at a time and added up by band.

An item is found where all of it lies in a text, but for the edits allowed: a tenth of its
characters, fewer in items of under about 75 characters, where the lemma would ask for no shared
q-gram otherwise, none in items of under ``2 q - 1``.

Scale: items come in blocks of at most ``BLOCK_CHARACTERS``, each broadcast and matched against
all documents in one narrow pass, so no document is shuffled and no broadcast grows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.words import slices, tidy

Q = 8
#: Edits allowed for each character of an item.
EDIT_SHARE = 0.1
BLOCK_CHARACTERS = 4_000_000
TABLE_BITS = 22
#: Pairs of places listed at a time; pairs of one q-gram and item from which on they are convolved; places in a window.
SLICE = 1 << 21
DENSE = 1 << 21
WINDOW = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: White space, as ``str.split`` has it.
SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def lowered(text: str) -> str:
    """Lower case, character by character where lower case has another length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points with white space as single spaces, and each one's place in the text."""
    points = np.frombuffer(lowered(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.isin(points, SPACES)
    keep = np.ones(len(points), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return np.where(space, np.uint32(32), points)[keep], np.flatnonzero(keep)


def fold(points: np.ndarray) -> bytes:
    return (points ^ (points >> np.uint32(7)) * np.uint32(37)).astype(np.uint8).tobytes()


#: ``fold`` of the characters that Latin-1 has.
FOLD_LATIN = fold(np.arange(256, dtype=np.uint32))


def folded(text: str) -> bytes:
    """The normalised text without outer spaces, a byte for each character."""
    text = " ".join(lowered(text).split())
    try:
        return text.encode("latin-1").translate(FOLD_LATIN)
    except UnicodeEncodeError:
        return fold(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))


def codes_of(raw: bytes) -> np.ndarray:
    """One number for each q-gram: its q characters, a byte each."""
    return np.ndarray((len(raw) - Q + 1,), "<u8", raw, strides=(1,)) if len(raw) >= Q else np.empty(0, np.uint64)


def slot(g: np.ndarray) -> np.ndarray:
    return (g * MULTIPLIER) >> np.uint64(64 - TABLE_BITS)


def edit_budget(m: int, share: float) -> int:
    """Edits allowed in an item of m characters: the share, or fewer where the lemma would ask for no shared q-gram."""
    k = int(share * m)
    while k > 0 and m + 1 - Q * (k + 1) < Q:
        k -= 1
    return k


def align(item: np.ndarray, region: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """Fewest edits of the item against any part of the region, with start and end; None above k.

    Rows of the alignment matrix; a row's insertions are a running minimum.
    """

    def best_end(a: np.ndarray, b: np.ndarray, free_start: bool) -> tuple[int, int]:
        at = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free_start else at.copy()
        for i, c in enumerate(a, 1):
            new = np.empty_like(row)
            new[0] = i
            new[1:] = np.minimum(row[:-1] + (b != c), row[1:] + 1)
            row = np.minimum.accumulate(new - at) + at
            if row.min() > k:
                return k + 1, 0
        end = int(np.argmin(row))
        return int(row[end]), end

    edits, end = best_end(item, region, True)
    if edits > k:
        return None
    low = max(0, end - len(item) - k)
    back = region[low:end][::-1]
    _, length = best_end(item[::-1], back, False)
    return edits, end - length, end


class Tally:
    """Counts by key, kept small by adding up equal keys."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        keys, inverse, own = np.unique(keys, return_inverse=True, return_counts=True)
        if counts is not None:
            own = np.bincount(inverse, counts, len(keys)).astype(np.int64)
        self.parts.append((keys, own))
        self.held += len(keys)
        if self.held > 2 * SLICE and len(self.parts) > 1:
            self.parts = [self.total()]
            # Distinct keys stay; the next sum waits until as many again have come.
            self.held = max(0, len(self.parts[0][0]) - SLICE)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, inverse = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([c for _, c in self.parts]), len(keys)).astype(np.int64)


def diagonals(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The differences a - b of two sets of places, and how often each one occurs, by a convolution."""
    left, right = np.zeros(int(a.max() - a.min()) + 1), np.zeros(int(b.max() - b.min()) + 1)
    left[a - a.min()] = 1
    right[b.max() - b] = 1
    size = len(left) + len(right) - 1
    full = 1 << (size - 1).bit_length()
    counts = np.rint(np.fft.irfft(np.fft.rfft(left, full) * np.fft.rfft(right, full), full)[:size]).astype(np.int64)
    at = np.flatnonzero(counts)
    return at + int(a.min()) - int(b.max()), counts[at]


def windows(x: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted places in parts that each span ``WINDOW`` at most."""
    while len(x):
        end = int(np.searchsorted(x, x[0] + WINDOW))
        yield x[:end]
        x = x[end:]


class Matcher:
    """The q-gram index of one block of items."""

    def __init__(self, items: list[tuple], share: float = EDIT_SHARE):
        self.ids, self.points, self.k, self.need = [], [], [], []
        self.short: list[tuple] = []
        codes, owner, place = [], [], []
        for item_id, text in items:
            points, _ = normalised((text or "").strip())
            if len(points) < Q:
                if len(points):
                    self.short.append((item_id, points))
                continue
            k = edit_budget(len(points), share)
            codes.append(codes_of(fold(points)))
            owner.append(np.full(len(codes[-1]), len(self.ids)))
            place.append(np.arange(len(codes[-1])))
            self.ids.append(item_id)
            self.points.append(points)
            self.k.append(k)
            self.need.append(len(points) + 1 - Q * (k + 1))
        flat = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.codes = flat[order]
        self.owner = (np.concatenate(owner) if owner else np.empty(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.empty(0, np.int64))[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[slot(self.codes)] = True
        self.k, self.need = np.array(self.k, np.int64), np.array(self.need, np.int64)

    def bands(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Items and numbers of the bands with enough shared q-grams: band b has the diagonals [b w, (b + 2) w), w = k + 1."""
        code = codes_of(raw)
        hit = np.flatnonzero(self.table[slot(code)]) if len(self.codes) else np.empty(0, np.int64)
        found = code[hit]
        lo = np.searchsorted(self.codes, found, "left")
        n = np.searchsorted(self.codes, found, "right") - lo
        hit, found, lo, n = (x[n > 0] for x in (hit, found, lo, n))
        tally = Tally()
        _, which, times = np.unique(found, return_inverse=True, return_counts=True)
        dense = times[which] * n >= DENSE
        # Half bands are counted once and added to their neighbour; the gap keeps items apart.
        key = lambda item, diagonal: (item << 40) + np.floor_divide(diagonal, self.k[item] + 1) + (1 << 32)
        for a, size, place in self._slices(lo[~dense], n[~dense], hit[~dense]):
            at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
            tally.add(key(self.owner[at], np.repeat(place, size) - self.place[at]))
        order = np.flatnonzero(dense)[np.argsort(which[dense], kind="stable")]
        cuts = np.flatnonzero(np.concatenate([[True], which[order][1:] != which[order][:-1], [True]])) if len(order) else np.zeros(1, np.int64)
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            places, first, size = hit[order[x:y]], int(lo[order[x]]), int(n[order[x]])
            owners = self.owner[first : first + size]
            # Postings of a code are in the order of items, then places.
            heads = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1], [True]]))
            for c, d in zip(heads[:-1].tolist(), heads[1:].tolist()):
                item, own = int(owners[c]), self.place[first + c : first + d]
                if len(places) * len(own) < DENSE:
                    step = max(1, SLICE // len(own))
                    for i in range(0, len(places), step):
                        far = (places[i : i + step, None] - own[None, :]).ravel()
                        tally.add(key(np.full(len(far), item), far))
                    continue
                for a in windows(places):
                    for b in windows(own):
                        far, counts = diagonals(a, b)
                        tally.add(key(np.full(len(far), item), far), counts)
        keys, counts = tally.total()
        both = np.concatenate([keys, keys - 1])
        sums = np.concatenate([counts, np.zeros_like(counts)])
        place = np.searchsorted(keys, both + 1)
        place[place == len(keys)] = 0
        if len(keys):
            sums = sums + np.where(keys[place] == both + 1, counts[place], 0)
        kept = np.unique(both[sums >= self.need[both >> 40]]) if len(keys) else both
        return kept >> 40, (kept & ((1 << 40) - 1)) - (1 << 32)

    @staticmethod
    def _slices(lo: np.ndarray, n: np.ndarray, hit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The hits in parts of about ``SLICE`` pairs, one hit at least."""
        ends, start = np.cumsum(n), 0
        while start < len(n):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
            yield lo[start:stop], n[start:stop], hit[start:stop]
            start = stop

    def __call__(self, texts: list[str]) -> list[tuple]:
        """(number of the text, item id, start, end, edits) of the best place of each item in each text; places in code points."""
        parts = [folded(t) for t in texts]
        starts = np.cumsum([0] + [len(p) + 1 for p in parts])
        todo: dict[int, list] = {}
        for item, band in zip(*(x.tolist() for x in self.bands(b"\n".join(parts)))):
            own, k = self.points[item], int(self.k[item])
            low, high = band * (k + 1) - k, (band + 2) * (k + 1) + len(own) + k
            first = max(0, int(np.searchsorted(starts, max(low, 0), "right")) - 1)
            while first < len(texts) and starts[first] < high:
                todo.setdefault(first, []).append((item, low - int(starts[first]), high - int(starts[first])))
                first += 1
        for _, short in self.short:
            want = fold(short)
            for i, part in enumerate(parts):
                if want in part:
                    todo.setdefault(i, [])
        return [(i, *x) for i in sorted(todo) for x in self._verify(texts[i], todo[i])]

    def _verify(self, text: str, regions: list[tuple]) -> list[tuple]:
        points, place = normalised(text)
        lead = int(len(points) > 0 and points[0] == 32)
        out = []
        for item_id, short in self.short:
            found = re.search(r"(?<!\w)" + re.escape("".join(map(chr, short))) + r"(?!\w)", "".join(map(chr, points)))
            if found:
                out.append((item_id, int(place[found.start()]), int(place[found.end() - 1]) + 1, 0))
        best: dict[int, tuple] = {}
        for item, low, high in regions:
            if item in best and best[item][0] == 0:
                continue
            own, k = self.points[item], int(self.k[item])
            low = max(0, low + lead)
            region = points[low : max(0, high + lead)]
            got = self._exact(own, region) or align(own, region, k)
            if got and (item not in best or got[0] < best[item][0]):
                best[item] = (got[0], low + got[1], low + got[2])
        return out + [(self.ids[i], int(place[s]), int(place[e - 1]) + 1, edits) for i, (edits, s, e) in sorted(best.items()) if e > s]

    @staticmethod
    def _exact(own: np.ndarray, region: np.ndarray) -> tuple[int, int, int] | None:
        raw, want = region.tobytes(), own.tobytes()
        at = raw.find(want)
        while at >= 0 and at % 4:
            at = raw.find(want, at + 1)
        return None if at < 0 else (0, at // 4, at // 4 + len(own))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items with text, about ``BLOCK_CHARACTERS`` at a time; one block at least."""
    items = benchmark.where(F.length(F.col(text_col)) > 0).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARACTERS))
    for b in range(blocks):
        yield [(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    share: float = EDIT_SHARE,
) -> DataFrame:
    """One row per document and item that it contains: id, item id, ``start``, ``end``, ``edits``.

    Start and end count code points of the original text, the end is exclusive; of an item's
    places in a document the one with fewest edits is given. Null and empty texts and items
    match nothing; items of under q characters match exactly, as whole words. Repeated rows
    are matched each. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.where(F.length(F.col(text_col)) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out = None
    for own in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(own)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, share)
            for batch in slices(batches, "text", 2 << 20):
                ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
                found = [(ids[i], *x) for i, *x in matcher(texts)]
                if found:
                    cols = list(zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cols[0], batch.schema.field("id").type),
                            pa.array(cols[1]),
                            *[pa.array(c, pa.int32()) for c in cols[2:]],
                        ],
                        names=["id", "item", "start", "end", "edits"],
                    )

        part = rows.mapInArrow(tidy(match), f"id {kinds[0]}, item {kinds[1]}, start int, end int, edits int")
        out = part if out is None else out.unionAll(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    share: float = EDIT_SHARE,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found; null texts stay."""
    spark = docs.sparkSession
    for own in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(own)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, share)
            for batch in slices(batches, text_col, 2 << 20):
                found = {i for i, *_ in matcher([t or "" for t in batch.column(text_col).to_pylist()])}
                yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in found], pa.int64()))

        docs = docs.mapInArrow(tidy(keep), docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
