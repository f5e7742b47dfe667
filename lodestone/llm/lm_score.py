"""LM scoring by a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) P(word | class). The class softmax has weights for the
groups of the word before (n-gram), of the one before that (skip), and of both, hashed. The
``TOP`` most frequent words are groups and classes of their own, the end of a text among them;
other words go by their last two bytes, the most frequent endings apart. Within a class the
softmax has the words' log counts for biases, and one unknown word.

The product is the base that counts of word pairs correct, first the pairs with the word before
the last (skip), then those with the last word (n-gram), over all words, not groups:
P(word | context) = (n(context, word) + m P(word)) / (N(context) + m). For both kinds and each
class of N(context), m is the one of ``STRENGTHS`` with the best leave-one-out likelihood over
all training tokens; the largest leaves P(word) as it is. One pass sums likelihoods for each
choice for skip pairs with each one for n-gram pairs, so that the second can follow the first.

The softmax needs the corpus only as counts of (two groups, class), which cover all training
texts; full-batch gradient updates run over that table in one task, as its size is fixed (at most
``GROUPS`` squared contexts) and a job for each step would fill the driver. Within a class and for
pairs there are counts, not weights trained by gradients.

Scale: counts of words and pairs are exact but for clashing pairs and never gathered in one
place: buckets of documents send each distinct word and pair once to its own bucket and get its
count back. Both kinds of bucket grow in number with the corpus, so pairs are hashed into a
space that grows with it: a slot of ``SLOT_BITS`` in one of the buckets; of an unseen pair's
slots well under one in a hundred is taken. The driver sees ``TOP`` words, totals by ending (at
most 65,536), the softmax weights and the table of likelihoods, whose sizes are fixed. On disk, one
pass's shuffles lie at a time, beside the counts; what buckets exchange is packed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.arrays import sum_arrays
from lodestone.llm.langid import held_out
from lodestone.llm.words import mix64, slices, tidy
from lodestone.operators.staging import Stage, collect_garbage

GROUPS = 128
TOP = 96  # with the end of the text, which is group 0
ENDINGS = GROUPS - TOP - 1  # the last group has all other endings
HASHED = 4096
STEPS = 30
RATE = 0.3
DECAY = 1e-4
#: Contexts whose class probabilities are computed at once.
CONTEXTS = 2048
END = b"\n"  # no word has this byte
BUCKETS_PER_PARTITION = 4
BUCKET_CHARACTERS = 1 << 21
SLOT_BITS = 28
SIZES = 40
STRENGTHS = np.array([4.0**i for i in range(10)] + [1e12])
#: Likelihoods are summed as whole numbers of this part of a nat, so that their order changes nothing.
NAT = 1 << 20
#: Tokens whose likelihoods are computed at once, few enough for a processor's cache.
CHUNK = 1 << 16
#: Before packed numbers: how many planes and numbers there are.
HEAD = struct.Struct("<BQ")


@dataclass
class Tokens:
    """The words of some texts, each text's end after them; word 0 is the end."""

    flat: np.ndarray  # numbers of the words
    sizes: np.ndarray  # of the texts, with their ends
    hashes: np.ndarray  # by number
    endings: np.ndarray  # by number: the last two bytes; a single byte is its own ending

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def tokens_of(batches: Iterator[pa.RecordBatch]) -> Tokens:
    """The lower-cased (A-Z) words of the column ``text`` of one batch at least. Null: none.

    Arrow's ASCII functions change and cut at just the characters that ``words_of`` does.
    """
    parts, sizes = [], []
    for batch in slices(batches, "text"):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text").fill_null("")))
        # White space around a text leaves empty words.
        full = pc.greater(pc.binary_length(lists.values), 0)
        upto = np.cumsum(np.concatenate([[0], full.to_numpy(zero_copy_only=False)]))
        sizes.append(np.diff(upto[lists.offsets.to_numpy()]))
        parts.append(lists.values.filter(full))
    coded = pa.chunked_array(parts).dictionary_encode().combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    size = np.concatenate(sizes) + 1
    flat = np.zeros(int(size.sum()), np.int64)
    own = np.ones(len(flat), bool)
    own[np.cumsum(size) - 1] = False
    flat[own] = coded.indices.to_numpy().astype(np.int64) + 1
    words = coded.dictionary
    cuts = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
    raw = words.buffers()[2].to_pybytes() if len(words) else b""
    places = cuts.tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(raw[x:y]) for x, y in zip(places, places[1:])), np.uint64, len(words))
    last = np.frombuffer(raw, np.uint8).astype(np.int64)[cuts[1:] - 1]
    two = np.diff(cuts) > 1
    last[two] = np.frombuffer(raw, np.uint8)[cuts[1:][two] - 2] + (last[two] << 8)
    return Tokens(flat, size, np.concatenate([[END_HASH], hashes]), np.concatenate([[END_CODE], last]))


END_HASH = np.uint64(xxhash.xxh64_intdigest(END))
END_CODE = int.from_bytes(END, "little")


@dataclass
class Groups:
    """The group of any word, and each group's log10 of the sum of its words' counts plus a half."""

    top: np.ndarray  # sorted hashes
    top_group: np.ndarray
    ending: np.ndarray  # group by ending code
    n: int
    v: int
    total: np.ndarray

    def of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = self.ending[endings]
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
            out = np.where(self.top[at] == hashes, self.top_group[at], out)
        return out


def size_of(context: np.ndarray) -> np.ndarray:
    """The class of a context by its count: how many binary digits that has."""
    return np.frexp(context.astype(np.float64))[1]


def corrected(p: np.ndarray, pair: np.ndarray, context: np.ndarray, strengths: np.ndarray) -> np.ndarray:
    """Probabilities with the pairs' counts, ``p`` counting as many times as the context's class says."""
    m = strengths[size_of(context)]
    return (pair + m * p) / (context + m)


#: Sums for a pair of sizes of contexts: one for each strength of skip pairs, then one for each of them with each of n-gram pairs.
LOSSES = len(STRENGTHS) * (len(STRENGTHS) + 1)


def losses(p: np.ndarray, one: np.ndarray, ones: np.ndarray, skip: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens with base probabilities ``p``, negative log likelihoods, in parts of a nat, summed by the contexts' sizes.

    The numbers of the pairs of sizes (skip, n-gram) that occur, then their rows of ``LOSSES`` sums.
    """
    cell = size_of(skips) * SIZES + size_of(ones)
    order = np.argsort(cell.astype(np.int16), kind="stable")
    cells, k = np.unique(cell), len(STRENGTHS)
    out = np.zeros((len(cells), LOSSES))
    for x in range(0, len(order), CHUNK):
        at = order[x : x + CHUNK]
        row, base, skip_own, skips_own, own = np.searchsorted(cells, cell[at]), p[at], skip[at], skips[at], one[at].astype(np.float32)
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        row = row[starts]
        # The second denominators do not depend on the first strength.
        below = [np.add.reduceat(np.log(ones[at] + m), starts) for m in STRENGTHS]
        z = np.empty(len(at), np.float32)
        for i, m in enumerate(STRENGTHS):
            prior = np.maximum((skip_own + m * base) / (skips_own + m), 1e-30).astype(np.float32)
            out[row, i] -= np.add.reduceat(np.log(prior), starts, dtype=np.float64)
            for j, n in enumerate(STRENGTHS.astype(np.float32)):
                np.multiply(prior, n, out=z)
                np.add(z, own, out=z)
                out[row, k + k * i + j] += below[j] - np.add.reduceat(np.log(z, out=z), starts, dtype=np.float64)
    return cells, np.rint(out * NAT).astype(np.int64)


def best_strengths(sums: np.ndarray) -> list[np.ndarray]:
    """The strengths by class of context for skip pairs, then for n-gram pairs with those, of the ``LOSSES`` by pairs of classes."""
    k = len(STRENGTHS)
    sums = sums.reshape(SIZES, SIZES, LOSSES)

    def best(loss: np.ndarray) -> np.ndarray:
        # Of equals, the largest, which leaves the probabilities as they are. A class that no token had takes the next lower one's.
        # Class 0 has no counts, so that all are equal but for rounding.
        loss[0] = 0
        least = k - 1 - np.argmin(loss[:, ::-1], axis=1)
        return least[np.maximum.accumulate(np.where(loss.any(axis=1), np.arange(SIZES), 0))]

    skip = best(sums[:, :, :k].sum(axis=1))
    both = sums[:, :, k:].reshape(SIZES, SIZES, k, k)[np.arange(SIZES), :, skip]
    return [STRENGTHS[skip], STRENGTHS[best(both.sum(axis=0))]]


def packed(x: np.ndarray) -> bytes:
    """Whole numbers of 64 bits as planes of bytes, without the upper planes that are all zero, compressed.

    Shuffles' light codec does not shorten numbers of few bits unless they repeat.
    """
    x = x.astype("<i8").view("<u8")
    if not len(x):
        return b""
    width = max(1, -(-int(x.max()).bit_length() // 8))
    raw = x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return HEAD.pack(width, len(x)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(raw: pa.Buffer) -> np.ndarray:
    if not raw.size:
        return np.zeros(0, np.int64)
    width, n = HEAD.unpack(raw.slice(0, HEAD.size))
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(raw.slice(HEAD.size), width * n, codec="zstd"), np.uint8).reshape(width, n).T
    return out.view("<i8")[:, 0]


def dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word's bucket, a range of hashes, and the order of the words by hash, so by bucket too."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), np.argsort(hashes)


def spans_of(bucket: np.ndarray) -> dict[int, tuple[int, int]]:
    """Start and end of each bucket in a sorted array."""
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    return {int(bucket[x]): (x, y) for x, y in zip(at[:-1].tolist(), at[1:].tolist())}


def before(own: np.ndarray, starts: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For all tokens of some texts, the one before and the one before that, the end before a text."""
    first, second = np.full(len(own), end), np.full(len(own), end)
    first[1:], second[2:] = own[:-1], own[:-2]
    first[starts] = second[starts] = end
    after = starts + 1
    second[after[after < len(own)]] = end
    return first, second


def pair_keys(hashes: np.ndarray, flat: np.ndarray, first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and slot of each token's n-gram pair, then of each one's skip pair."""
    one, skip = mix64(hashes ^ np.uint64(0x51ED270B)), mix64(hashes ^ np.uint64(0x2545F491))
    key = mix64(np.concatenate([one[first], skip[second]]) + np.tile(hashes[flat], 2))
    slot = (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    return (key % np.uint64(buckets)).astype(np.int64) << 32 | slot


def for_training(table: pa.Table, sizes: np.ndarray) -> np.ndarray:
    """For each token whether its text is for training."""
    return np.repeat([not h for h in table.column("held").to_pylist()], sizes)


def count_words(docs: DataFrame, stage: Stage, buckets: int) -> DataFrame:
    """Staged rows: for each bucket ``b`` of documents counts of its words and pairs, in order of their hashes; with b = -1 totals of a bucket of words."""

    def offer(table: pa.Table) -> pa.Table:
        words = tokens_of(iter(table.to_batches()))
        flat, hashes, endings, train = words.flat, words.hashes, words.endings, for_training(table, words.sizes)
        first, second = before(flat, words.starts)
        # The word before has the word's own counts: each is followed by one, and the end stands before each text.
        total, skips = (np.bincount(x[train], minlength=len(hashes)) for x in (flat, second))
        pairs, inverse = np.unique(pair_keys(hashes, flat, first, second, buckets), return_inverse=True)
        times = np.bincount(inverse[np.tile(train, 2)], minlength=len(pairs))
        bucket, order = dealt(hashes, buckets)
        hashes, endings, bucket = hashes[order], endings[order], bucket[order]
        total, lacks = total[order], (total - skips)[order]
        spans, pair_spans = spans_of(bucket), spans_of(pairs >> 32)
        every = sorted(spans | pair_spans)
        cut = [spans.get(k, (0, 0)) for k in every]
        pair_cut = [pair_spans.get(k, (0, 0)) for k in every]
        slot = pairs & (2**32 - 1)
        b = table.column("b")[0].as_py() if table.num_rows else 0
        return pa.table(
            {
                "bucket": pa.array(every, pa.int32()),
                "b": pa.array([b] * len(every), pa.int32()),
                "hashes": pa.array([packed(np.diff(hashes[x:y], prepend=np.uint64(0))) for x, y in cut], pa.binary()),
                "endings": pa.array([packed(endings[x:y]) for x, y in cut], pa.binary()),
                "counts": pa.array([packed(total[x:y]) for x, y in cut], pa.binary()),
                "lacks": pa.array([packed(lacks[x:y]) for x, y in cut], pa.binary()),
                "pairs": pa.array([packed(np.diff(slot[x:y], prepend=0)) for x, y in pair_cut], pa.binary()),
                "times": pa.array([packed(times[x:y]) for x, y in pair_cut], pa.binary()),
            }
        )

    ending = pa.list_(pa.struct([("code", pa.int32()), ("total", pa.int64()), ("types", pa.int64())]))
    best = pa.list_(pa.struct([("hash", pa.int64()), ("code", pa.int32()), ("total", pa.int64())]))

    def reduce(table: pa.Table) -> pa.Table:
        def every(name: str) -> list[np.ndarray]:
            return [unpacked(x.as_buffer()) for x in table.column(name)]

        parts = [np.cumsum(x.view(np.uint64)) for x in every("hashes")]
        hashes, endings, counts = np.concatenate(parts), np.concatenate(every("endings")), np.concatenate(every("counts"))
        words, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(inverse, counts, len(words)).astype(np.int64)
        code = endings[first]
        known = total > 0
        by_code = np.bincount(code[known], total[known], 1 << 16).astype(np.int64)
        types = np.bincount(code[known], minlength=1 << 16)
        used = np.flatnonzero(types)
        top = np.lexsort((words, -total))[: TOP + 1]
        top = top[total[top] > 0]
        cuts = np.cumsum([0] + [len(x) for x in parts]).tolist()
        back = total[inverse]
        own = every("pairs")
        slots, at = np.unique(np.concatenate([np.cumsum(x) for x in own]), return_inverse=True)
        times = np.bincount(at, np.concatenate(every("times")), len(slots)).astype(np.int64)[at]
        pair_cuts = np.cumsum([0] + [len(x) for x in own]).tolist()
        lacks = np.bincount(inverse, np.concatenate(every("lacks")), len(words)).astype(np.int64)[inverse]
        b = table.column("b").to_pylist() + [-1]
        return pa.table(
            {
                "b": pa.array(b, pa.int32()),
                "counts": pa.array([packed(back[x:y]) for x, y in zip(cuts, cuts[1:])] + [b""], pa.binary()),
                "lacks": pa.array([packed(lacks[x:y]) for x, y in zip(cuts, cuts[1:])] + [b""], pa.binary()),
                "bucket": pa.array([table.column("bucket")[0].as_py()] * len(b), pa.int32()),
                "times": pa.array([packed(times[x:y]) for x, y in zip(pair_cuts, pair_cuts[1:])] + [b""], pa.binary()),
                "by_ending": pa.array([None] * (len(b) - 1) + [[{"code": c, "total": int(by_code[c]), "types": int(types[c])} for c in used.tolist()]], ending),
                "top": pa.array(
                    [None] * (len(b) - 1) + [[{"hash": int(words[i].astype(np.int64)), "code": int(code[i]), "total": int(total[i])} for i in top.tolist()]], best
                ),
            }
        )

    offers = docs.groupBy("b").applyInArrow(offer, "bucket int, b int, hashes binary, endings binary, counts binary, lacks binary, pairs binary, times binary")
    return stage.write(
        offers.groupBy("bucket").applyInArrow(
            reduce,
            "b int, counts binary, lacks binary, bucket int, times binary, by_ending array<struct<code:int,total:bigint,types:bigint>>, "
            "top array<struct<hash:bigint,code:int,total:bigint>>",
        )
    )


def make_groups(counted: DataFrame) -> Groups:
    totals = counted.where("b = -1")
    codes = totals.select(F.explode("by_ending").alias("e")).groupBy("e.code").agg(F.sum("e.total").alias("total"), F.sum("e.types").alias("types")).collect()
    top = (
        totals.select(F.explode("top").alias("t"))
        .select("t.*")
        .where(F.col("hash") != int(END_HASH.astype(np.int64)))
        .orderBy(F.desc("total"), "hash")
        .limit(TOP - 1)
        .collect()
    )
    mass, tokens = np.zeros(1 << 16), np.zeros(1 << 16)
    for r in codes:
        mass[r["code"]] = r["total"] + 0.5 * r["types"]
        tokens[r["code"]] = r["total"]
    n, v = sum(r["total"] for r in codes), sum(r["types"] for r in codes)
    mass[END_CODE] = tokens[END_CODE] = 0
    for r in top:
        mass[r["code"]] -= r["total"] + 0.5
        tokens[r["code"]] -= r["total"]
    frequent = np.lexsort((np.arange(1 << 16), -tokens))[:ENDINGS]
    ending = np.full(1 << 16, GROUPS - 1, np.int64)
    ending[frequent] = TOP + np.arange(len(frequent))
    hashes = np.array([END_HASH, *(np.uint64(r["hash"] & (2**64 - 1)) for r in top)], np.uint64)
    order = np.argsort(hashes)
    # A class of endings has one unknown word beside its known ones.
    total = np.log10(np.bincount(ending, mass, GROUPS) + 0.5)
    return Groups(hashes[order], order.astype(np.int64), ending, int(n), int(v), total)


def contexts_of(words: Tokens, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all tokens of some texts: two groups before as one number, and the token's own group."""
    own = group[words.flat]
    first, second = before(own, words.starts)
    return second * GROUPS + first, own


def count_contexts(docs: DataFrame, groups: Groups) -> np.ndarray:
    """How often each class follows each context in the training texts."""
    shared = docs.sparkSession.sparkContext.broadcast(groups)

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        known, total = shared.value, None
        for batch in slices(batches, "text"):
            words = tokens_of(iter([batch]))
            context, own = contexts_of(words, known.of(words.hashes, words.endings))
            part = np.bincount(context * GROUPS + own, minlength=GROUPS**3)
            total = part if total is None else total + part
        return total

    return sum_arrays(docs.where("not held").select("text"), count, GROUPS**3).reshape(GROUPS * GROUPS, GROUPS)


def hashed_pair(context: np.ndarray) -> np.ndarray:
    return (mix64(context.astype(np.uint64) + np.uint64(1)) % np.uint64(HASHED)).astype(np.int64)


def log_softmax(weights: dict[str, np.ndarray], context: np.ndarray) -> np.ndarray:
    z = weights["bias"] + weights["one"][context % GROUPS] + weights["skip"][context // GROUPS] + weights["pair"][hashed_pair(context)]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def descend(context: np.ndarray, want: np.ndarray, steps: int) -> dict[str, np.ndarray]:
    """Weights of the class softmax by adaptive gradient steps, each over all contexts' class counts."""
    total = max(1.0, float(want.sum()))
    unigram = want.sum(axis=0) + 0.5
    weights = {
        "bias": np.log(unigram / unigram.sum()).astype(np.float32),
        "one": np.zeros((GROUPS, GROUPS), np.float32),
        "skip": np.zeros((GROUPS, GROUPS), np.float32),
        "pair": np.zeros((HASHED, GROUPS), np.float32),
    }
    parts = []
    for x in range(0, len(context), CONTEXTS):
        at = context[x : x + CONTEXTS]
        owns = {}
        for name, own in (("one", at % GROUPS), ("skip", at // GROUPS), ("pair", hashed_pair(at))):
            order = np.argsort(own, kind="stable")
            ids, starts = np.unique(own[order], return_index=True)
            owns[name] = order, ids, starts
        parts.append((at, want[x : x + CONTEXTS], owns))
    seen = {k: np.zeros(w.shape, np.float64) for k, w in weights.items()}
    for _ in range(steps if parts else 0):
        sums = {k: np.zeros(w.shape, np.float64) for k, w in weights.items()}
        for at, counts, owns in parts:
            miss = (np.exp(log_softmax(weights, at)) * counts.sum(axis=1, keepdims=True) - counts) / total
            sums["bias"] += miss.sum(axis=0)
            for name, (order, ids, starts) in owns.items():
                sums[name][ids] += np.add.reduceat(miss[order], starts)
        for k in weights:
            grad = sums[k] + (DECAY * weights[k] / len(context) if k != "bias" else 0)
            seen[k] += grad * grad
            weights[k] = (weights[k] - RATE * grad / (np.sqrt(seen[k]) + 1e-9)).astype(np.float32)
    return weights


def train(spark: SparkSession, counts: np.ndarray, steps: int = STEPS) -> dict[str, np.ndarray]:
    """``descend`` on the used contexts, in one task of one job, however many the steps."""
    used = np.flatnonzero(counts.sum(axis=1))
    if not len(used):
        return descend(used, np.zeros((0, GROUPS)), steps)
    table = pa.table({"context": pa.array(used, pa.int32()), "counts": pa.array([counts[i].astype("<u8").tobytes() for i in used.tolist()], pa.binary())})

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        want = np.stack([np.frombuffer(x.as_buffer(), "<u8") for x in rows.column("counts")]).astype(np.float64)
        weights = descend(rows.column("context").to_numpy().astype(np.int64), want, steps)
        yield pa.RecordBatch.from_pydict({"name": list(weights), "weights": [w.tobytes() for w in weights.values()]})

    found = spark.createDataFrame(table).coalesce(1).mapInArrow(tidy(fit), "name string, weights binary").collect()
    return {r["name"]: np.frombuffer(bytes(r["weights"]), np.float32).reshape((-1, GROUPS) if r["name"] != "bias" else GROUPS) for r in found}


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=None, steps: int = STEPS) -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The model learns from the rows that ``held`` (a Boolean column; default: none) leaves.
    Scores are log10 probabilities of the lower-cased (A-Z) words and the end. A null or empty
    text has the end alone; null ids and repeated rows are documents like others; without
    training texts all classes are alike. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "lm-score")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = F.lit(False) if held is None else held
    characters = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    groups_of_rows = max(parts, -(-characters // BUCKET_CHARACTERS))
    buckets = max(BUCKETS_PER_PARTITION * parts, groups_of_rows // 8)
    rows = docs.select(
        F.col(id_col).alias("id"),
        held.alias("held"),
        F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(groups_of_rows)).cast("int").alias("b"),
    )
    counted = count_words(rows, stage, buckets)
    collect_garbage(spark)
    groups = make_groups(counted)
    weights = train(spark, count_contexts(rows, groups), steps)
    every = np.arange(GROUPS * GROUPS)
    logs = np.concatenate([log_softmax(weights, every[i : i + 4096]) for i in range(0, len(every), 4096)]) / np.log(10)
    shared = spark.sparkContext.broadcast((groups, logs.astype(np.float32)))

    def factors(left: pa.Table, right: pa.Table, leave: int) -> tuple:
        """Starts and lengths of the texts, and by token: known, unigram and base log10, pair and context counts."""
        known, table = shared.value
        right = right.sort_by("bucket")
        words = tokens_of(iter(left.to_batches()))
        flat, own = words.flat, words.hashes
        _, order = dealt(own, buckets)
        count, skips = np.empty((2, len(own)), np.int64)
        count[order] = np.concatenate([unpacked(x.as_buffer()) for x in right.column("counts")])
        skips[order] = count[order] - np.concatenate([unpacked(x.as_buffer()) for x in right.column("lacks")])
        group = known.of(own, words.endings)
        base = np.log10(np.maximum(count - leave, 0) + 0.5)
        inside = np.where(group < TOP, 0.0, base - known.total[group])
        context, y = contexts_of(words, group)
        first, second = before(flat, words.starts)
        _, inverse = np.unique(pair_keys(own, flat, first, second, buckets), return_inverse=True)
        times = np.concatenate([unpacked(x.as_buffer()) for x in right.column("times")])[inverse]
        one, skip = np.split(times, 2)
        unigram = (base - np.log10(known.n + 0.5 * (known.v + 1)))[flat]
        return words, (count > 0)[flat], unigram, table[context, y] + inside[flat], one, count[first], skip, skips[second]

    def likelihood(left: pa.Table, right: pa.Table) -> pa.Table:
        """Losses of a bucket's training tokens, each token left out, by both contexts' sizes and both strengths."""
        at, sums = np.empty(0, np.int64), np.empty((0, LOSSES), np.int64)
        if left.num_rows:
            words, _, _, token, *counts = factors(left, right, 1)
            train = for_training(left, words.sizes)
            at, sums = losses(10.0 ** token[train], *(x[train] - 1 for x in counts))
        return pa.table({"at": pa.array([at.astype("<i4").tobytes()], pa.binary()), "sums": pa.array([sums.astype("<i8").tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((SIZES * SIZES, LOSSES), np.int64)
        for batch in batches:
            for at, sums in zip(batch.column("at"), batch.column("sums")):
                total[np.frombuffer(at.as_buffer(), "<i4")] += np.frombuffer(sums.as_buffer(), "<i8").reshape(-1, LOSSES)
        return total.reshape(-1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        known, out = shared.value[0], [[] for _ in range(6)]
        if left.num_rows:
            words, seen, base, token, one, ones, skip, skips = factors(left, right, 0)
            token = np.log10(corrected(corrected(10.0**token, skip, skips, strengths[0]), one, ones, strengths[1]))
            starts = words.starts
            out = [
                left.column("id").to_pylist(),
                left.column("held").to_pylist(),
                words.sizes.tolist(),
                np.add.reduceat(seen.astype(np.int64), starts).tolist(),
                np.add.reduceat(base, starts).tolist(),
                np.add.reduceat(token, starts).tolist(),
            ]
        return pa.table(
            {
                "id": pa.array(out[0], left.schema.field("id").type),
                "held_out": pa.array(out[1], pa.bool_()),
                "n_tokens": pa.array(out[2], pa.int64()),
                "n_known": pa.array(out[3], pa.int64()),
                "train_tokens": pa.array([known.n] * len(out[0]), pa.int64()),
                "base_score": pa.array(out[4], pa.float64()),
                "score": pa.array(out[5], pa.float64()),
            }
        )

    kind = rows.schema["id"].dataType.simpleString()
    counts = counted.where("b >= 0").select("b", "counts", "lacks", "bucket", "times")
    fitted = rows.groupBy("b").cogroup(counts.groupBy("b")).applyInArrow(likelihood, "at binary, sums binary")
    strengths = best_strengths(sum_arrays(fitted, add, SIZES * SIZES * LOSSES).view(np.int64))
    collect_garbage(spark)
    scored = (
        rows.groupBy("b")
        .cogroup(counts.groupBy("b"))
        .applyInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
    return scored.withColumnRenamed("id", id_col)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), held=held_out("doc_id", 5, 1))
