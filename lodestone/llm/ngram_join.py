"""N-gram Jaccard join: documents whose sets of word n-grams have a similarity of a threshold or more.

Sets are hashed to 64 bits and ordered rare-first by a fixed-size sketch of all n-gram counts.
Two similar sets share an n-gram in their prefixes. A first exchange finds the prefix n-grams
that two different sets share; documents with equal sets are one class from then on. Classes
under one n-gram are paired with a centre first, twice, and pairs of one component need no
further proof that they are connected; then all pairs of classes in different components are
made. A pair passes the length, positional and suffix filters before both whole texts are
compared, once. As all links run inside of components, they are counted there, block of classes
against block of classes, by bit sets of the n-grams that two sets of a block share.

Scale: an n-gram travels at most twice from each bucket of documents in the first exchange;
centres are minima that combine before their shuffle; large stars are dealt out by salt; texts
are fetched for the ends of pairs only. Broadcasts (sketch, bitmap of ends) have fixed sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.arrays import sum_arrays
from lodestone.llm.components import components
from lodestone.llm.words import HashCache, hashes_of, mix64, slices, tidy, words_of
from lodestone.operators.staging import Stage

CELLS = 1 << 20
BINS = 64
PRIME = 2147483647
BITMAP = 1 << 24
STAR = 256
BLOCK = 512
BUCKETS_PER_PARTITION = 1
#: Words whose hashes a task holds.
CACHE = 1 << 18
#: Rows without an id get ids from here on; ids of documents are below.
NO_ID = 1 << 62
STEP = np.uint64(0x9E3779B97F4A7C15)


def spread(k: np.ndarray, n: int) -> np.ndarray:
    return k % PRIME * 48271 % PRIME % n


def spread_sql(k: str, n: int) -> str:
    return f"cast(pmod({k}, {PRIME}) * 48271 % {PRIME} % {n} as int)"


def ngrams(text: str | None, n: int, cache: HashCache) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams (A-Z lower-cased); fewer words count as one gram."""
    word = hashes_of(words_of(text, True), cache)
    if len(word) == 0:
        return word
    if len(word) < n:
        gram = np.array([len(word)], np.uint64)
        for i in range(len(word)):
            gram = gram * STEP + word[i : i + 1]
    else:
        gram = word[: len(word) - n + 1].copy()
        for i in range(1, n):
            gram = gram * STEP + word[i : len(word) - n + 1 + i]
    return np.unique(mix64(gram))


def signature(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    one = np.add.reduce(mix64(grams), dtype=np.uint64)
    two = np.add.reduce(mix64(grams ^ STEP), dtype=np.uint64)
    return int(one.astype(np.int64)), int((two ^ np.uint64(len(grams))).astype(np.int64))


def _in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def key_of(doc_id: int | None, first: int) -> int:
    return NO_ID + (first & (NO_ID - 1)) if doc_id is None else doc_id


def frequency_sketch(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """Counts of all documents' n-grams by cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        cache, total = HashCache(CACHE), None
        for batch in slices(batches, "text"):
            flat = np.concatenate([ngrams(t, n, cache) for t in batch.column("text").to_pylist()])
            own = np.bincount((flat >> np.uint64(44)).astype(np.int64), minlength=CELLS).astype(np.uint32)
            total = own if total is None else total + own
        return total

    text = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    return np.minimum(sum_arrays(text, count, CELLS), 2**32 - 1).astype(np.uint32)


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    share: tuple[int, int] = (80, 100),
    count_links: bool = True,
    stage: Stage | None = None,
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` and, if asked for, ``n_links``.

    Two documents link when ``share[1] * intersection >= share[0] * union`` of their sets of word
    n-grams; the component is the smallest id that links reach, and ``n_links`` the number of other
    rows that a row links with. Null and empty texts have an
    empty set, which links with nothing. Rows with one id are one document to the links. Null
    ids never are a component unless all of its rows lack ids; then the component is null.
    Other columns are ignored; an empty table gives an empty result. Ids are integers below 2**62.
    The result reads the tables of ``stage``; whoever gives one can drop them when it is used.
    """
    spark: SparkSession = docs.sparkSession
    stage = stage or Stage(spark, "ngram-join")
    num, den = share
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = spark.sparkContext.broadcast(frequency_sketch(docs, text_col, n))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts = HashCache(CACHE), sketch.value
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                grams = ngrams(text, n, cache)
                size = len(grams)
                one, two = signature(grams)
                rank = (counts[grams >> np.uint64(44)].astype(np.uint64) << np.uint64(32)) | (grams & np.uint64(0xFFFFFFFF))
                prefix = size - -(-num * size // den) + 1 if size else 0
                if prefix < size:
                    best = np.argpartition(rank, prefix)[:prefix]
                    best = best[np.argsort(rank[best], kind="stable")]
                else:
                    best = np.argsort(rank, kind="stable")
                bins = np.bincount((grams & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
                for column, value in zip(
                    out, (key_of(doc_id, one), doc_id is not None, size, one, two, grams[best].tobytes(), bins.astype("<i4").tobytes())
                ):
                    column.append(value)
            k = np.array(out[0], np.int64)
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread(k, buckets).astype(np.int32)), *[pa.array(c, t) for c, t in zip(out, kinds)]],
                names=["b", "k", "has_id", "n", "s1", "s2", "prefix", "bins"],
            )

    def offer(table: pa.Table) -> pa.Table:
        """Each prefix n-gram of a bucket of documents, with two different sets at most."""
        prefixes = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("prefix")]
        pair = np.empty(sum(map(len, prefixes)), [("gram", "<u8"), ("set", "<i8")])
        if prefixes:
            pair["gram"] = np.concatenate(prefixes)
            pair["set"] = np.repeat(table.column("s1").to_numpy(), [len(p) for p in prefixes])
        order = np.lexsort((pair["set"], pair["gram"]))
        pair = pair[order]
        if len(pair):
            pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])]
            third = np.zeros(len(pair), bool)
            third[2:] = pair["gram"][2:] == pair["gram"][:-2]
            pair = pair[~third]
        bucket = (mix64(pair["gram"]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        pair, bucket = pair[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(pair) else np.zeros(1, np.int64)
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        b = table.column("b")[0].as_py() if table.num_rows else 0
        return pa.table(
            {
                "bucket": pa.array([int(bucket[x]) for x, _ in spans], pa.int32()),
                "b": pa.array([b] * len(spans), pa.int32()),
                "grams": pa.array([pair["gram"][x:y].tobytes() for x, y in spans], pa.binary()),
                "sets": pa.array([pair["set"][x:y].tobytes() for x, y in spans], pa.binary()),
            }
        )

    def shared(table: pa.Table) -> pa.Table:
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams")]
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in table.column("sets")]
        flat, label = np.concatenate(grams), np.concatenate(sets)
        order = np.lexsort((label, flat))
        flat, label = flat[order], label[order]
        two = np.unique(flat[1:][(flat[1:] == flat[:-1]) & (label[1:] != label[:-1])])
        kept = []
        for own in grams:
            own = np.unique(own)
            kept.append(own[_in_sorted(own, two)])
        return pa.table({"b": table.column("b").cast(pa.int32()), "grams": pa.array([x.tobytes() for x in kept], pa.binary())})

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        known = [np.frombuffer(x.as_buffer(), np.uint64) for x in right.column("grams")]
        known = np.unique(np.concatenate(known)) if known else np.empty(0, np.uint64)
        prefixes = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in left.column("prefix")]
        hits = _in_sorted(np.concatenate(prefixes) if prefixes else known, known)
        cuts = np.cumsum([0] + [len(p) for p in prefixes]).tolist()
        grams, places = [], []
        for prefix, a, b in zip(prefixes, cuts, cuts[1:]):
            at = np.flatnonzero(hits[a:b])
            grams.append(prefix[at].astype(np.int64))
            places.append(at.astype(np.int32))
        bins = [np.frombuffer(x.as_buffer(), "<i4") for x in left.column("bins")]
        return pa.table(
            {
                **{c: left.column(c) for c in ("k", "has_id", "n", "s1", "s2")},
                "bins": pa.array(bins, pa.list_(pa.int32())),
                "grams": pa.array(grams, pa.list_(pa.int64())),
                "places": pa.array(places, pa.list_(pa.int32())),
            }
        )

    described = rows.mapInArrow(tidy(describe), "b int, k long, has_id boolean, n long, s1 long, s2 long, prefix binary, bins binary")
    offers = described.groupBy("b").applyInArrow(offer, "bucket int, b int, grams binary, sets binary")
    marks = offers.groupBy("bucket").applyInArrow(shared, "b int, grams binary")
    marked = stage.write(
        described.groupBy("b")
        .cogroup(marks.groupBy("b"))
        .applyInArrow(mark, "k long, has_id boolean, n long, s1 long, s2 long, bins array<int>, grams array<long>, places array<int>")
    )
    classes = stage.write(marked.where("n > 0").groupBy("s1", "s2").agg(F.min("k").alias("cid"), F.count("*").alias("docs")))
    first = marked.where("n > 0").join(
        classes.select("cid", F.col("s1").alias("c1"), F.col("s2").alias("c2")), F.expr("k = cid and s1 = c1 and s2 = c2")
    )
    attributes = stage.write(first.where("size(grams) > 0").select("cid", "n", "bins"))
    entries = stage.write(
        first.select("cid", "n", F.explode(F.arrays_zip("grams", "places")).alias("e")).select("cid", "n", F.col("e.grams").alias("gram"), F.col("e.places").alias("place"))
    )
    classes_of, comps = classes.withColumn("comp", F.col("cid")).withColumn("others", F.lit(0).cast("long")), None
    if not entries.isEmpty():
        tried = None
        for turn in (0, 1, None):
            own = entries.withColumn("comp", F.col("cid")) if comps is None else (
                entries.join(comps, entries["cid"] == comps["id"], "left").withColumn("comp", F.coalesce("comp", "cid")).drop("id")
            )
            # The least place is that of the set with fewest rarer n-grams, the one nearest to all others.
            own = own.withColumn("rare", F.col("place") if turn == 0 else F.lit(0))
            several = F.expr("low <> high")
            bounds = [F.min("comp").alias("low"), F.max("comp").alias("high")]
            left = own.select("gram", *[F.col(c).alias(f"x_{c}") for c in ("cid", "n", "place", "comp")])
            if turn is None:
                open_grams = stage.write(own.groupBy("gram").agg(*bounds).where(several).select("gram"))
                some = stage.write(own.join(open_grams, "gram"))
                left = some.select("gram", *[F.col(c).alias(f"x_{c}") for c in ("cid", "n", "place", "comp")])
                right = some.select("gram", *[F.col(c).alias(f"y_{c}") for c in ("cid", "n", "place", "comp")])
                pairs = left.join(right, "gram").where("x_comp < y_comp")
            else:
                centre = F.min(F.struct("rare", F.xxhash64(F.lit(turn), "cid").alias("h"), "cid", "n", "place", "comp")).alias("c")
                right = stage.write(
                    own.groupBy("gram").agg(centre, *bounds).where(several).select("gram", *[F.col(f"c.{c}").alias(f"y_{c}") for c in ("cid", "n", "place", "comp")])
                )
                pairs = left.join(right, "gram").where("x_comp <> y_comp")
            # Length, then positional filter: what is left of both sets bounds the intersection.
            need = f"ceil(({num} * (x_n + y_n)) / {num + den})"
            pairs = (
                pairs.where(f"{den} * least(x_n, y_n) >= {num} * greatest(x_n, y_n)")
                .where(f"least(x_n - x_place, y_n - y_place) >= {need}")
                .select(F.col("y_cid").alias("hub"), F.col("x_cid").alias("leaf"))
                .distinct()
            )
            if tried is not None:
                pairs = pairs.join(tried, (F.least("hub", "leaf") == tried["t1"]) & (F.greatest("hub", "leaf") == tried["t2"]), "left_anti")
            # Suffix filter: both sets split by fixed pivots; the parts bound the intersection.
            x = attributes.select(F.col("cid").alias("leaf"), F.col("n").alias("x_n"), F.col("bins").alias("x_bins"))
            y = attributes.select(F.col("cid").alias("hub"), F.col("n").alias("y_n"), F.col("bins").alias("y_bins"))
            shared_most = F.aggregate(F.zip_with("x_bins", "y_bins", lambda a, b: F.least(a, b)), F.lit(0), lambda a, v: a + v)
            pairs = stage.write(pairs.join(x, "leaf").join(y, "hub").where(shared_most >= F.expr(need)).select("hub", "leaf").distinct())
            if pairs.isEmpty():
                continue
            found = stage.write(_verify(rows, pairs, n, share, buckets, stage))
            done = pairs.select(F.least("hub", "leaf").alias("t1"), F.greatest("hub", "leaf").alias("t2"))
            tried = done if tried is None else tried.unionAll(done)
            if comps is None or not found.isEmpty():
                comps = components(found, stage, comps)
        if comps is not None:
            classes_of = classes.join(comps, classes["cid"] == comps["id"], "left").select("s1", "s2", "cid", "docs", F.coalesce("comp", "cid").alias("comp"))
            if count_links:
                counts = stage.write(_count_links(rows, comps.join(classes, comps["id"] == classes["cid"]).select("cid", "comp", "docs"), n, share, buckets, stage))
                classes_of = classes_of.join(counts, "cid", "left").withColumn("others", F.coalesce("others", F.lit(0)))
            classes_of = stage.write(classes_of)
    out = marked.select("k", "has_id", "n", "s1", "s2").join(classes_of, ["s1", "s2"], "left")
    comp = F.when(F.col("n") == 0, F.when(F.col("has_id"), F.col("k"))).when(F.col("comp") < NO_ID, F.col("comp"))
    columns = [F.when(F.col("has_id"), F.col("k")).alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id")]
    if count_links:
        columns.append(F.when(F.col("n") == 0, 0).otherwise(F.col("others") + F.col("docs") - 1).cast("long").alias("n_links"))
    return out.select(*columns)


def _verify(rows: DataFrame, pairs: DataFrame, n: int, share: tuple[int, int], buckets: int, stage: Stage) -> DataFrame:
    """The links (a, b) among the pairs (hub, leaf), by the whole sets of both texts."""
    spark = rows.sparkSession
    num, den = share
    degree = stage.write(pairs.groupBy("hub").agg(F.count("*").alias("leaves")))
    dealt = stage.write(
        pairs.join(degree, "hub").select(
            F.expr(f"cast(pmod(xxhash64(hub, pmod(xxhash64(leaf), cast(ceil(leaves / {STAR}) as bigint))), {buckets}) as int)").alias("bucket"), "hub", "leaf"
        )
    )
    wanted = dealt.select("bucket", F.col("hub").alias("id")).unionAll(dealt.select("bucket", F.col("leaf").alias("id"))).distinct()
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        cache, sets = HashCache(CACHE), {}
        for i, text in zip(left.column("id").to_pylist(), left.column("text")):
            sets.setdefault(i, []).append(ngrams(text.as_py(), n, cache))
        a, b = [], []
        for hub, leaf in zip(right.column("hub").to_pylist(), right.column("leaf").to_pylist()):
            for x in sets.get(hub, []):
                for y in sets.get(leaf, []):
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    same = int(np.count_nonzero(both[1:] == both[:-1]))
                    if den * same >= num * (len(x) + len(y) - same) and same:
                        a.append(hub)
                        b.append(leaf)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    texts = _texts(rows, wanted.select("id"), n).join(wanted, "id").select(F.col("bucket").alias("at"), "id", "text")
    return texts.groupBy("at").cogroup(dealt.groupBy("bucket")).applyInArrow(compare, "a long, b long").distinct()


def _texts(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, text) of about the documents with these ids: a bitmap of fixed size keeps most others from the join."""
    spark = rows.sparkSession
    words = (
        ids.select(F.expr(spread_sql("id", BITMAP)).cast("long").alias("slot"))
        .groupBy(F.expr("cast(slot div 64 as int)").alias("at"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(BITMAP // 64, np.uint64)
    bitmap[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    ends = spark.sparkContext.broadcast(bitmap)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bits = HashCache(CACHE), ends.value
        for batch in slices(batches, "text"):
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            k = np.array([i if i is not None else key_of(None, signature(ngrams(t.as_py(), n, cache))[0]) for i, t in zip(ids, texts)], np.int64)
            slot = spread(k, BITMAP)
            keep = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([pa.array(k).take(at), texts.take(at)], names=["id", "text"])

    return rows.where(F.col("text").isNotNull()).mapInArrow(tidy(narrow), "id long, text string")


def _count_links(rows: DataFrame, members: DataFrame, n: int, share: tuple[int, int], buckets: int, stage: Stage) -> DataFrame:
    """(cid, others): the documents of other classes that a class (cid, comp, docs) links with."""
    num, den = share
    sizes = stage.write(members.groupBy("comp").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as bigint)").alias("blocks")))
    own = members.join(sizes, "comp").withColumn("block", F.expr("pmod(xxhash64(cid), blocks)"))
    wanted = stage.write(
        own.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
            F.col("cid").alias("id"), "comp", "docs", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
        )
    )

    def count(table: pa.Table) -> pa.Table:
        cache = HashCache(CACHE)
        groups: dict[tuple, dict[int, tuple]] = {}
        for comp, low, high, i, docs, block, text in zip(*(table.column(c).to_pylist() for c in ("comp", "low", "high", "id", "docs", "block", "text"))):
            groups.setdefault((comp, low, high), {})[i] = (docs, block, text)
        ids, others = [], []
        for (_, low, high), members in groups.items():
            sets = [ngrams(text, n, cache) for _, _, text in members.values()]
            docs, block = (np.array([m[k] for m in members.values()], np.int64) for k in (0, 1))
            linked = _linked(sets, num, den)
            if low != high:
                linked &= block[:, None] != block[None, :]
            ids += list(members)
            others += (linked @ docs).tolist()
        return pa.table({"cid": pa.array(ids, pa.int64()), "others": pa.array(others, pa.int64())})

    bucket = F.expr(f"cast(pmod(xxhash64(comp, low, high), {buckets}) as int)").alias("bucket")
    texts = _texts(rows, wanted.select("id"), n).join(wanted, "id").select(bucket, "comp", "low", "high", "id", "docs", "block", "text")
    return texts.groupBy("bucket").applyInArrow(count, "cid long, others long").groupBy("cid").agg(F.sum("others").alias("others"))


def _linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which sets link with which, by bit sets of the members that two or more of them have."""
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    width = -(-int((counts > 1).sum()) // 64)
    bits = np.zeros((len(sets), width), np.uint64)
    at = number[inverse[keep]]
    np.bitwise_or.at(bits, (owner[keep], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    out = np.zeros((len(sets), len(sets)), bool)
    for i in range(len(sets)):
        same = np.bitwise_count(bits & bits[i]).sum(axis=1, dtype=np.int64)
        out[i] = den * same >= num * (size + size[i] - same)
    np.fill_diagonal(out, False)
    return out


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, share=(85, 100))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = w.doc_id), w.doc_id)) AS component_id,
       (SELECT count(*) FROM l WHERE l.a = w.doc_id) AS n_links
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""
