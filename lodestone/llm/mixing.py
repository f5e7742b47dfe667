"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in a hashed order and their words cut into blocks of nearly
equal size. Slot ``i`` of the schedule has the point ``i * K mod 2**31`` (K: the odd integer
next to 2**31 divided by the golden ratio), which falls into one source's interval of the
cumulative weights; the slot's rank among its source's slots names the block that it takes,
round and round. Any stretch of the schedule so holds each source close to its weight.

Blocks have about ``BLOCK_WORDS`` words at every size of the corpus, so schedule and blocks grow
with it in step.

Scale: offsets within a source and ranks within the schedule are sums over hash buckets and
over chunks of slots first, then over rows within one bucket or chunk, so that a source with a
third of all rows is never ordered in one task. The driver sees one row per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.staging import Stage

WORD = r"[^\x20\x09-\x0D]+"
RING = 2**31
GOLDEN = 1327217885
BINS = 2048
#: Words in a block, and hash buckets of a source's documents.
BLOCK_WORDS = 64
BUCKET_BITS = 16


def targets(sizes: list[int], weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> list[float]:
    """Share the sum of sizes by weight (repeating); what exceeds ``most`` times a size is shared anew."""
    total = float(sum(sizes))
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, active = [0.0] * len(sizes), [i for i in range(len(sizes)) if sizes[i] > 0]
    left = total
    while active:
        per = left / sum(weight[i] for i in active)
        over = [i for i in active if per * weight[i] > most * sizes[i]]
        if not over:
            for i in active:
                out[i] = per * weight[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        active = [i for i in active if i not in set(over)]
    return out


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    most: int = 3,
    block_words: int = BLOCK_WORDS,
    seed: int = 17,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``taken``, and ``row_col`` if given.

    ``size`` counts the words of the whole text (null text: 0). Sources are ordered by code
    point, null last, and weigh ``weights`` in turn. Documents of a source are put in the order
    of a hash of id and text; null ids are a value like others, and repeated rows count as rows
    of their own. Documents without words take 0; an empty table gives an empty result.
    ``row_col`` names a column that tells rows apart, which the result then carries.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "mixing")
    sized = stage.write(
        docs.select(
            F.monotonically_increasing_id().alias("m_row"),
            F.col(id_col).alias("m_id"),
            (F.col(row_col) if row_col else F.lit(None).cast("long")).alias("m_own"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
            F.col(source_col).cast("string").alias("m_source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("m_size"),
        )
    )
    totals = [(r[0], r[1]) for r in sized.groupBy("m_source").agg(F.sum("m_size")).collect()]
    totals.sort(key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [t[1] for t in totals]
    goal = targets(sizes, weights, most)
    blocks = [max(1, round(s / block_words)) if s else 0 for s in sizes]
    slots = [g * b / s if s else 0.0 for g, b, s in zip(goal, blocks, sizes)]
    n_slots = round(sum(slots))

    spec = spark.createDataFrame(
        [
            (i, t[0], t[1], g, b, t[1] // b if b else 0, t[1] % b if b else 0)
            for i, (t, g, b) in enumerate(zip(totals, goal, blocks))
        ],
        "s int, s_source string, source_size long, target double, n_blocks long, base long, extra long",
    )
    # The cumulative weights as intervals of the ring, listed under each coarse bin that they meet.
    cuts, run = [0], 0.0
    for x in slots:
        run += x
        cuts.append(round(run / sum(slots) * RING) if n_slots else 0)
    width = RING // BINS
    ring = spark.createDataFrame(
        [
            (b, i, cuts[i], cuts[i + 1])
            for i in range(len(slots))
            if cuts[i] < cuts[i + 1]
            for b in range(cuts[i] // width, (cuts[i + 1] - 1) // width + 1)
        ],
        "bin long, s int, lo long, hi long",
    )

    schedule = (
        spark.range(n_slots)
        .withColumn("point", (F.col("id") % RING * GOLDEN) % RING)
        .withColumn("bin", F.expr(f"point div {width}"))
        .join(ring, "bin")
        .where("point >= lo and point < hi")
        .select("id", "s", F.expr("id div 65536").alias("chunk"))
    )
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = schedule.groupBy("s", "chunk").agg(F.count("*").alias("n")).withColumn(
        "prior", F.coalesce(F.sum("n").over(before), F.lit(0))
    )
    taken = (
        schedule.withColumn("rn", F.row_number().over(Window.partitionBy("s", "chunk").orderBy("id")) - 1)
        .join(chunks.select("s", "chunk", "prior"), ["s", "chunk"])
        .join(spec.select("s", "n_blocks"), "s")
        .withColumn("rank", F.col("prior") + F.col("rn"))
        .where(F.col("rank") < most * F.col("n_blocks"))
        .groupBy("s", (F.col("rank") % F.col("n_blocks")).alias("block"))
        .agg(F.count("*").alias("times"))
    )

    hashed = sized.join(spec, F.col("m_source").eqNullSafe(F.col("s_source"))).withColumn(
        "bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS)
    )
    # Offsets of buckets in two levels of 256, so that no window grows with the corpus or holds a source's buckets at once.
    sums = hashed.groupBy("s", F.shiftright("bucket", BUCKET_BITS // 2).alias("part"), "bucket").agg(F.sum("m_size").alias("n"))
    sums = stage.write(sums)
    low = Window.partitionBy("s", "part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    high = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("s", "part").agg(F.sum("n").alias("n")).select("s", "part", F.coalesce(F.sum("n").over(high), F.lit(0)).alias("prior"))
    starts = (
        sums.withColumn("own", F.coalesce(F.sum("n").over(low), F.lit(0)))
        .join(parts, ["s", "part"])
        .select("s", "bucket", (F.col("prior") + F.col("own")).alias("start"))
    )
    inside = Window.partitionBy("s", "bucket").orderBy("h", "m_id", "m_size", "m_row").rowsBetween(Window.unboundedPreceding, -1)
    # Blocks: the first `extra` have base + 1 words, the others base.
    lo = lambda b: f"({b} * base + least({b}, extra))"
    of = lambda w: (
        f"case when {w} < extra * (base + 1) then {w} div (base + 1) "
        f"else extra + ({w} - extra * (base + 1)) div greatest(base, 1) end"
    )
    placed = (
        hashed.withColumn("own", F.coalesce(F.sum("m_size").over(inside), F.lit(0)))
        .join(starts, ["s", "bucket"])
        .withColumn("off", F.col("start") + F.col("own"))
        .withColumn(
            "block",
            F.explode_outer(
                F.expr(f"case when m_size > 0 then sequence({of('off')}, {of('(off + m_size - 1)')}) end")
            ),
        )
        .withColumn("words", F.expr(f"least(off + m_size, {lo('(block + 1)')}) - greatest(off, {lo('block')})"))
    )
    return (
        placed.join(taken, ["s", "block"], "left")
        .groupBy("m_row", "m_id", "m_own", "m_size", "source_size", "target")
        .agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken"))
        .select(
            F.col("m_id").alias(id_col),
            F.col("m_size").alias("size"),
            "source_size",
            "target",
            "taken",
            *([F.col("m_own").alias(row_col)] if row_col else []),
        )
    )


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
