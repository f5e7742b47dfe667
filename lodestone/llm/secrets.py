"""Secret scans over a trigram inverted index, in DataFrame operations only.

The rules' trigram queries name a fixed set of trigrams. The index has a posting list for each
trigram and segment: the keys (hashes of the id) of the segment's documents whose lower-cased
text has the trigram. A rule's Boolean query is answered by intersecting and uniting posting
lists, segment by segment; each candidate is verified by the rule's regular expression over its
whole text. A rule without mandatory trigrams scans every text.

Scale: segments hold about ``SEGMENT`` documents, so a posting list is bounded however common
its trigram is, and lists are combined before their shuffle. Texts are never shuffled while the
candidates are at most ``BROADCAST_ROWS`` (their number is checked; a key and a bit mask each);
beyond that they meet by a sort-merge join on the key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.trigrams import TRUE, trigram_query
from lodestone.operators.staging import Stage

#: Documents of a segment of the index; the most candidates (16 bytes each) that are broadcast.
SEGMENT = 4096
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """``pattern``'s leftmost non-overlapping matches, of which those count whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


#: The contract's kinds, in its order. Greedy runs of hexadecimal digits or key
#: characters that are too short have no longer part, so their least length is in the pattern.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}", ignore_case=True),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)
RULES = BASE + EXTRA


def trigram_index(docs: DataFrame, id_col: str, text_col: str, grams: list[str]) -> DataFrame:
    """Posting lists ``(seg, gram, keys)`` of the given lower-case trigrams.

    A null text has no trigram; null ids have one key in common, and so have rows that share an
    id, whose postings are pooled. An empty table has no postings.
    """
    segments = max(1, -(-docs.count() // SEGMENT))
    low = docs.select(F.xxhash64(id_col).alias("key"), F.lower(F.col(text_col)).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    postings = low.select("key", F.explode(found).alias("gram"))
    return postings.groupBy(F.pmod("key", F.lit(segments)).alias("seg"), "gram").agg(F.collect_set("key").alias("keys"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(c_key, mask)``: per key that satisfies any rule's query the bits of those rules.

    Within a segment an AND intersects posting lists and an OR unites them; a trigram without
    a list in the segment has none of its documents.
    """
    lists = index.groupBy("seg").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists"))
    none = F.expr("cast(array() as array<bigint>)")

    def holds(rule: Rule) -> Column:
        sides = []
        for grams in trigram_query(rule.pattern):
            own = [F.coalesce(F.try_element_at("lists", F.lit(g)), none) for g in sorted(grams)]
            sides.append(reduce(F.array_intersect, own))
        return reduce(F.array_union, sides)

    def marked(keys: Column, bit: int) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("c_key"), F.lit(bit).cast("long").alias("bit")))

    bits = [marked(holds(r), 1 << i) for i, r in enumerate(rules)]
    return lists.select(F.explode(F.concat(*bits)).alias("c")).groupBy("c.c_key").agg(F.expr("bit_or(c.bit)").alias("mask"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind); code points, end exclusive.

    A match ends where the lengths of the matches and of the pieces before them add up to.
    These sums are made by doubling: each step adds the sums that stand 1, 2, 4 ... places
    before, so that n matches take n log n additions and no array grows element by element.
    """
    sizes = lambda a: F.transform(a, lambda x: F.length(x))
    hits = sizes(F.regexp_extract_all(text, F.lit(rule.java), F.lit(0)))
    keys = sizes(F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group))) if rule.group else F.expr("cast(array() as array<int>)")
    gaps = sizes(F.split(text, rule.java, -1))

    def shifted(acc: Column, k: Column) -> Column:
        shift = F.least(F.call_function("shiftleft", F.lit(1), k - 1), F.size(acc))
        return F.concat(F.array_repeat(F.lit(0), shift), F.slice(acc, F.lit(1), F.size(acc) - shift))

    def spans(x: Column) -> Column:
        pieces = F.zip_with(F.slice(x["gap"], F.lit(1), F.size(x["hit"])), x["hit"], lambda a, b: a + b)
        ends = F.aggregate(
            F.sequence(F.lit(1), F.length(F.bin(F.size(x["hit"])))), pieces, lambda acc, k: F.zip_with(acc, shifted(acc, k), lambda a, b: a + b)
        )
        zipped = F.arrays_zip(ends.alias("end"), x["hit"].alias("hit"), (x["key"] if rule.group else x["hit"]).alias("key"))
        return F.transform(
            F.filter(zipped, lambda y: y["key"] >= rule.least),
            lambda y: F.struct((y["end"] - y["hit"]).alias("start"), F.lit(order).alias("ord"), y["end"].alias("end"), F.lit(rule.kind).alias("kind")),
        )

    # As an element of an array the lengths are computed once, wherever they are used.
    once = F.array(F.struct(hits.alias("hit"), keys.alias("key"), gaps.alias("gap")))
    return F.element_at(F.transform(once, spans), 1)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id and ``found``, an array of (start, ord, end, kind) by start, then rule order.

    Starts and ends count code points, ends are exclusive. A null text is an empty one and has
    no spans. Rows with a null or repeated id are scanned on their own text; the postings of
    one id are pooled, which can only add candidates. Columns besides id and text are ignored;
    an empty table gives an empty result.
    """
    stage = Stage(docs.sparkSession, "secrets")
    indexed = [r for r in rules if trigram_query(r.pattern) != TRUE]
    grams = sorted({g for r in indexed for q in trigram_query(r.pattern) for g in q})
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if indexed:
        found = stage.write(candidates(trigram_index(docs, id_col, text_col, grams), indexed))
        small = found.count() <= BROADCAST_ROWS
        rows = rows.join(F.broadcast(found) if small else found, F.col("key") == F.col("c_key"), "left")
    empty = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)")
    text, lists = F.col("text"), []
    for order, rule in enumerate(rules):
        test = F.rlike(text, F.lit(rule.java))
        if rule in indexed:
            test = (F.coalesce("mask", F.lit(0)).bitwiseAND(1 << indexed.index(rule)) != 0) & test
        lists.append(F.when(test, _spans(text, rule, order)).otherwise(empty))
    return rows.select(F.col("id").alias(id_col), F.array_sort(F.concat(*lists)).alias("found"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda x: x["ord"] < len(BASE))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda i: F.size(F.filter("found", lambda x: x["ord"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def _oracle() -> str:
    """The query in SQL, without the index: positions are sums over the matches and the pieces between them."""
    parts = []
    for order, rule in enumerate(RULES):
        pattern = rule.java.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {order} AS ord, '{rule.kind}' AS kind, hits[i] AS hit, keys[i] AS key,
  coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
FROM (SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, hits, keys, gaps FROM (
  SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_extract_all(text, '{pattern}', {rule.group}) AS keys,
         string_split_regex(text, '{pattern}') AS gaps
  FROM documents WHERE regexp_matches(text, '{pattern}')) a) b WHERE length(keys[i]) >= {rule.least}"""
        )
    counts = ", ".join(f"count(*) FILTER (ord = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)
    return f"""WITH s AS ({" UNION ALL ".join(parts)}),
t AS (SELECT *, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(hit) AS BIGINT) AS span FROM s),
a AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY start, ord) FILTER (ord < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans
  FROM t GROUP BY doc_id)
SELECT d.doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id"""


ORACLE_SQL = _oracle()
