"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.staging import Stage


def components(links: DataFrame, stage: Stage, known: DataFrame | None = None) -> DataFrame:
    """(``id``, ``comp``) for each end of the links (``a``, ``b``): the smallest id of its component.

    ``known``: an earlier result; its components are joined by the links. Repeated links and links
    of a node with itself change nothing; a node without links to others has no row; no links, no rows.

    A large star hangs the larger neighbours of each node on its smallest one, a small star the
    smaller ones; stars alternate until each edge ends in the smallest neighbour of both its ends.
    Minima are combined before their shuffle and are written tables, so that the join with a node
    of very many neighbours can be split.
    """
    links = links.select("a", "b").where("a <> b")
    if known is not None:
        links = links.unionAll(known.where("id <> comp").select(F.col("id").alias("a"), F.col("comp").alias("b")))
    edges = stage.write(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        hung = both.join(least, "a")
        if hung.where("m <> least(a, b)").isEmpty():
            break
        # Repeats stay until the small star's: there are no more rows than edges.
        large = stage.write(hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = stage.write(
            small.select("a", F.col("m").alias("b")).unionAll(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        )
    roots = edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return stage.write(roots.unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()))
