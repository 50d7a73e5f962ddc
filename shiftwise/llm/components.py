"""Connected components of a link table by alternating stars.

Each round points every node at the smallest node among its neighbours
("large star" for the larger neighbours, "small star" for the smaller ones)
until the links form stars. Only links are shuffled; a node's neighbours are
combined by a partial ``min``, never gathered. Each round is cut off with
``checkpoint()`` in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftwise.llm.common import shared_dir


def _state(links: DataFrame) -> tuple:
    return tuple(
        links.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
        ).first()
    )


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b) of longs -> (node, root): the smallest node reachable,
    for every node that has a link. Links may repeat, in either direction."""
    shared_dir(links.sparkSession)
    links = (
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )
    seen = _state(links)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # large star: each larger neighbour of a node points at the node's smallest one
        both = links.union(links.select("b", "a"))
        low = both.groupBy(F.col("a").alias("m_a")).agg(F.min("b").alias("m"))
        large = (
            links.join(low, F.col("b") == F.col("m_a"))
            .select("a", F.least("m", "b").alias("b"))
            .distinct()
        )
        # small star: each node points its smaller neighbours at the smallest of them
        low = large.groupBy(F.col("a").alias("m_a")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("m_a"))
        links = (
            small.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
            .select(F.col("x.a").alias("a"), F.col("x.m").alias("b"))
            .filter(F.col("a") != F.col("b"))
            .distinct()
            .checkpoint()
        )
        now = _state(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    # now every link is (node, root of its star)
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
