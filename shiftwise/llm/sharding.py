"""Hierarchical weighted hash tree: key -> region -> rack -> shard.

At each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the
key and the child's name, and the smallest draw wins. A child is chosen in
proportion to its weight, and its draw does not depend on its siblings: if the
weight of one shard changes, only the draws of the shard, its rack and its
region change, so rows move only into or out of that subtree. A shard added in
a region of its own takes rows only into itself.

Only built-in column functions are used. Rows are numbered inside a shard
without gaps by two counts: rows per (shard, bucket), a table bounded by the
number of shards times ``buckets``, and the place inside the bucket.

Nulls: a null key is a key like any other (all its rows share a shard); a null
text has size 1 and CRC 0. Repeated rows get slots of their own. An empty
table gives an empty result. Columns other than key and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


#: 8 equal shards: two regions of two racks of two shards.
EIGHT = tuple(Leaf(s // 4, s // 2, s) for s in range(8))


def grown(tree: tuple[Leaf, ...], weight: float = 1.0) -> tuple[Leaf, ...]:
    """``tree`` plus one shard in a new rack of a new region."""
    return tree + (
        Leaf(
            max(x.region for x in tree) + 1,
            max(x.rack for x in tree) + 1,
            max(x.shard for x in tree) + 1,
            weight,
        ),
    )


def _draw(key: Column, level: str, node: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(node)), 11)
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def _pick(key: Column, level: str, children: dict[int, tuple[float, Column]]) -> Column:
    """The result column of the child with the smallest draw."""
    best = F.array_min(
        F.array(*[F.struct(_draw(key, level, n, w), F.lit(n).alias("n")) for n, (w, _) in children.items()])
    ).getField("n")
    nodes = list(children)
    out = children[nodes[-1]][1]
    for n in reversed(nodes[:-1]):
        out = F.when(best == n, children[n][1]).otherwise(out)
    return out


def shard_of(key: Column, tree: tuple[Leaf, ...]) -> Column:
    """The shard of ``key`` in ``tree`` (leaves without weight get nothing)."""
    live = [x for x in tree if x.weight > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    regions = {}
    for region in sorted({x.region for x in live}):
        racks = {}
        for rack in sorted({x.rack for x in live if x.region == region}):
            own = [x for x in live if (x.region, x.rack) == (region, rack)]
            shards = {x.shard: (x.weight, F.lit(x.shard)) for x in sorted(own, key=lambda x: x.shard)}
            racks[rack] = (sum(x.weight for x in own), _pick(key, f"shard {region} {rack}", shards))
        regions[region] = (sum(w for w, _ in racks.values()), _pick(key, f"rack {region}", racks))
    return _pick(key, "region", regions)


def numbered(df: DataFrame, group: str, ties: list[str], n_groups: int, buckets: int = 4096) -> DataFrame:
    """``df`` plus ``slot``: 0, 1, ... within each ``group``.

    ``ties`` decide the order inside a bucket and spread the rows of a group
    over its buckets; rows equal in all of them are interchangeable.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*ties), F.lit(buckets)))
    counts = df.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # at most n_groups * buckets rows of three numbers, whatever the input
    starts = F.broadcast(starts) if n_groups * buckets <= 100_000 else starts
    place = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*ties))
    return (
        df.withColumn("_place", place)
        .join(starts, [group, "_bucket"])
        .withColumn("slot", F.col("_start") + F.col("_place") - F.lit(1))
        .drop("_bucket", "_place", "_start")
    )


def assign(docs: DataFrame, tree: tuple[Leaf, ...] = EIGHT, buckets: int = 4096) -> DataFrame:
    """One row per document: its shard in ``tree``, its slot there, and its
    shard after one more shard has been added."""
    text = F.col("text").cast("string")
    after = grown(tree)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id",
        (F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), tree).cast("int").alias("shard"),
        shard_of(F.col("doc_id"), after).cast("int").alias("grown_shard"),
    )
    return numbered(rows, "shard", ["doc_id", "text_crc32", "size"], len(tree), buckets).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
