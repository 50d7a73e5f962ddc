"""SimHash near-duplicates through a segment-popcount embedding.

1. Fingerprint: 64 bits, each set if it is set in over half of the hashes of
   the text's word shingles (repeats included).
2. Equal fingerprints are one from here on, so exact copies cost nothing.
3. Embedding: the 64 bits are 32 segments of two; a fingerprint's coordinates
   are the segments' bit counts (0, 1, 2). The Manhattan distance of two
   embeddings never exceeds the Hamming distance of the fingerprints. Counts
   are written in unary (00, 01, 11), so the distance is the bit count of an
   exclusive or.
4. Grid range-join: the segments are cut into ``distance // 2 + 1`` parts.
   Within the allowed distance, at least one part is at Manhattan distance 0
   or 1. A fingerprint lies in the grid cell of each part; it also probes the
   cells one step above in one coordinate. The join on (part, cell) checks
   the Manhattan distance of the whole embedding, then the exact distance.
5. Cells with more than ``cell_rows`` fingerprints do not go through the
   join: their members are dealt into blocks, each pair of blocks is compared
   in a task of its own and only links of a spanning forest leave it.
6. Components of the links, by ``components``.

Nulls and texts without words have fingerprint zero, linked like any other.
Repeated rows and null ids each get their row; a component of null ids alone
has a null id. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwise.llm.common import id_and_text, map_arrow, shared_dir, ship_package, with_place, without_places, write_table
from shiftwise.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_AT_ONCE = 1 << 16  # shingles hashed at a time: bounds memory on long texts


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of a text."""
    words = WORD.findall(text.translate(LOWER)) if text else []
    if not words:
        return 0
    total = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, total, _AT_ONCE):
        end = min(total, start + _AT_ONCE)
        if len(words) < shingle:
            parts = [" ".join(words)]
        else:
            parts = map(" ".join, zip(*[words[start + i : end + i] for i in range(shingle)]))
        h = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), dtype="<u8", count=end - start)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, columns: list[str], shingle: int = 3, seed: int = 42) -> DataFrame:
    """``columns`` of ``docs`` plus ``fp``, the fingerprint of ``text`` as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter(
                (fingerprint(t.as_py(), shingle, seed) for t in batch.column("_text")),
                dtype=np.uint64,
                count=batch.num_rows,
            ).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], names=[*batch.schema.names[1:], "fp"])

    src = docs.select(F.col("text").cast("string").alias("_text"), *columns)
    kinds = ", ".join(f"`{n}` {k}" for n, k in src.dtypes[1:])
    return map_arrow(src, run, f"{kinds}, fp long")


_LOW = 0x5555555555555555


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in unary in two bits."""
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(F.lit(_LOW))
    both = fp.bitwiseAND(high).bitwiseAND(F.lit(_LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _parts(distance: int) -> list[tuple[int, int]]:
    """(first segment, number of segments) of each part."""
    n = distance // 2 + 1
    edges = [32 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _cell(v: Column, first: int, count: int) -> Column:
    mask = (1 << (2 * count)) - 1
    mask = mask - (1 << 64) if mask >= 1 << 63 else mask
    return F.shiftrightunsigned(v, 2 * first).bitwiseAND(F.lit(mask).cast("long"))


def _above(cell: Column, count: int) -> Column:
    """The cells one step above in one coordinate (00 -> 01, 01 -> 11)."""
    steps = []
    for i in range(count):
        low, high = 1 << (2 * i), 1 << (2 * i + 1)
        low, high = (x - (1 << 64) if x >= 1 << 63 else x for x in (low, high))
        raised = (
            F.when(cell.bitwiseAND(F.lit(low).cast("long")) == 0, cell.bitwiseOR(F.lit(low).cast("long")))
            .when(cell.bitwiseAND(F.lit(high).cast("long")) == 0, cell.bitwiseOR(F.lit(high).cast("long")))
        )
        steps.append(raised)
    return F.filter(F.array(*steps), lambda x: x.isNotNull())


def _grid(fps: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """Homes (part, cell, fp, v) and probes of the cells above them."""
    v = embedding(F.col("fp"))
    base = fps.select("fp", v.alias("v"))
    homes = base.select(
        "fp",
        "v",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(p).alias("part"), _cell(F.col("v"), first, count).alias("cell"))
                    for p, (first, count) in enumerate(_parts(distance))
                ]
            )
        ).alias("x"),
    ).select(F.col("x.part").alias("part"), F.col("x.cell").alias("cell"), "fp", "v")
    # parts differ in length by one segment at most: the longest fits all, as
    # a step above a shorter part's cell is a cell that no fingerprint has
    longest = max(count for _, count in _parts(distance))
    radius = min(1, distance)
    probes = homes.select("part", F.explode(_above(F.col("cell"), longest)).alias("cell"), "fp", "v")
    return homes, probes.limit(0) if radius == 0 else probes


def _forest(a: np.ndarray, b: np.ndarray, distance: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs within ``distance``."""
    nodes = a if same else np.concatenate([a, b])
    root = np.arange(len(nodes))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    shift = 0 if same else len(a)
    for i, x in enumerate(a):
        near = np.flatnonzero(np.bitwise_count(b ^ x) <= distance)
        for j in near + shift:
            if (r := find(i)) != (s := find(int(j))):
                root[s] = r
                out.append((i, int(j)))
    if not out:
        return nodes[:0], nodes[:0]
    ends = np.array(out)
    return nodes[ends[:, 0]], nodes[ends[:, 1]]


def _block_links(homes: DataFrame, probes: DataFrame, sizes: DataFrame, distance: int, block: int) -> DataFrame:
    """Links within crowded cells: homes against homes and probes, block by block."""
    n = F.ceil(F.col("n") / F.lit(block)).cast("int")
    n_p = F.ceil(F.col("n_probes") / F.lit(block)).cast("int")
    key = F.col("fp")
    h = homes.join(sizes, ["part", "cell"]).withColumn("at", F.pmod(F.xxhash64(key), n).cast("int"))
    p = probes.join(sizes, ["part", "cell"]).withColumn("at", F.pmod(F.xxhash64(key), n_p).cast("int"))
    # a home goes to the pairs (own block, any block); low block first
    with_homes = h.select(
        "part", "cell", "fp", "at", F.explode(F.sequence(F.lit(0), n - 1)).alias("o")
    ).select(
        "part", "cell", "fp", F.lit(0).alias("kind"), F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"),
        F.col("at").alias("side"),
    )
    as_base = h.select("part", "cell", "fp", "at", F.explode(F.sequence(F.lit(0), F.greatest(n_p, F.lit(1)) - 1)).alias("o")).select(
        "part", "cell", "fp", F.lit(1).alias("kind"), F.col("at").alias("i"), F.col("o").alias("j"), F.lit(0).alias("side")
    )
    as_probe = p.select("part", "cell", "fp", "at", F.explode(F.sequence(F.lit(0), n - 1)).alias("o")).select(
        "part", "cell", "fp", F.lit(1).alias("kind"), F.col("o").alias("i"), F.col("at").alias("j"), F.lit(1).alias("side")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, i, j = (int(pdf[c].iloc[0]) for c in ("kind", "i", "j"))
        fp, side = pdf["fp"].to_numpy().view(np.uint64), pdf["side"].to_numpy()
        if kind == 0 and i == j:
            a, b = _forest(fp, fp, distance, True)
        else:
            low = 0 if kind else i
            a, b = _forest(fp[side == low], fp[side != low], distance, False)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    ship_package(homes.sparkSession)
    rows = with_homes.union(as_base).union(as_probe)
    return rows.groupBy("part", "cell", "kind", "i", "j").applyInPandas(run, "a long, b long")


def links(fps: DataFrame, distance: int = 3, cell_rows: int = 512) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``: within a cell of at
    most ``cell_rows`` all pairs within ``distance`` bits, else a spanning
    forest of them. No component is cut either way."""
    homes, probes = _grid(fps, distance)
    shared_dir(fps.sparkSession)
    crowded = (
        homes.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows).checkpoint()
    )
    is_crowded = not crowded.isEmpty()
    few_homes, few_probes = homes, probes
    if is_crowded:
        few_homes = homes.join(crowded, ["part", "cell"], "left_anti")
        few_probes = probes.join(crowded, ["part", "cell"], "left_anti")
    left = few_homes.withColumn("home", F.lit(True)).union(few_probes.withColumn("home", F.lit(False))).alias("l")
    right = few_homes.alias("r")
    near = (
        (F.col("l.part") == F.col("r.part"))
        & (F.col("l.cell") == F.col("r.cell"))
        & (~F.col("l.home") | (F.col("l.fp") < F.col("r.fp")))
        & (F.bit_count(F.col("l.v").bitwiseXOR(F.col("r.v"))) <= distance)
        & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= distance)
    )
    out = left.join(right, near).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    if is_crowded:
        counted = (
            probes.join(crowded.select("part", "cell"), ["part", "cell"], "left_semi")
            .groupBy("part", "cell")
            .agg(F.count(F.lit(1)).alias("n_probes"))
        )
        sizes = crowded.join(counted, ["part", "cell"], "left").fillna(0, ["n_probes"])
        out = out.union(_block_links(homes, probes, sizes, distance, cell_rows))
    return out


def classes(rows: DataFrame, distance: int = 3, cell_rows: int = 512) -> DataFrame:
    """``rows`` with a column ``fp`` (a written table) -> (fp, root): each
    distinct fingerprint and the name of its component."""
    fps = rows.select("fp").distinct()
    found = components(links(fps, distance, cell_rows))
    return fps.join(found, fps["fp"] == found["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, cell_rows: int = 512) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest doc_id reachable over links."""
    rows = write_table(
        fingerprints(id_and_text(docs), ["doc_id"], shingle), "fp"
    )
    named = classes(rows, distance, cell_rows)
    # per fingerprint first, so that a group of copies is one row from here on
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    members = named.join(least, "fp")
    ids = members.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = members.join(ids, "root").select(F.col("fp").alias("m_fp"), "component_id")
    return rows.join(of_fp, F.col("fp") == F.col("m_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3, cell_rows: int = 512) -> DataFrame:
    """``docs`` (a stored table) with one document of each component: the one
    with the smallest doc_id, then the first place in the table."""
    src = with_place(docs)
    rows = write_table(
        fingerprints(
            src.select("text", F.col("doc_id").cast("long").alias("_id"), "_llm_file", "_llm_row"), ["_id", "_llm_file", "_llm_row"], shingle
        ),
        "fp",
    )
    named = classes(rows, distance, cell_rows)
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_llm_file"), F.col("_llm_row"))
    least = rows.groupBy("fp").agg(F.min(order).alias("least"))
    first = named.join(least, "fp").groupBy("root").agg(F.min("least").alias("least"))
    keep = first.select(F.col("least._llm_file").alias("_llm_kfile"), F.col("least._llm_row").alias("_llm_krow"))
    gone = rows.join(
        keep, (F.col("_llm_file") == F.col("_llm_kfile")) & (F.col("_llm_row") == F.col("_llm_krow")), "left_anti"
    ).select("_llm_file", "_llm_row")
    return without_places(src, write_table(gone, "near-gone"), docs.columns)
