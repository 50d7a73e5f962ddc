"""Importance resampling towards a target distribution.

Texts are bags of hashed features (runs of ``low`` to ``high`` words, CRC-32
modulo ``buckets``). Two arrays of bucket counts, one of the raw documents and
one of the target texts, give an array of integer gains; a document's weight
is the floored mean of the gains of its features, looked up in that array. A
Gumbel draw from the document's id is added, and the documents with the highest
scores are drawn without replacement.

The exact cutoff is found by weighted median of medians over the stored
scores: every partition reports the median of its remaining keys and how many
remain; the weighted median of these is the next pivot, and the side of it
that cannot hold the cutoff goes, at least a quarter of what remains. Where no more
than ``finish_rows`` keys remain they are sorted on the driver. Only winners
are sorted, by ranges, to give them their ranks. Keys are unique (score, id,
length, place in the stored table), so ties cannot blur the cutoff.

What comes to the driver: ``buckets`` counts, one row a partition and round,
and at most ``finish_rows`` keys. Nothing is collected, capped or sampled
otherwise. A null text has no features, weighs 0 and is never drawn; a null
id draws as the id '' and comes last among ties; repeated rows are rows of their own
and may all be drawn. Empty documents or targets give empty or plain results.
Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwise.llm.common import field, id_and_text, map_arrow, write_table
from shiftwise.operators.numbering import number_by_range

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_KEPT = 300_000

#: A key's fields in the order of its comparison: smaller keys win.
_KEY = ("lost", "late", "id", "length", "at")


class _Buckets(dict):
    """feature -> bucket; forgets all when full (results do not change)."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _KEPT:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def features(text: str | None, memory: _Buckets, low: int, high: int) -> tuple[int, np.ndarray]:
    """Number of words of a text, and the buckets of all its features."""
    # UTF-8 keeps every byte of other letters above 0x7f, and lower() of bytes
    # touches A-Z only, so words can be cut from the bytes
    words = _WORD.findall(text.encode().lower()) if text else []
    runs: list[bytes] = []
    for n in range(low, high + 1):
        runs += words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), np.fromiter(map(memory.__getitem__, runs), dtype=np.int64, count=len(runs))


def bucket_counts(texts: DataFrame, buckets: int = 10_000, low: int = 1, high: int = 1) -> np.ndarray:
    """Features per bucket over the column ``text``: tasks add up their own rows,
    ``buckets`` sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, counts = _Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for t in batch.column("text"):
                found = features(t.as_py(), memory, low, high)[1]
                counts += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    parts = map_arrow(texts.select(field(texts, "text", "string")), run, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The integer gain of each bucket, with one count added to every bucket."""
    s, t, n = float(raw.sum()) + len(raw), float(target.sum()) + len(target), zip(raw.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in n], dtype=np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """A document's own draw: the same in every run, at any place."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 2024, low: int = 1, high: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Buckets(len(gain))
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for i, t in zip(ids, batch.column("text")):
                words, found = features(t.as_py(), memory, low, high)
                weight = int(gain[found].sum()) // len(found) if len(found) else 0
                rows.append((i, words, len(found), weight, weight + gumbel(i, seed)))
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_features", "weight", "score"])

    return map_arrow(
        id_and_text(docs), run, "doc_id long, n_words long, n_features long, weight long, score long"
    )


def _below(pivot: tuple | None) -> Column:
    """Keys up to and including ``pivot``, field by field."""
    test = F.lit(True)
    for name, value in reversed(list(zip(_KEY, pivot))):
        test = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & test)
    return test


def _medians(keys: DataFrame) -> list[tuple]:
    """Per partition that has keys: how many, and their median."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows]
        if held:
            own = np.concatenate(held, axis=1)
            middle = (own.shape[1] - 1) // 2
            for row in range(len(_KEY)):  # narrow down to the middle one, field by field
                value = np.partition(own[row], middle)[middle]
                middle -= int((own[row] < value).sum())
                own = own[:, own[row] == value]
            cols = [pa.array([sum(h.shape[1] for h in held)])] + [pa.array([int(v)]) for v in own[:, 0]]
            yield pa.RecordBatch.from_arrays(cols, names=["n", *_KEY])

    found = map_arrow(keys, run, "n long, " + ", ".join(f"{k} long" for k in _KEY)).collect()
    return [tuple(r) for r in found]


def cutoff(keys: DataFrame, k: int, finish_rows: int = 1 << 16) -> tuple | None:
    """The ``k``-th smallest key of ``keys`` (columns ``_KEY``, unique)."""
    if k <= 0:
        return None
    low: tuple | None = None  # remaining keys lie above low and up to high
    high: tuple | None = None
    while True:
        rest = keys
        if low is not None:
            rest = rest.filter(~_below(low))
        if high is not None:
            rest = rest.filter(_below(high))
        parts = _medians(rest)
        total = sum(p[0] for p in parts)
        if total < k:
            raise ValueError("fewer keys than places")
        if total <= finish_rows:
            return sorted(tuple(r) for r in rest.collect())[k - 1]
        seen, pivot = 0, None
        for n, *median in sorted(parts, key=lambda p: p[1:]):
            seen, pivot = seen + n, tuple(median)
            if 2 * seen >= total:
                break
        below = rest.filter(_below(pivot)).count()
        if below == k:
            return pivot
        if below > k:
            high = pivot
        else:
            low, k = pivot, k - below


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    seed: int = 2024,
    buckets: int = 10_000,
    low: int = 1,
    high: int = 1,
    finish_rows: int = 1 << 16,
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; the
    ``percent`` of the documents of at least ``min_words`` words that are drawn have ranks
    from 1 on, the others null."""
    gain = gains(bucket_counts(docs, buckets, low, high), bucket_counts(target, buckets, low, high))
    rows = write_table(
        scored(docs, gain, seed, low, high).withColumn("at", F.monotonically_increasing_id()), "scores"
    ).select(
        "*",
        (-F.col("score")).alias("lost"),
        F.col("doc_id").isNull().cast("long").alias("late"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.col("n_features").alias("length"),
    )
    able = F.col("n_words") >= min_words
    last = cutoff(rows.filter(able).select(*_KEY), rows.filter(able).count() * percent // 100, finish_rows)
    drawn = able & _below(last) if last else F.lit(False)
    out = ["doc_id", "n_features", "weight", "score"]
    ranked = number_by_range(rows.filter(drawn).select(*out, *_KEY), [F.col(c) for c in _KEY], out="rank")
    others = rows.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, "rank").union(others)
