"""Resampling against a plain version of the whole rule."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shiftwise.llm import importance
from tests.llm.conftest import SMALL


def plain(docs, target, percent=10, min_words=20, high=1):
    """Sorted (doc_id, n_features, weight, score, rank)."""

    def found(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
        runs = [" ".join(words[i : i + n]) for n in range(1, high + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]

    def counts(texts):
        return Counter(b for t in texts for b in found(t)[1])

    s, t = counts(x for _, x in docs), counts(target)
    total_s, total_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1.0) * (total_s + 10000) / ((s[b] + 1.0) * (total_t + 10000))))

    rows = []
    for i, text in docs:
        n_words, own = found(text)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n_words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    ranks = {}
    for n, r in enumerate(able[: len(able) * percent // 100], 1):
        ranks.setdefault(r, []).append(n)
    out = []
    for r in rows:
        out.append((r[0], r[2], r[3], r[4], ranks[r].pop(0) if ranks.get(r) else None))
    return sorted(out, key=str)


def taken(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def target(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet")


def test_small_table(small, target):
    assert taken(importance.resample(small, target)) == plain(pairs(small), [r["text"] for r in target.collect()])


@pytest.mark.parametrize("percent", [0, 35, 100])
def test_edge_rows_are_drawn_whole(edge, target, percent):
    own = importance.resample(edge, target, percent=percent, min_words=1, high=2)
    assert taken(own) == plain(pairs(edge), [r["text"] for r in target.collect()], percent, 1, 2)


def test_empty_tables(empty, small, target):
    assert taken(importance.resample(empty, target)) == []
    nothing = target.filter("false")
    assert taken(importance.resample(small, nothing)) == plain(pairs(small), [])


def test_repeated_rows_may_all_be_drawn(table, target):
    rows = [(7, "the same words of one text " * 5, "en", "s", 1)] * 30 + [(8, "other words " * 12, "en", "s", 1)] * 10
    got = taken(importance.resample(table(rows), target, percent=50))
    assert got == plain([r[:2] for r in rows], [r["text"] for r in target.collect()], 50)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 21))


@pytest.mark.parametrize("k", [1, 17, 500, 999, 1000])
def test_cutoff_without_a_finishing_sort(spark, k):
    """Pivots alone come to the exact key, ties in the leading fields included."""
    keys = spark.range(0, 1000, 1, 7).select(
        F.pmod(F.xxhash64("id"), F.lit(5)).alias("lost"),
        F.lit(0).cast("long").alias("late"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(20)).alias("id"),
        F.lit(3).cast("long").alias("length"),
        F.col("id").alias("at"),
    )
    expected = sorted(tuple(r) for r in keys.collect())[k - 1]
    assert importance.cutoff(keys, k, finish_rows=0) == expected
    assert importance.cutoff(keys, k, finish_rows=64) == expected


def test_pivots_discard_a_quarter(spark, monkeypatch):
    rounds = []
    real = importance._medians
    monkeypatch.setattr(importance, "_medians", lambda keys: rounds.append(found := real(keys)) or found)
    keys = spark.range(0, 4096, 1, 9).select(
        F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("lost"), *[F.lit(0).cast("long").alias(c) for c in ("late", "id", "length")],
        F.col("id").alias("at"),
    )
    importance.cutoff(keys, 1234, finish_rows=0)
    left = [sum(p[0] for p in r) for r in rounds]
    assert all(b <= 0.75 * a + 1 for a, b in zip(left, left[1:])), left
