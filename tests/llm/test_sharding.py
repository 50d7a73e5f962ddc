import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from shiftwise.llm import sharding as S
from tests.llm.conftest import edge_rows


def test_rows_sizes_and_slots(edge, empty):
    got = S.assign(edge).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in edge_rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r.shard for r in got if r.doc_id == 4}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1
    assert S.assign(empty).collect() == []


def test_growth_moves_rows_into_the_new_shard_only(spark):
    keys = spark.range(20000).select("id", S.shard_of(F.col("id"), S.EIGHT).alias("a"), S.shard_of(F.col("id"), S.grown(S.EIGHT)).alias("b"))
    rows = keys.collect()
    assert all(r.b in (r.a, 8) for r in rows)
    per = Counter(r.a for r in rows)
    assert set(per) == set(range(8)) and max(per.values()) < 1.1 * min(per.values())
    assert 0.9 < sum(r.b == 8 for r in rows) / (20000 / 9) < 1.1


def test_a_weight_change_moves_rows_in_its_subtree_only(spark):
    heavy = tuple(S.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 1 else 1.0) for x in S.EIGHT)
    rows = spark.range(20000).select("id", S.shard_of(F.col("id"), S.EIGHT).alias("a"), S.shard_of(F.col("id"), heavy).alias("b")).collect()
    place = {x.shard: x for x in S.EIGHT}
    for r in rows:
        if r.a != r.b:
            assert place[r.b].region == 0  # into the region of shard 1
            if place[r.a].region == 0:
                assert place[r.b].rack == 0  # into its rack
                if place[r.a].rack == 0:
                    assert r.b == 1
    share = Counter(r.b for r in rows)
    assert 0.27 < share[1] / 20000 < 0.33  # weight 3 of 10
    gone = tuple(S.Leaf(x.region, x.rack, x.shard, 0.0 if x.shard == 1 else 1.0) for x in S.EIGHT)
    assert 1 not in {r[0] for r in spark.range(500).select(S.shard_of(F.col("id"), gone)).distinct().collect()}


def test_few_buckets_number_without_gaps(spark):
    df = spark.range(1000).select(F.lit(0).alias("g"), (F.col("id") % 7).alias("k"))
    assert sorted(r.slot for r in S.numbered(df, "g", ["k"], 1, buckets=3).collect()) == list(range(1000))
