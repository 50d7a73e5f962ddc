import random

import xxhash
from pyspark.sql import functions as F

from shiftwise.llm import simhash as S
from shiftwise.llm.components import components
from tests.llm.conftest import edge_rows


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, distance):
    """Root (any) of each fingerprint by comparing all pairs."""
    fps = sorted(set(fps))
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                up[find(a)] = find(b)
    return {f: find(f) for f in fps}


def expected(rows):
    fp = [(i, slow_fingerprint(t)) for i, t in rows]
    root = roots([f for _, f in fp], 3)
    least = {}
    for i, f in fp:
        least.setdefault(root[f], []).append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in least.items()}
    return sorted(((i, f"{f:016x}", least[root[f]]) for i, f in fp), key=str)


def test_edge_rows(edge, empty):
    got = S.near_duplicates(edge).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected([(i, t) for i, t, *_ in edge_rows()])
    assert S.near_duplicates(empty).collect() == []


def test_given_table(small):
    got = sorted((tuple(r) for r in S.near_duplicates(small).collect()), key=str)
    assert got == expected([(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()])


def near_ones(seed, n_centres, per_centre, flips):
    rnd = random.Random(seed)
    out = []
    for _ in range(n_centres):
        c = rnd.getrandbits(64)
        for _ in range(per_centre):
            x = c
            for _ in range(rnd.randint(0, flips)):
                x ^= 1 << rnd.randrange(64)
            out.append(x)
    return out


def check(spark, fps, distance, cell_rows):
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long").distinct()
    got = {r.fp % (1 << 64): r.root for r in S.classes(df, distance, cell_rows).collect()}
    want = roots(fps, distance)
    assert set(got) == set(want)
    classes = lambda m: sorted(sorted(f for f in m if m[f] == r) for r in set(m.values()))
    assert classes(got) == classes(want)


def test_grid_join_finds_every_component(spark):
    check(spark, near_ones(1, 40, 12, 3) + [0, (1 << 64) - 1, 7, 15], 3, 512)


def test_other_distances(spark):
    for distance in (0, 1, 2, 5):
        check(spark, near_ones(2 + distance, 15, 8, distance + 1), distance, 512)


def test_crowded_cells_go_through_blocks(spark):
    check(spark, near_ones(9, 3, 60, 3), 3, 4)


def test_embedding_bounds_the_distance(spark):
    rnd = random.Random(3)
    pairs = [(rnd.getrandbits(63), rnd.getrandbits(63)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a long, b long")
    l1 = F.bit_count(S.embedding(F.col("a")).bitwiseXOR(S.embedding(F.col("b"))))
    for r in df.select("a", "b", l1.alias("d")).collect():
        want = sum(abs((r.a >> 2 * i & 3).bit_count() - (r.b >> 2 * i & 3).bit_count()) for i in range(32))
        assert r.d == want <= (r.a ^ r.b).bit_count()


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (3, 2)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}


def test_keep_one(edge, empty):
    kept = S.keep_one(edge)
    assert kept.columns == edge.columns and S.keep_one(empty).collect() == []
    rows = [(i, t) for i, t, *_ in edge_rows()]
    root = roots([slow_fingerprint(t) for _, t in rows], 3)
    got = sorted((root[slow_fingerprint(r.text)], r.doc_id is None, r.doc_id) for r in kept.collect())
    best = {}
    for i, t in rows:
        k = root[slow_fingerprint(t)]
        best[k] = min(best.get(k, (True, None)), (i is None, i), key=lambda x: (x[0], x[1] or 0))
    assert got == sorted((k, *v) for k, v in best.items())
