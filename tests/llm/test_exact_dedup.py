import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from shiftwise.llm import exact_dedup as E
from tests.llm.conftest import edge_rows


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, members in groups.items():
        keep = max((i for i in members if i is not None), default=None)
        for i in members:
            out[(i, keep, len(members), hashlib.sha256(t.encode()).hexdigest())] += 1
    return out, len(groups)


def check(rows, got, digest=True):
    want, n = expected(rows)
    if digest:
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got) == want
    else:
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == sum((Counter({k[:3]: v}) for k, v in want.items()), Counter())
    assert sum(r.kept for r in got) == n and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_edge_rows(edge, empty):
    rows = [(i, t) for i, t, *_ in edge_rows()]
    check(rows, E.exact_duplicates(edge).collect())
    assert E.exact_duplicates(empty).collect() == []


def test_state_lasts_over_micro_batches(edge):
    rows = [(i, t) for i, t, *_ in edge_rows()]
    check(rows, E.exact_duplicates(edge, max_bytes_per_trigger=1).collect())


def test_weak_digest_is_caught_by_the_bytes(edge):
    rows = [(i, t) for i, t, *_ in edge_rows()]
    weak = lambda text: (F.length(text) % 3).cast("string")
    check(rows, E.exact_duplicates(edge, digest=weak).collect(), digest=False)


def test_keep_last(edge, empty):
    kept = E.keep_last(edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    assert len(rows) == len({t or "" for _, t, *_ in edge_rows()}) == len({r.text or "" for r in rows})
    assert next(r.doc_id for r in rows if r.text == edge_rows()[6][1]) == 4
    assert E.keep_last(empty).collect() == []
