import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shiftwise.llm import packing as P
from tests.llm.conftest import edge_rows, prose

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(VOCABULARY)


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(small):
    own = P.Encoder(VOCABULARY)
    texts = [t for _, t, *_ in edge_rows()] + [r.text for r in small.select("text").collect()]
    texts += ["ß ẞ SS É é e ́x", "don't I'LL'VE ''s 's 123 4½ ²", "a\x1cb\x85c\xa0d e", "ﬁ ª º µ × ÷ Ω 漢字 \U0001f600", "ÀÖØöøÿ,;:!? (x)", "i̇ İ I"]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u2").tolist() == ids(t), repr(t)[:80]


def check(rows, pieces, window):
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        per_sequence[p.sequence_id].append((p.offset, p.length))
        per_doc[p.doc_id].append(p)
        assert p.length > 0
    for s in per_sequence.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))]
        total = sum(n for _, n in s)
        assert total == window or total & (total - 1) == 0 and total < window
    # every document's pieces put together, as many times as the row is there
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(ids(t) + [2])
    assert set(want) == set(per_doc)
    for i, found in per_doc.items():
        assert sum(p.length for p in found) == sum(map(len, want[i]))
        for p in found:
            assert any(len(w) == p.doc_tokens and np.array(w[p.start : p.start + p.length], "<u4").tobytes() == bytes(p.ids) for w in want[i])
        if len(want[i]) == 1:
            at = 0
            for p in sorted(found, key=lambda p: p.start):
                assert p.start == at
                at += p.length


@pytest.mark.parametrize("window,shard", [(4096, 1 << 20), (64, 500)])
def test_each_id_lies_in_one_piece(edge, empty, window, shard):
    pieces = P.pack(edge, VOCABULARY, window=window, shard_tokens=shard).collect()
    check([(i, t) for i, t, *_ in edge_rows()], pieces, window)
    assert P.pack(empty, VOCABULARY).collect() == []


def test_few_tasks_pack_many_shards(edge):
    pieces = P.pack(edge, VOCABULARY, window=64, shard_tokens=200, max_tasks=2).collect()
    check([(i, t) for i, t, *_ in edge_rows()], pieces, 64)
    assert len({p.sequence_id >> 40 for p in pieces}) <= 2 < len({p.sequence_id >> 24 for p in pieces})


def test_given_table(small):
    pieces = P.pack(small, VOCABULARY)
    check([(r.doc_id, r.text) for r in small.collect()], pieces.collect(), 4096)
    d = P.digests(pieces).first()
    assert set(d.asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_counts_cover_the_corpus(spark, edge):
    rows = P.tokenised(edge, VOCABULARY, 2)
    df, docs, tokens = P.document_counts(rows, WHOLE.get_vocab_size())
    want = np.zeros(WHOLE.get_vocab_size(), dtype=int)
    for _, t, *_ in edge_rows():
        want[list(set(ids(t) + [2]))] += 1
    assert (df == want).all() and docs == len(edge_rows())
    r = next(r for r in rows.collect() if r.doc_id == 7)
    assert r.tie == zlib.crc32(bytes(r.ids))


def test_index_scores_are_bm25():
    texts = [np.array(t) for t in ([1, 2, 2, 3], [2, 3, 4], [5], [1, 1, 4, 4, 4])]
    df = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=6)
    idf = np.log1p((4 - df + 0.5) / (df + 0.5))
    mean = np.mean([len(t) for t in texts])
    index = P._Index(texts, idf, mean)
    for seed in range(4):
        score = [sum(idf[q] * (t == q).sum() * 2.2 / ((t == q).sum() + 1.2 * (0.25 + 0.75 * len(t) / mean)) for q in set(texts[seed].tolist())) for t in texts]
        want = sorted((d for d in range(4) if score[d] > 0), key=lambda d: (-score[d], d))
        assert index.neighbours(seed, 24).tolist() == want


def test_neighbours_share_a_window():
    topics = [np.array(ids(prose(s, 40))) for s in range(2)]
    texts = [np.concatenate([np.full(20, 1000 + k), topics[k]]) for _ in range(6) for k in (0, 1)]  # two topics in turn
    df = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=50000)
    idf = np.log1p((len(texts) - df + 0.5) / (df + 0.5))
    pieces = list(P.fill(texts, idf, 60.0, sum(len(texts[i]) for i in range(0, 12, 2)), 24))
    assert {d % 2 for d, *_, s, _ in pieces if s == 0} == {0}
