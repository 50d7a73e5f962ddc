import inspect

import numpy as np

from shiftwise.llm import packing as P


def test_all_terms_of_a_seed_are_scored():
    """The 24 rarest ids of the seed are in no other document of its shard."""
    shared = np.arange(2000, 2010)
    seed = np.concatenate([np.arange(1000, 1024), shared])
    other = [np.arange(3000 + 34 * k, 3034 + 34 * k) for k in range(3)]
    like = [np.concatenate([shared, np.arange(4000 + 24 * k, 4024 + 24 * k)]) for k in range(2)]
    texts = [seed, *other, *like]
    df = np.bincount(np.concatenate(texts), minlength=5000)
    idf = np.log1p((len(texts) - df + 0.5) / (df + 0.5))
    index = P._Index(texts, idf, 34.0)
    assert index.neighbours(0, 24).tolist() == [0]
    assert sorted(index.neighbours(0).tolist()) == [0, 4, 5]
    pieces = list(P.fill(texts, idf, 34.0, 3 * 34))
    assert sorted(d for d, *_, s, _ in pieces if s == 0) == [0, 4, 5]
    assert inspect.signature(P.pack).parameters["query_terms"].default is None


def test_common_terms_score_like_any_other():
    """Terms of most documents and rare ones together, against plain sums."""
    rnd = np.random.default_rng(2)
    texts = [np.concatenate([rnd.integers(0, 12, 30), rnd.integers(12, 400, 20)]).astype("<u2") for _ in range(400)]
    df = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=500)
    idf = np.log1p((len(texts) - df + 0.5) / (df + 0.5))
    index = P._Index(texts, idf, 50.0)
    assert 0 < len(index.rows) < 400 and (index.row < 0).any()
    for seed in range(0, 400, 37):
        score = np.zeros(400)
        for t in np.unique(texts[seed]):
            tf = np.array([(x == t).sum() for x in texts])
            score += idf[t] * tf * 2.2 / (tf + 1.2)
        got = index.neighbours(seed)
        assert sorted(got.tolist()) == np.flatnonzero(score > 0).tolist()
        assert (np.diff(score[got]) <= 1e-9).all()


def test_a_seed_of_common_terms_only():
    texts = [np.arange(5) for _ in range(100)]
    index = P._Index(texts, np.ones(5), 5.0)
    assert index.neighbours(3).tolist() == list(range(100))


def test_the_end_id_makes_no_neighbours(table):
    """Documents that share nothing but the end id are taken in order."""
    import public_tokenizers

    texts = ["alpha beta", "gamma delta", "epsilon zeta"]
    pieces = P.pack(table([(i, t, "en", "s", 0) for i, t in enumerate(texts)], files=1), public_tokenizers.path("word_bpe_49k.json"), window=64)
    assert {p.doc_id for p in pieces.collect()} == {0, 1, 2}
    idf = np.array([0.0, 0.0, 0.0, 1.0, 1.0, 1.0])
    index = P._Index([np.array([3, 2]), np.array([4, 2]), np.array([5, 2])], idf, 2.0)
    assert index.neighbours(0).tolist() == [0]
