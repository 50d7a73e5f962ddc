import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shiftwise.llm import packing as P
from tests.llm.conftest import edge_rows

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("kept,at_once,merged", [(400_000, 1 << 22, 20_000), (40, 1, 7), (40, 500, 1), (0, 3000, 20_000)])
def test_ids_of_many_texts_at_once(monkeypatch, kept, at_once, merged):
    """However many words are known, held or merged at a time, ids are the tokenizer's."""
    for name, n in (("_KEPT_WORDS", kept), ("_AT_ONCE", at_once), ("_MERGED_AT_ONCE", merged)):
        monkeypatch.setattr(P, name, n)
    texts = [t for _, t, *_ in edge_rows() if len(t or "") < 20_000]
    texts += ["", None, " ", "\n\n", "Crème BRÛLÉE, çà-et-là!! it's '' 's", "a\x0bb\x0cc \x1c d\xa0e", "x" * 5000, "Ωμέγα ΣΑΣ. é ́e漢字,漢字", "ÿþ ÷×ª º µ"]
    texts += ["<|endoftext|> Ünd <|startoftext|>", "</w> <w> a</w>b", "I'LL don't 12'3 ''ve"]
    own, whole = P.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for _ in range(2):
        got = [np.frombuffer(x, "<u2").tolist() for x in own.all_ids(texts)]
        assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(own.all_ids([])) == []


def test_used_documents_are_left_out():
    """The order of the documents not yet used stays, as postings of used ones go."""
    rnd = np.random.default_rng(5)
    texts = [np.concatenate([rnd.integers(0, 12, 30), rnd.integers(12, 400, 20)]).astype("<u2") for _ in range(300)]
    df = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=500)
    idf = np.log1p((len(texts) - df + 0.5) / (df + 0.5))
    plain, index, used = P._Index(texts, idf, 50.0), P._Index(texts, idf, 50.0), np.zeros(300, dtype=bool)
    for seed in rnd.permutation(300):
        used[seed] = True
        assert index.neighbours(seed, None, used).tolist() == [d for d in plain.neighbours(seed).tolist() if not used[d]]
    assert len(index.doc) < len(plain.doc) // 8
