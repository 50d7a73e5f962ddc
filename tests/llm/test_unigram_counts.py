import math

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from shiftwise.llm import unigram_counts as C
from tests.llm.conftest import edge_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")


def tokenizer(vocabulary, byte_fallback):
    t = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=C.MARK, prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_tokenizer(edge, empty, small):
    vocabulary = C.ranked_vocabulary(PATH)
    whole = tokenizer(vocabulary, True)
    for df, n in ((edge, len(edge_rows())), (small, small.count())):
        texts = sorted((str(r.doc_id), r.text or "") for r in df.select("doc_id", "text").collect())
        got = C.count_tokens(df, PATH).collect()
        assert len(got) == n
        want = sorted((i, len(whole.encode(t, add_special_tokens=False).ids) if t else 0) for i, t in texts)
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    assert C.count_tokens(empty, PATH).collect() == []


PIECES = ["<unk>", "a", "b", "ab", "ba", "aa", "aab", "aba", C.MARK, C.MARK + "a", C.MARK + "ab", "bb", "abab"]
TIES = [(p, -float(len(p))) for p in PIECES]  # every way to cut a text scores the same
MIXED = [(p, -1.0 - (i * 7 % 5) / 4) for i, p in enumerate(PIECES)]


@pytest.mark.parametrize("vocabulary", [TIES, MIXED, [(p, s) for p, s in MIXED if p != "b"]])
@pytest.mark.parametrize("fallback", [True, False])
def test_ties_and_unknowns(vocabulary, fallback):
    own = C.Counter(vocabulary + [(f"<0x{b:02X}>", -9.0) for b in range(256)] if fallback else vocabulary, fallback)
    whole = tokenizer(vocabulary + [(f"<0x{b:02X}>", -9.0) for b in range(256)] if fallback else vocabulary, fallback)

    @settings(max_examples=150, deadline=None)
    @given(st.text("ab é" + C.MARK, max_size=14))
    def same(text):
        n = len(whole.encode(text, add_special_tokens=False).ids) if text else 0
        assert own.text(text)[0] == n

    same()


def test_score_is_the_best_of_all_cuts():
    scores = dict(MIXED)
    own = C.Counter(MIXED, False)

    def best(word):
        if not word:
            return 0.0
        found = [scores[word[:n]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in scores]
        return max(found, default=-math.inf)

    for word in ("aabab", "abab", "bbaab", C.MARK + "abba"):
        assert abs(own.word(word)[2] - best(word)) < 1e-12


def test_a_small_memory_changes_nothing(monkeypatch):
    own = C.Counter(MIXED, False)
    want = own.text("a ab aba b a ab")
    monkeypatch.setattr(C, "_KEPT_WORDS", 1)
    assert C.Counter(MIXED, False).text("a ab aba b a ab") == want


def test_special_pieces_as_text():
    """A text that spells a control, unknown or byte piece is read by its characters."""
    special = C.special_pieces(PATH)
    assert {"<s>", "</s>", "<unk>", "<0x41>"} <= special and "a" not in special and C.MARK + "the" not in special
    vocabulary = C.ranked_vocabulary(PATH)
    own = C.counter(PATH)
    # the judge has the same pieces and scores, the special ones under names that no text has
    whole = tokenizer([(f"\ue000{i}" if p in special else p, s) for i, (p, s) in enumerate(vocabulary)], False)
    for text in ("<s>", "</s>", "<unk>", "<0x41><0x42>", "a <s> b", "<s>text</s> <0x0A> end", "<<s>>"):
        n = len(whole.encode(text, add_special_tokens=False).ids)
        assert own.text(text)[0] == n > text.count("<"), text
    assert own.text("<s>")[0] >= 3
