"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates all vocabulary matches of a word; dynamic
programming over their ends carries the best score and, with it, the number
of pieces (and of unknown characters) on the best path. No path is stored.

Tie rules are those of the tokenizer: candidates for an end come in order of
their start, the longest first, and only a strictly better score replaces one;
a character without a piece of its own adds an unknown candidate last, at the
vocabulary's least score less 10. Unknown characters fall back to one piece
per UTF-8 byte where the vocabulary has the byte pieces, else a run of them is
one piece. Words begin at blanks, which are part of the following word.

Words repeat, so each worker remembers the counts of words it has seen, up to
``_KEPT_WORDS``; the memory changes no result. A text is one row, of any
length; the work is linear in it.

Control, unknown and byte pieces are no text: where a text spells one ("<s>",
"<0x41>"), it is read by its characters like any other.

Null and empty texts have no tokens. Repeated rows and null ids each get their
row; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from shiftwise.llm.common import id_and_text, map_arrow

MARK = "▁"
_KEPT_WORDS = 300_000
_UNKNOWN_PENALTY = 10.0


def ranked_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file: pieces are ordered by use, so
    the score is the logarithm of a Zipf share of the rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), -math.log(i + 2.0)) for i in range(model.get_piece_size())]


def special_pieces(path: str) -> frozenset[str]:
    """Pieces of a sentencepiece file that stand for no text of their own."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tests = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return frozenset(model.id_to_piece(i) for i in range(model.get_piece_size()) if any(t(i) for t in tests))


class Counter:
    """Counts of words under a vocabulary of (piece, score); ``special`` pieces
    match no text."""

    def __init__(
        self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, special: frozenset[str] = frozenset()
    ):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and piece not in special:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.unknown = min(s for _, s in vocabulary) - _UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.kept: dict[str, tuple[int, int, float]] = {}

    def word(self, word: str) -> tuple[int, int, float]:
        """(pieces, unknown characters, score) of the best path."""
        n = len(word)
        best: list[float] = [0.0] * (n + 1)
        count, unknown = [0] * (n + 1), [0] * (n + 1)
        by_unknown = [False] * (n + 1)
        reached = [True] + [False] * n

        def close(end: int) -> None:
            score = self.unknown + best[end - 1]
            if not reached[end] or score > best[end]:
                if self.bytes:
                    more = len(word[end - 1].encode("utf-8", "surrogatepass"))
                else:
                    more = 0 if by_unknown[end - 1] else 1
                best[end], count[end] = score, count[end - 1] + more
                unknown[end], by_unknown[end], reached[end] = unknown[end - 1] + 1, True, True

        at, single = 1, False
        for last, (size, score) in self.automaton.iter(word):
            end = last + 1
            while at < end:
                if not single:
                    close(at)
                at, single = at + 1, False
            start = end - size
            score += best[start]
            if not reached[end] or score > best[end]:
                best[end], count[end], unknown[end] = score, count[start] + 1, unknown[start]
                by_unknown[end], reached[end] = False, True
            single = single or size == 1
        while at <= n:
            if not single:
                close(at)
            at, single = at + 1, False
        return count[n], unknown[n], best[n]

    def text(self, text: str | None) -> tuple[int, int, float]:
        """(pieces, unknown characters, score) of a text."""
        if not text:
            return 0, 0, 0.0
        text = text.replace(" ", MARK)
        pieces = unknown = 0
        total = 0.0
        for rest in (text[1:] if text[0] == MARK else text).split(MARK):
            found = self.kept.get(rest)
            if found is None:
                if len(self.kept) >= _KEPT_WORDS:
                    self.kept.clear()
                found = self.kept[rest] = self.word(MARK + rest)
            pieces += found[0]
            unknown += found[1]
            total += found[2]
        return pieces, unknown, total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(ranked_vocabulary(path), special=special_pieces(path))


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """A row per document: doc_id, n_tokens, n_unknown (characters) and the
    score of the best path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            found = [own.text(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.float64()),
                ],
                names=["doc_id", "n_tokens", "n_unknown", "score"],
            )

    return map_arrow(id_and_text(docs), run, "doc_id long, n_tokens long, n_unknown long, score double")
