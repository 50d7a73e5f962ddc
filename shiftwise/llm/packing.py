"""Packing by lexical retrieval.

Documents are tokenised once into a written table of ids. They are then dealt
by range over a content signature into shards of about ``shard_tokens``
tokens, so documents that share rare words tend to share a shard. A shard is
a BM25 inverted index of its own documents (term weights use document counts
of the whole corpus, a table bounded by the vocabulary): the first unused
document seeds a sequence, the index scores all documents by all terms of the
seed (or the ``query_terms`` rarest) and returns its unused neighbours, best
first, and they fill the window greedily. A seed has no neighbours outside its
shard. A document that crosses
the window's end is cut, and its rest seeds the next sequence. What is left
at the end of a shard goes into sequences whose lengths are powers of two, so
nothing is padded.

Tokenising: the vocabulary file normalises (NFC, lower case, white space) and
splits into words before its merges, and never looks across a blank. Batches of
texts are cut at blanks, and the distinct words that a worker does not know yet
(a bounded memory) are merged in one call: words of ASCII and Latin-1 letters
after the same split, others by the whole tokenizer. Tests compare both with it.

A null text counts as empty (its only id is the end id). Repeated rows and
null ids are documents like any other. An empty table gives an empty result.
A document of any length is one row of ids, cut over as many sequences as it
needs.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftwise.llm.common import id_and_text, map_arrow, sliced, write_table

_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
_PARTS = re.compile(f"{_SPLIT.pattern}|\n")
_KEPT_WORDS = 700_000
_AT_ONCE = 1 << 23
_MERGED_AT_ONCE = 20_000


def _lines(words: pa.Array) -> str:
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar("\n", pa.large_string()))[0].as_py()


def _dealt(held: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words ``at`` one after another, and the bounds of each."""
    start = bounds[at]
    n = bounds[at + 1] - start
    upto = np.append(0, np.cumsum(n))
    kind = np.int32 if max(len(held), upto[-1]) < 1 << 31 else np.int64
    place = np.repeat((start - upto[:-1]).astype(kind), n)
    place += np.arange(upto[-1], dtype=kind)
    return held[place], upto


class Encoder:
    """Ids of whole texts, equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.whole = Tokenizer.from_file(vocabulary)
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        self.shown = np.arange(256, dtype="<u4")  # the character for each byte; line feeds stand between words
        rest = [b for b in range(256) if b not in letters]
        self.shown[rest] = [b if b == 10 else 256 + n for n, b in enumerate(rest)]
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model["continuing_subword_prefix"] or model["dropout"] or model["fuse_unk"] or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError("not a plain byte-pair vocabulary")
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        suffix = model["end_of_word_suffix"]
        # takes words that are split already, each once: no memory of its own
        self.merges = Tokenizer(BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, end_of_word_suffix=suffix))
        self.merges.pre_tokenizer = CharDelimiterSplit("\n")
        self.last = np.zeros(self.whole.get_vocab_size(), dtype=bool)  # ids that end a word
        self.last[[i for piece, i in self.whole.get_vocab().items() if piece.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        """Drops the known words (results do not change)."""
        self.known = pa.array([], pa.large_string())
        self.bounds = np.zeros(1, dtype=np.int64)  # of each known word's ids in ``held``
        self.held = np.zeros(0, dtype="<u2")

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Merges ``words`` (without blanks) and adds them to the known ones; their places there."""
        plain = pc.match_substring_regex(words, f"^{_PLAIN.pattern}$")
        letters = pc.match_substring_regex(words, "^[a-zß-öø-ÿ]+$")  # one word each
        mixed = pc.and_not(plain, letters)
        n_mixed, n_letters = pc.sum(mixed).as_py() or 0, pc.sum(letters).as_py() or 0
        parts = _PARTS.findall(_lines(words.filter(mixed)).lower()) + ["\n"] * (n_mixed > 0)
        breaks = np.flatnonzero([x == "\n" for x in parts])
        upto = np.append(0, breaks - np.arange(len(breaks)))  # parts before each of mixed
        number: dict[str, int] = {}  # equal parts are merged once
        part = np.array([number.setdefault(x, len(number)) for x in parts if x != "\n"], dtype=np.int64)
        shown = "\n".join([*number, _lines(words.filter(letters))])
        if not shown.isascii():  # bytes of plain words stand for themselves
            shown = self.shown[np.frombuffer(shown.encode(), dtype=np.uint8)].tobytes().decode("utf-32-le")
        merged = np.array(self.merges.encode_batch_fast([shown], add_special_tokens=False)[0].ids, dtype="<u2")
        ends = np.append(0, np.flatnonzero(self.last[merged]) + 1)
        if len(ends) != len(number) + n_letters + 1:
            raise ValueError("the vocabulary does not mark the ends of words")
        dealt, of_part = _dealt(merged, ends, part)
        of_letters = ends[len(number) :]
        other = [self.whole.encode(w, add_special_tokens=False).ids for w in words.filter(pc.invert(plain)).to_pylist()]
        sizes = np.concatenate([np.diff(of_part[upto]), np.diff(of_letters), [len(x) for x in other]]).astype(np.int64)
        order = np.concatenate([np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (mixed, letters, pc.invert(plain))])
        places = np.empty(len(words), dtype=np.int64)
        places[order] = len(self.known) + np.arange(len(words))
        self.known = pa.concat_arrays([self.known, words.take(pa.array(order))])
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(sizes))
        self.held = np.concatenate([self.held, dealt, merged[of_letters[0] :], *(np.array(x, dtype="<u2") for x in other)])
        return places

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where distinct ``words`` stand among the known ones."""
        at = pc.index_in(words, value_set=self.known)
        if len(self.known) + at.null_count > _KEPT_WORDS:
            self.forget()
            at = pa.nulls(len(words), pa.int32())
        places = at.fill_null(-1).to_numpy().astype(np.int64)
        if at.null_count:
            new = words.filter(at.is_null())
            slices = [new.slice(i, _MERGED_AT_ONCE) for i in range(0, len(new), _MERGED_AT_ONCE)]
            places[places < 0] = np.concatenate([self._learn(x) for x in slices])
        return places

    def _split(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special pieces, all at once: the distinct words are
        looked up, and their ids dealt to the places where they stand."""
        lower = [t.lower() if _PLAIN.fullmatch(t) else t for t in texts]
        words = pc.ascii_split_whitespace(pa.array(lower, pa.large_string()))
        coded = words.flatten().dictionary_encode()
        at = self._places(coded.dictionary)[coded.indices.to_numpy()]
        ids, upto = _dealt(self.held, self.bounds, at)
        ids = ids.tobytes()
        ends = (2 * upto[words.offsets.to_numpy()]).tolist()
        return [ids[a:z] for a, z in zip(ends, ends[1:])]

    def all_ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text, little-endian numbers of 16 bits; about ``_AT_ONCE`` characters are held as words."""
        held, size = [], 0
        for text in [t or "" for t in texts]:
            if any(s in text for s in self.specials):
                yield from self._split(held)
                held, size = [], 0
                yield np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()
                continue
            held.append(text)
            size += len(text)
            if size >= _AT_ONCE:
                yield from self._split(held)
                held, size = [], 0
        yield from self._split(held)

    def ids(self, text: str | None) -> bytes:
        return next(self.all_ids([text]))


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def forget_encoders() -> None:
    """Frees this process's encoders. A task calls this by name: a closure that
    names ``_encoders`` itself would carry the driver's tokenizer to every task."""
    _encoders.clear()
    pa.default_memory_pool().release_unused()


def _rank(size: int) -> np.ndarray:
    """A fixed pseudo-random order of the vocabulary that favours high ids,
    which byte-pair merges give to rarer pieces."""
    ids = np.arange(size, dtype=np.uint64) + np.uint64(1)
    x = ids * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) & np.uint64((1 << 32) - 1)
    return x.astype(np.float64) / ids.astype(np.float64) ** 2


def _joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches, put together up to about ``size`` bytes: fewer distinct words are looked up."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def tokenised(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, ids, sign, tie): 16-bit ids with the end id, the two ids of the
    document that come first in a fixed order, and a checksum of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        end = np.array([end_id], dtype="<u2").tobytes()
        rank = _rank(own.whole.get_vocab_size())
        for batch in _joined(batches, _AT_ONCE // 2):
            ids = [x + end for x in own.all_ids(batch.column("text").to_pylist())]
            signs = []
            for x in ids:
                terms = np.frombuffer(x, dtype="<u2")
                order = rank[terms]
                first = terms[order.argmin()]
                order[terms == first] = np.inf
                signs.append(int(first) << 16 | int(terms[order.argmin()]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(ids, pa.binary()),
                    pa.array(signs, pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                ],
                names=["doc_id", "ids", "sign", "tie"],
            )

    return map_arrow(id_and_text(docs), run, "doc_id long, ids binary, sign long, tie long")


def document_counts(rows: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Documents per id over the whole corpus, documents, tokens. Each task
    adds up its own rows; at most ``size`` numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, tokens = np.zeros(size, dtype=np.int64), 0, 0
        for batch in sliced(batches, 1000):
            rows = [np.frombuffer(x.as_buffer(), dtype="<u2") for x in batch.column("ids")]
            sizes = [len(x) for x in rows]
            # a sorted number of row and id: each id of a document counts once
            keys = np.repeat(np.arange(len(rows), dtype=np.uint64) << np.uint64(16), sizes) | np.concatenate(rows)
            keys.sort()
            once = keys[np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))]
            counts += np.bincount((once & np.uint64(0xFFFF)).astype(np.int64), minlength=size)
            docs, tokens = docs + len(rows), tokens + len(keys)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, [-1, -2])), pa.array(np.append(counts[used], [docs, tokens]))], names=["id", "n"]
        )

    found = map_arrow(rows.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(found["id"].tolist(), found["n"].tolist()))
    docs, tokens = n.pop(-1, 0), n.pop(-2, 0)
    df = np.zeros(size, dtype=np.int64)
    df[list(n)] = list(n.values())
    return df, docs, tokens


class _Index:
    """BM25 inverted index of a shard's documents.

    Terms that over a quarter of the documents have are kept as rows of weights as well
    (at most 4 times the postings): a seed has many of them, and adding up rows is
    cheaper than their postings. All other terms of a seed are added up from
    their postings in one pass. Every term counts, with the same scores. Postings of
    documents that have gone into a sequence are left out once they are half of all.
    """

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        long = 1 - b + b * sizes / max(mean, 1.0)
        # by term, then by document: one sort of both in one number
        keys = np.concatenate(texts).astype(np.uint64) << np.uint64(32) | np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        tf = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        term = (keys >> np.uint64(32)).astype(np.int64)
        self.start = np.searchsorted(term, np.arange(len(idf) + 1))
        self.doc = (keys & np.uint64(0xFFFFFFFF)).astype(np.int32)
        self.weight = idf[term] * tf * (k1 + 1) / (tf + k1 * long[self.doc])
        self.texts, self.idf, self.n = texts, idf, len(texts)
        heavy = np.flatnonzero(np.diff(self.start) > max(64, self.n // 4))
        self.row = np.full(len(idf), -1)
        self.row[heavy] = np.arange(len(heavy))
        self.rows = np.zeros((len(heavy), self.n))
        for row, t in zip(self.rows, heavy):
            a, z = self.start[t], self.start[t + 1]
            row[self.doc[a:z]] = self.weight[a:z]
        self.mark = np.zeros(len(idf), dtype=bool)
        self.held = self.n

    def neighbours(self, seed: int, query_terms: int | None = None, used: np.ndarray | None = None) -> np.ndarray:
        """Documents that share weighted terms with the seed, best first, without those ``used`` (which stay so)."""
        if used is not None and 2 * (left := self.n - int(used.sum())) < self.held:
            keep = ~used[self.doc]
            self.start = np.append(0, np.cumsum(keep))[self.start]
            self.doc, self.weight, self.held = self.doc[keep], self.weight[keep], left
        self.mark[self.texts[seed]] = True
        terms = np.flatnonzero(self.mark)
        self.mark[terms] = False
        if query_terms is not None:
            terms = terms[np.argsort(-self.idf[terms], kind="stable")][:query_terms]
        rows = self.row[terms]
        light = terms[rows < 0]
        start = self.start[light]
        n = self.start[light + 1] - start
        at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        score = np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)
        dense = np.zeros(len(self.rows))
        dense[rows[rows >= 0]] = 1.0
        score = score + dense @ self.rows
        found = np.flatnonzero(score > 0 if used is None else (score > 0) & ~used)
        return found[np.argsort(-score[found], kind="stable")]


def fill(
    texts: list[np.ndarray], idf: np.ndarray, mean: float, window: int, query_terms: int | None = None
) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard."""
    index = _Index(texts, idf, mean)
    used = np.zeros(len(texts), dtype=bool)
    first, sequence = 0, 0
    rest: tuple[int, int] | None = None  # a cut document and where it goes on
    tail: list[tuple[int, int, int]] = []
    while rest or first < len(texts):
        if rest is None:
            while first < len(texts) and used[first]:
                first += 1
            if first == len(texts):
                break
            seed, at = first, 0
            used[seed] = True
        else:
            seed, at = rest
        pieces, filled = [], 0
        queue: Iterator[int] | None = None
        doc, rest = seed, None
        while True:
            n = min(len(texts[doc]) - at, window - filled)
            pieces.append((doc, at, n))
            filled += n
            if at + n < len(texts[doc]):
                rest = (doc, at + n)
            if filled == window:
                break
            if queue is None:
                queue = iter(index.neighbours(seed, query_terms, used))
            doc = next((int(d) for d in queue if not used[d]), -1)
            if doc < 0:  # no neighbour left: the next unused document goes on
                while first < len(texts) and used[first]:
                    first += 1
                if first == len(texts):
                    break
                doc = first
            used[doc], at = True, 0
        if filled < window:
            tail = pieces
            break
        offset = 0
        for d, a, n in pieces:
            yield d, a, n, sequence, offset
            offset += n
        sequence += 1
    left = sum(n for _, _, n in tail)
    while left:  # powers of two, largest first
        size, offset = 1 << (left.bit_length() - 1), 0
        left -= size
        while offset < size:
            d, a, n = tail.pop(0)
            n_now = min(n, size - offset)
            yield d, a, n_now, sequence, offset
            offset += n_now
            if n_now < n:
                tail.insert(0, (d, a + n_now, n - n_now))
        sequence += 1


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 2,
    window: int = 4096,
    shard_tokens: int = 1 << 20,
    query_terms: int | None = None,
    max_tasks: int = 1 << 15,
) -> DataFrame:
    """The pieces of all sequences: doc_id, start, length, ids, doc_tokens,
    sequence_id, offset. Beyond ``max_tasks`` shards a task packs several in
    turn, holding one at a time."""
    rows = write_table(tokenised(docs, vocabulary, end_id), "tokens")
    size = encoder(vocabulary).whole.get_vocab_size()
    df, n_docs, n_tokens = document_counts(rows, size)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    idf[end_id] = 0.0  # every document has it: it makes none a neighbour
    mean = n_tokens / max(1, n_docs)
    tasks = min(max_tasks, max(1, math.ceil(n_tokens / shard_tokens)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        forget_encoders()  # a reused worker needs its memory for the index

        def packed(held: list) -> pa.RecordBatch:
            texts = [np.frombuffer(x, dtype="<u2") for _, x in held]
            pieces = list(fill(texts, idf, mean, window, query_terms))
            cut = [texts[d][a : a + n].astype("<u4").tobytes() for d, a, n, _, _ in pieces]
            first = part << 40 | shard << 24  # a shard has far fewer sequences than 1 << 24
            cols = (
                ("doc_id", pa.int64(), [held[p[0]][0] for p in pieces]),
                ("start", pa.int64(), [p[1] for p in pieces]),
                ("length", pa.int64(), [p[2] for p in pieces]),
                ("ids", pa.binary(), cut),
                ("doc_tokens", pa.int64(), [len(texts[p[0]]) for p in pieces]),
                ("sequence_id", pa.int64(), [first + p[3] for p in pieces]),
                ("offset", pa.int64(), [p[4] for p in pieces]),
            )
            return pa.RecordBatch.from_arrays([pa.array(v, t) for _, t, v in cols], names=[n for n, _, _ in cols])

        held, tokens = [], 0
        for batch in batches:
            for i, x in zip(batch.column("doc_id"), batch.column("ids")):
                ids = x.as_py()
                held.append((i.as_py(), ids))
                tokens += len(ids) // 2
                if tokens >= 2 * shard_tokens:  # a crowded range becomes several shards
                    yield packed(held)
                    held, tokens, shard = [], 0, shard + 1
        if held:
            yield packed(held)

    dealt = (
        rows.repartitionByRange(tasks, "sign", "tie", "doc_id")
        .sortWithinPartitions("sign", "tie", "doc_id")
        .select("doc_id", "ids")
    )
    return map_arrow(
        dealt,
        run,
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )


def digests(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the CRC-32 of each piece's ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
