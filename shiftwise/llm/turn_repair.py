"""Repair of conversation structure by Hirschberg's divide and conquer.

Rows of a conversation are aligned with the legal role patterns, an optional
system turn and then user and assistant in turn. Four states (nothing yet,
system, user, assistant) say what stands last. A row may be kept, given another
role or deleted, and empty turns may be put in; the cheapest edits are sought, and
the least audit in byte order among them. Forward and backward vectors of four
costs meet in the middle of a conversation; among the crossings of least cost the
one with the least forward audit is taken, and both halves are solved in turn, so
space is linear. Audits of one stretch of rows that end in different states
never begin with one another, so a rank among four says which is least, and no audit is
held for comparison.

How it runs: rows are reduced to one byte of facts each and sorted by ranges of
(conversation, turn); a task reads its range as a stream and solves conversations
that lie inside of it. A conversation that crosses ranges, or has more than
``block_rows`` rows, is cut into segments, each with the least costs and ranks
from any state to any other; these compose, so only they meet in one task (16 numbers
a segment), which fixes the states at the cuts; the segments are then solved one by one, each
anywhere. The text moves once, beside its edits, to be hashed as a stream: a digest of a
whole conversation is sequential, so one task reads a conversation, never holding it.

Defined results: a null conversation id is a conversation; a null role or text is
one space; null turns come first; rows of one turn are ordered by the SHA-256 of
role and text, equal ones by their place in the stored table; roles count by their first
character, and one that is not s, u or a fits nowhere until it is changed. Long and
empty texts are rows like any other; an empty table gives no rows; gaps beyond a
64-bit number are null. ``conversations`` must be a stored table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftwise.llm.common import field, map_arrow, with_place, write_table

WHITE = " \t\n\x0b\x0c\r"
INITIALS = "sua"  # codes 0, 1, 2; any other initial is 3
FINE, BLANK, TRUNCATED, DUPLICATE = range(4)
CHANGED = {2: "user", 3: "assistant"}  # role written in state
NEVER = 1 << 60

# --- Fixed values: costs of the edits -----------------------------------------
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
# ------------------------------------------------------------------------------


def _next_inserted(state: int) -> int:
    return 3 if state == 2 else 2


def _moves(initial: int, fault: int) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) of one row with the inserts before it: for each
    pair of states the cheapest, then the least audit."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    more = UNFINISHED if fault == TRUNCATED else 0
    for begin in range(4):
        state, cost, audit = begin, 0, ""
        for _ in range(3):  # two inserts reach any state that inserts reach
            ends = [(state, DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                ends.append((_next_inserted(state), REROLE + more, "R"))
                if (initial, state) == (0, 0):
                    ends.append((1, more, "K"))
                elif initial in (1, 2) and _next_inserted(state) == initial + 1:
                    ends.append((initial + 1, more, "K"))
            for end, own, edit in ends:
                found = (cost + own, audit + edit)
                best[begin, end] = min(best.get((begin, end), found), found)
            state, cost, audit = _next_inserted(state), cost + INSERT, audit + "I"
    return [(a, z, c, e) for (a, z), (c, e) in sorted(best.items())]


MOVES = [_moves(code % 4, code // 4) for code in range(16)]
#: Cost and audit from each state to the end of a conversation.
TO_END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def forward(codes: bytes, start: int) -> tuple[list[int], list[int]]:
    """Least cost from ``start`` to each state over all rows, and the rank of each
    state's least audit among those of the states."""
    cost, rank = [NEVER] * 4, [0] * 4
    cost[start] = 0
    for code in codes:
        best: list = [None] * 4
        for a, z, c, edits in MOVES[code]:
            if cost[a] < NEVER:
                found = (cost[a] + c, rank[a], edits)
                if best[z] is None or found < best[z]:
                    best[z] = found
        reached = sorted((b[1:], z) for z, b in enumerate(best) if b)
        cost, rank = [b[0] if b else NEVER for b in best], [0] * 4
        for place, (_, z) in enumerate(reached):
            rank[z] = place
    return cost, rank


def backward(codes: bytes, to_end: list[int]) -> list[int]:
    """Least cost from each state over all rows, then to the end."""
    cost = to_end
    for code in reversed(codes):
        before = [NEVER] * 4
        for a, z, c, _ in MOVES[code]:
            before[a] = min(before[a], c + cost[z])
        cost = before
    return cost


def solve(codes: bytes, start: int, to_end: tuple[tuple[int, str], ...] = TO_END) -> str:
    """The least of the cheapest audits from ``start`` to the end."""
    if not codes:
        return to_end[start][1]
    if len(codes) == 1:
        ways = [(c + to_end[z][0], e + to_end[z][1]) for a, z, c, e in MOVES[codes[0]] if a == start]
        return min(ways)[1]
    middle = len(codes) // 2
    there, rank = forward(codes[:middle], start)
    onward = backward(codes[middle:], [c for c, _ in to_end])
    least = min(a + b for a, b in zip(there, onward))
    crossing = min((s for s in range(4) if there[s] + onward[s] == least), key=rank.__getitem__)
    return solve(codes[:middle], start, _only(crossing)) + solve(codes[middle:], crossing, to_end)


def _only(state: int) -> tuple[tuple[int, str], ...]:
    return tuple((0 if s == state else NEVER, "") for s in range(4))


def chain(costs: list[list[int]], ranks: list[list[int]]) -> tuple[int, list[int]]:
    """Least cost of a conversation from its segments' 4 x 4 costs and ranks, and
    the states at the cuts, the first and the last included."""
    cost, rank, back = [0, NEVER, NEVER, NEVER], [0] * 4, []
    for c, r in zip(costs, ranks):
        best: list = [None] * 4
        for a in range(4):
            for z in range(4):
                if cost[a] < NEVER and c[4 * a + z] < NEVER:
                    found = (cost[a] + c[4 * a + z], rank[a], r[4 * a + z], a)
                    best[z] = found if best[z] is None else min(best[z], found)
        reached = sorted((b[1:3], z) for z, b in enumerate(best) if b)
        cost, rank = [b[0] if b else NEVER for b in best], [0] * 4
        for place, (_, z) in enumerate(reached):
            rank[z] = place
        back.append([b[3] if b else 0 for b in best])
    total = min(c + e for c, (e, _) in zip(cost, TO_END))
    state = min((s for s in range(4) if cost[s] + TO_END[s][0] == total), key=rank.__getitem__)
    states = [state]
    for step in reversed(back):
        state = step[state]
        states.append(state)
    return total, states[::-1]


def edits(codes: bytes, start: int, audit: str) -> Iterator[tuple[str, str, str]]:
    """Per row: roles put in before it, its edit (a changed role is its initial), roles put in after the last row."""
    state, before, rows = start, "", []
    for e in audit:
        if e == "I":
            state = _next_inserted(state)
            before += INITIALS[state - 1]
            continue
        kind = e
        if e == "R":
            state = _next_inserted(state)
            kind = INITIALS[state - 1]
        elif e == "K":
            state = codes[len(rows)] % 4 + 1
        rows.append((before, kind))
        before = ""
    for i, (b, kind) in enumerate(rows):
        yield b, kind, before if i == len(rows) - 1 else ""


# --- the table ------------------------------------------------------------------

_ORDER = ("conv_id", "turn", "digest", "file", "row", "copy")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage, with the columns of their order (``_ORDER``)."""
    src = with_place(conversations)
    key = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("t").cast("string"), F.lit(" ")))
    rows = src.select(
        field(conversations, "conv_id", "long").alias("conv"),
        field(conversations, "turn", "long").alias("t"),
        F.coalesce(field(conversations, "role", "string"), F.lit(" ")).alias("said"),
        F.coalesce(field(conversations, "text", "string"), F.lit(" ")).alias("words"),
        F.xxhash64("_llm_file").alias("file"),
        F.col("_llm_row").alias("row"),
    ).withColumn("fate", F.crc32(key) % 20)
    fate = F.col("fate")
    rows = rows.filter(fate != 0).select(
        F.col("conv").alias("conv_id"),
        F.col("t").alias("turn"),
        F.when(fate == 4, F.lit("user")).otherwise(F.col("said")).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace("words", "[.!?]", "")).otherwise(F.col("words")).alias("text"),
        "file",
        "row",
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text")
    return rows.withColumn("digest", F.unhex(F.sha2(whole, 256)))


def _facts(rows: DataFrame) -> DataFrame:
    """Rows sorted by ranges, a byte of facts and the place ``at`` for each, stored."""
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    rest = F.rtrim("text", F.lit(WHITE))
    fault = F.when(rest == "", BLANK).when(F.right(rest, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    narrow = rows.select(*_ORDER, (initial + 4 * fault).alias("code"))
    order = [F.col(c).asc_nulls_first() for c in _ORDER]
    dealt = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    return write_table(dealt.withColumn("at", F.monotonically_increasing_id()), "turns")


def _with_duplicates(facts: DataFrame) -> DataFrame:
    """(conv_id, at, turn, code): rows whose role and text came earlier are duplicates.

    The first of each is found by hash aggregation and marked by its place, which
    is unique, so a text that fills a conversation meets in no task."""
    firsts = facts.groupBy("conv_id", "digest").agg(F.min("at").alias("first")).select("first")
    code = F.col("code")
    again = F.col("first").isNull() & (F.floor(code / 4) != BLANK)
    return facts.join(firsts, F.col("at") == F.col("first"), "left").select(
        "conv_id", "at", "turn", F.when(again, code % 4 + 4 * DUPLICATE).otherwise(code).cast("byte").alias("code")
    )


_LEGAL = np.zeros((4, 4), dtype=bool)
for _a, _b in ("su", "ua", "au"):
    _LEGAL[INITIALS.index(_a), INITIALS.index(_b)] = True

_SEGMENT = (
    "conv_id long, first long, codes binary, audit string, cost long, blank long, duplicate long, truncated long, "
    "illegal long, low long, high long, turns long, last_turn long, costs array<long>, ranks array<int>"
)


def _segment(conv, first: int, codes: np.ndarray, turns: list, whole: bool) -> tuple:
    """One row of ``_SEGMENT``; solved where it is a whole conversation."""
    fault, initial, own = codes // 4, codes % 4, codes.astype(np.uint8).tobytes()
    known = [t for t in turns if t is not None]
    illegal = int((~_LEGAL[initial[:-1], initial[1:]]).sum())
    audit = cost = costs = ranks = None
    if whole:
        audit = solve(own, 0)
        cost = backward(own, [c for c, _ in TO_END])[0]
    else:
        both = [forward(own, s) for s in range(4)]
        costs, ranks = [c for f, _ in both for c in f], [r for _, f in both for r in f]
    counts = [int((fault == x).sum()) for x in (BLANK, DUPLICATE, TRUNCATED)]
    span = (min(known), max(known), len(set(known)), known[-1]) if known else (None, None, 0, None)
    return (conv, first, own, audit, cost, *counts, illegal, *span, costs, ranks)


def _segments(codes: DataFrame, block_rows: int) -> DataFrame:
    dealt = codes.repartitionByRange("at").sortWithinPartitions("at")
    schema = pa.schema(
        [(n, t) for n, t in zip([x.split()[0] for x in _SEGMENT.split(", ")], [pa.int64(), pa.int64(), pa.binary(), pa.string(), *[pa.int64()] * 9, pa.list_(pa.int64()), pa.list_(pa.int32())])]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a segment: rows of one conversation whose places follow each other
        held: list[np.ndarray] = []
        turns: list = []
        conv, first, size, after, cut = None, 0, 0, None, True
        out: list[tuple] = []

        def close(whole: bool) -> None:
            if size:
                out.append(_segment(conv, first, np.concatenate(held), turns, whole))

        for batch in batches:
            ids, at, own = batch.column("conv_id").to_pylist(), batch.column("at").to_numpy(), batch.column("code").to_numpy()
            times = batch.column("turn").to_pylist()
            null = np.array([i is None for i in ids], dtype=bool)
            number = batch.column("conv_id").fill_null(0).to_numpy()
            step = (number[1:] != number[:-1]) | (null[1:] != null[:-1]) | (at[1:] != at[:-1] + 1)
            starts = [0, *(np.flatnonzero(step) + 1).tolist()] if len(at) else []
            for a, z in zip(starts, [*starts[1:], len(at)]):
                while a < z:
                    same = bool(size) and ids[a] == conv
                    if not same or at[a] != after or size >= block_rows:
                        close(whole=not same and not cut)
                        # the first of a range may go on from another one, as may what follows a cut
                        cut = after is None or same
                        conv, first, size, held, turns = ids[a], int(at[a]), 0, [], []
                    n = min(z - a, block_rows - size)
                    held.append(own[a : a + n])
                    turns.extend(times[a : a + n])
                    size, after = size + n, int(at[a + n - 1]) + 1
                    a += n
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
        close(whole=False)  # the last of a range may go on in another one
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return write_table(map_arrow(dealt, run, _SEGMENT), "turn-segments")


def _chained(table: pa.Table) -> pa.Table:
    """States at the cuts of one conversation: per segment start, end (null for
    the last) and what only the whole can tell."""
    rows = sorted(table.to_pylist(), key=lambda r: r["first"])
    total, states = chain([r["costs"] for r in rows], [r["ranks"] for r in rows])
    out, last_turn, before = [], None, None
    for i, r in enumerate(rows):
        shared = int(last_turn is not None and r["low"] == last_turn)  # a turn cut in two counts once
        last_turn = last_turn if r["last_turn"] is None else r["last_turn"]
        crossing = int(before is not None and not _LEGAL[before, r["head"]])
        before = r["tail"]
        end = states[i + 1] if i + 1 < len(rows) else None
        out.append({"first": r["first"], "start": states[i], "end": end, "shared": shared, "crossing": crossing, "total": 0 if i else total})
    kinds = [("first", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("shared", pa.int64()), ("crossing", pa.int64()), ("total", pa.int64())]
    return pa.Table.from_pylist(out, schema=pa.schema(kinds))


def _solved(segments: DataFrame) -> DataFrame:
    """Every segment with its start and audit; counts of a cut conversation add up
    to those of the whole."""
    closed = segments.filter("audit IS NOT NULL").select("*", F.lit(0).alias("start"))
    cut = segments.filter("audit IS NULL")
    code = [F.conv(F.hex(F.substring("codes", at, 1)), 16, 10).cast("int") % 4 for at in (1, -1)]
    ends = cut.select("conv_id", "first", "low", "last_turn", "costs", "ranks", code[0].alias("head"), code[1].alias("tail"))
    states = ends.groupBy("conv_id").applyInArrow(
        _chained, "first long, start int, end int, shared long, crossing long, total long"
    )
    joined = cut.join(states.withColumnRenamed("first", "_first"), F.col("first") == F.col("_first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n) for n in ("codes", "start", "end")]
            found = [
                solve(c.as_py(), s.as_py(), TO_END if e.as_py() is None else _only(e.as_py())) for c, s, e in zip(*columns)
            ]
            yield batch.set_column(batch.schema.get_field_index("audit"), "audit", pa.array(found, pa.string()))

    opened = map_arrow(joined, run, joined.schema)
    return closed.unionByName(
        opened.select(
            *[c for c in segments.columns if c not in ("cost", "illegal", "turns")],
            "start",
            F.col("total").alias("cost"),
            (F.col("illegal") + F.col("crossing")).alias("illegal"),
            (F.col("turns") - F.col("shared")).alias("turns"),
        )
    )


def _row_edits(solved: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, start, audit, first in zip(*(batch.column(n).to_pylist() for n in ("codes", "start", "audit", "first"))):
                before, kind, after = zip(*edits(codes, start, audit))
                at = pa.array(range(first, first + len(codes)), pa.int64())
                yield pa.RecordBatch.from_arrays([at, pa.array(before), pa.array(kind), pa.array(after)], names=["at", "before", "kind", "after"])

    return map_arrow(solved.select("codes", "start", "audit", "first"), run, "at long, before string, kind string, after string")


def _digests(lines: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's repaired lines, read as a stream: for each
    row its edit, then its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, any_line, edit, out = None, None, False, None, []

        def line(role: str, text: str) -> None:
            nonlocal any_line
            sha.update(("\n" * any_line + f"{role}:{text}").encode())
            any_line = True

        names = dict(zip(INITIALS, ("system", "user", "assistant")))
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "side", "before", "kind", "after", "role", "text")]
            for i, side, before, kind, after, role, text in zip(*columns):
                if sha is None or i != conv:
                    if sha is not None:
                        out.append((conv, sha.hexdigest()))
                    conv, sha, any_line = i, hashlib.sha256(), False
                if side == 0:
                    edit = (before, kind, after)
                    continue
                before, kind, after = edit
                for x in before:
                    line(names[x], "")
                if kind != "D":
                    line(names.get(kind, role), text)
                for x in after:
                    line(names[x], "")
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string()))], names=["conv_id", "sha"])
                out.clear()
        if sha is not None:
            out.append((conv, sha.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string()))], names=["conv_id", "sha"])

    order = [F.col(c).asc_nulls_first() for c in (*_ORDER, "side")]
    return map_arrow(lines.repartition("conv_id").sortWithinPartitions(*order), run, "conv_id long, sha string")


def repair(conversations: DataFrame, block_rows: int = 1 << 16) -> DataFrame:
    """Per conversation of the table: gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256."""
    rows = damaged(conversations)
    facts = _facts(rows)
    solved = write_table(_solved(_segments(_with_duplicates(facts), block_rows)), "turn-audits")
    nothing = F.lit(None).cast("string")
    edited = _row_edits(solved).join(facts.drop("code"), "at").select(
        *_ORDER, F.lit(0).alias("side"), "before", "kind", "after", nothing.alias("role"), nothing.alias("text")
    )
    texts = rows.select(*_ORDER, F.lit(1).alias("side"), *[nothing.alias(c) for c in ("before", "kind", "after")], "role", "text")
    sums = ("blank", "duplicate", "truncated", "illegal", "cost", "turns")
    counted = solved.select("conv_id", *sums, "low", "high", F.struct("first", "audit").alias("piece"), nothing.alias("sha"))
    parts = counted
    for other in (
        conversations.select(field(conversations, "conv_id", "long")).distinct().select("conv_id", nothing.alias("sha")),
        _digests(edited.unionByName(texts)),
    ):
        parts = parts.unionByName(other, allowMissingColumns=True)
    audit = F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["audit"]), "")
    whole = parts.groupBy("conv_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        audit.alias("audit"),
        F.coalesce(F.max("sha"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
    span = F.try_subtract(F.try_subtract(F.col("high"), F.col("low")), F.col("turns") - 1)
    return whole.select(
        "conv_id",
        F.when(F.col("low").isNull(), F.lit(0)).otherwise(span).cast("long").alias("gaps"),
        *[F.col(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        "audit",
        "repaired_sha256",
    )
