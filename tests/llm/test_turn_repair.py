"""Repair of conversations against a plain version that holds every audit."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from shiftwise.llm import turn_repair as R
from tests.llm.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv, turn, role, text in rows:
        name = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(":".join(name).encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        yield from [(conv, turn, role, text)] * (2 if fate == 3 else 1)


def best_edits(rows):
    """(cost, audit, repaired lines) by dynamic programming over whole audits."""
    state = {0: (0, "", [])}  # 0 nothing, 1 system, 2 user, 3 assistant

    def insert(found):
        changed = True
        while changed:
            changed = False
            for s, (cost, audit, lines) in list(found.items()):
                z = 3 if s == 2 else 2
                new = (cost + 3, audit + "I", lines + [("assistant:" if z == 3 else "user:")])
                if z not in found or new[:2] < found[z][:2]:
                    found[z], changed = new, True
        return found

    for role, text, fault in rows:
        state, new = insert(state), {}
        more = 3 if fault == "truncated" else 0
        for s, (cost, audit, lines) in state.items():
            z = 3 if s == 2 else 2
            ways = [(s, 4, "D", [])]
            if fault not in ("blank", "duplicate"):
                ways.append((z, 3 + more, "R", [("assistant:" if z == 3 else "user:") + text]))
                if (role[:1] == "s" and s == 0) or role[:1] == " ua"[z - 1 : z]:
                    ways.append((1 if role[:1] == "s" else z, more, "K", [f"{role}:{text}"]))
            for z2, c, e, line in ways:
                found = (cost + c, audit + e, lines + line)
                if z2 not in new or found[:2] < new[z2][:2]:
                    new[z2] = found
        state = new
    state = insert(state)
    return min((state[s] for s in (0, 3) if s in state), key=lambda x: x[:2])


def plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = [r for r in damage(rows) if r[0] == conv]
        digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))
        seen, faulty = set(), []
        for _, _, role, text in own:
            rest = text.strip(WHITE)
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else None
            fault = fault or ("truncated" if rest[-1] not in ".!?" else "")
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {r[1] for r in own} - {None}
        initials = [r[0][:1] for r in faulty]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = best_edits(faulty)
        counts = [sum(f == k for *_, f in faulty) for k in ("blank", "duplicate", "truncated")]
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, sha))
    return sorted(out, key=str)


def taken(df):
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_least_audit_of_random_rows(seed):
    rnd = random.Random(seed)
    faults = ["", "blank", "truncated", "duplicate"]
    for _ in range(400):
        n = rnd.randrange(0, 14)
        codes = bytes(rnd.choice([0, 1, 1, 2, 2, 3]) + 4 * rnd.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        rows = [("sua "[c % 4], "x", faults[c // 4]) for c in codes]
        cost, audit, _ = best_edits(rows)
        assert R.solve(codes, 0) == audit
        assert R.backward(codes, [c for c, _ in R.TO_END])[0] == cost
        # cut anywhere, the segments' states lead to the same audit
        cuts = sorted(rnd.randrange(n + 1) for _ in range(2)) if n else []
        parts = [p for p in (codes[a:z] for a, z in itertools.pairwise([0, *cuts, n])) if p]
        if parts:
            both = [[R.forward(p, s) for s in range(4)] for p in parts]
            total, states = R.chain([[c for f, _ in b for c in f] for b in both], [[r for _, f in b for r in f] for b in both])
            ends = [R._only(s) for s in states[1:-1]] + [R.TO_END]
            assert total == cost
            assert "".join(R.solve(p, s, e) for p, s, e in zip(parts, states, ends)) == audit


def test_small_table(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert taken(R.repair(table)) == plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def edge_rows():
    rnd = random.Random(3)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]
    texts = ["Yes.", "No!", "cut", None, "", " \t", "ä?", "Yes. ", "é\n"]
    rows = [(c, rnd.choice([None, 0, 1, 2, 3, 9]), rnd.choice(roles), rnd.choice(texts)) for c in range(40) for _ in range(rnd.randrange(1, 9))]
    rows += [(None, t, rnd.choice(roles), rnd.choice(texts)) for t in range(30)]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(0, 200)]  # hot
    rows += [(101, 5, "user", "the same.")] * 12
    rows += [(102, -(2**62), "user", "far."), (102, 2**62 - 5, "assistant", "apart.")]
    rows += [(103, 1, "user", "long " * 200_000 + "."), (103, 2, "assistant", "Yes.")]
    return rows


@pytest.mark.parametrize("block_rows", [1 << 16, 7, 1])
def test_edge_rows_whole_or_cut(spark, tmp_path, block_rows):
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'clash' AS `{c}`" for c in ("at", "first", "conv", "t", "row", "digest", "kind", "sha")])
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    assert taken(R.repair(spark.read.parquet(str(tmp_path / "t")), block_rows)) == plain(rows)


def test_empty_table_and_conversation_without_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    assert taken(R.repair(spark.read.parquet(str(tmp_path / "none")))) == []
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA).write.parquet(str(tmp_path / "gone"))
    empty = hashlib.sha256(b"").hexdigest()
    assert taken(R.repair(spark.read.parquet(str(tmp_path / "gone")))) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
