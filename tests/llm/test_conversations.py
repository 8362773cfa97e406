"""Repair against exhaustive search on tiny conversations and a plain search over whole strings on all rows."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from tidewater.llm import conversations as C
from tidewater.llm.queries import op12_repair

SPACES = " \t\n\x0b\x0c\r"
FORM = re.compile(r"(s?(ua)+)?")


def faults(rows: list[tuple]) -> list[str]:
    out, seen = [], set()
    for role, text in rows:
        text_ = text.rstrip(SPACES)
        out.append("blank" if not text_ else "duplicate" if (role, text) in seen else "truncated" if text_[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def least(rows: list[tuple], told: list[str]) -> tuple[int, str]:
    """Least (cost, audit) by a search over whole strings, one letter at a time, with three inserts in a row at most."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(maxsize=None)
    def go(k: int, last: str, inserts: int) -> tuple[int, str]:
        found = []
        if k == len(rows):
            if last in ("", "a"):
                found.append((0, ""))
        else:
            more = int(told[k] == "truncated")
            found.append((3, "D", k + 1, last))
            if told[k] in ("", "truncated"):
                own = rows[k][0][:1]
                if own and own in follow[last]:
                    found.append((more, "K", k + 1, own))
                found += [(2 + more, "R", k + 1, c) for c in "ua" if c in follow[last]]
        ends = [x for x in found if len(x) == 2]
        for cost, letter, nk, nl in (x for x in found if len(x) == 4):
            c, a = go(nk, nl, 0)
            ends.append((cost + c, letter + a))
        if inserts < 3:
            for c in "ua":
                if c in follow[last]:
                    cost, a = go(k, c, inserts + 1)
                    ends.append((2 + cost, "I" + a))
        return min(ends, default=(10**9, ""))

    return go(0, "", 0)


def exhaustive(rows: list[tuple], told: list[str]) -> tuple[int, str]:
    """All lists of edits with two inserts at most at each place, held against the form as a pattern."""
    best = []
    inserts = ["", "u", "a", "ua", "au"]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product("DKua", repeat=len(rows)):
            roles, audit, cost = gaps[0], "I" * len(gaps[0]), 2 * sum(map(len, gaps))
            for (role, _), fault, e, gap in zip(rows, told, edits, gaps[1:], strict=True):
                if e != "D" and fault in ("blank", "duplicate"):
                    break
                cost += 3 if e == "D" else (fault == "truncated") + 2 * (e != "K")
                roles += ("" if e == "D" else (role[:1] or "?") if e == "K" else e) + gap
                audit += ("R" if e in "ua" else e) + "I" * len(gap)
            else:
                if FORM.fullmatch(roles):
                    best.append((cost, audit))
    return min(best)


def written(rows: list[tuple], audit: str) -> str:
    n, out, k = len(audit) - audit.count("D"), [], 0
    for letter in audit:
        role, text = (None, "") if letter == "I" else rows[k]
        k += letter != "I"
        if letter != "D":
            want = "s" if n % 2 and not out else "ua"[(len(out) - n % 2) % 2]
            role = role if letter == "K" else {"u": "user", "a": "assistant"}[want]
            assert role[:1] == want
            out.append(f"{role}:{text}")
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def damaged(rows: list[tuple]) -> dict:
    """(conv, turn, role, text) rows -> the rows after damage by conversation, in order; dropped ones leave their conversation."""
    out: dict = {}
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        held = out.setdefault(conv, [])
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        held += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    for held in out.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    return out


def expected(rows: list[tuple]) -> dict:
    out = {}
    for conv, held in damaged(rows).items():
        pairs, turns = [r[1:] for r in held], [r[0] for r in held if r[0] is not None]
        told = faults(pairs)
        cost, audit = least(pairs, told)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, told.count("blank"), told.count("duplicate"), told.count("truncated"), illegal, cost, audit, written(pairs, audit))
    return out


def result(df, conv="conv_id") -> dict:
    return {r[conv]: tuple(r[c] for c in (*C.STATS, "audit", "repaired_sha256")) for r in df.collect()}


def classes(rows: list[tuple]) -> np.ndarray:
    kind = {"": 0, "blank": 1, "duplicate": 1, "truncated": 2}
    return np.array([4 * kind[f] + "sua".find(r[:1]) % 4 if r[:1] in ("s", "u", "a") else 4 * kind[f] + 3 for (r, _), f in zip(rows, faults(rows), strict=True)], np.uint8)


ROLES, TEXTS = ["system", "user", "assistant", "tool", "", " "], ["fine.", "fine!", "cut off", " \t", "", "other?\n"]


def test_tiny_conversations_against_all_lists_of_edits():
    rng = random.Random(1)
    convs = [[(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randrange(4))] for _ in range(120)]
    for rows, got in zip(convs, C.repair([classes(r) for r in convs]), strict=True):
        assert got == exhaustive(rows, faults(rows)) == least(rows, faults(rows))


@pytest.mark.parametrize("block", [1, 3, 7, 4096])
def test_blocks_give_the_plain_result(monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "TOGETHER", 64)
    rng = random.Random(block)
    convs = [[(rng.choice(ROLES), rng.choice(TEXTS) + (str(k) + "." if rng.random() < 0.7 else "")) for k in range(rng.randrange(60))] for _ in range(60)]
    for rows, got in zip(convs, C.repair([classes(r) for r in convs]), strict=True):
        assert got == least(rows, faults(rows))


def test_a_conversation_of_many_rows():
    rng = random.Random(9)
    rows = np.array([rng.randrange(12) for _ in range(100_000)], np.uint8)
    cost, audit = C.repair([rows])[0]
    assert sum(c != "I" for c in audit) == len(rows) and cost > 0


def test_the_query_is_the_plain_version_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(op12_repair(spark, sf)) == expected(rows)


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(12)]), rng.choice([None, *ROLES]), rng.choice([None, *TEXTS])) for _ in range(150)]
    rows += [(7, k, "user", "again.") for k in range(40)] * 2 + [(8, 5, "assistant", "x" * 200_000)] + [(k, 0, "user", "only.") for k in range(100, 160)]
    df = spark.createDataFrame([(*r, "x", 1, "x") for r in rows], "conv_id long, turn long, role string, text string, digest string, copies int, head string")
    assert result(C.repaired(C.damage(df))) == expected(rows)
    assert C.repaired(C.damage(df.limit(0))).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert result(C.repaired(C.damage(df))) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_undamaged_rows_of_other_types(spark):
    df = spark.createDataFrame([("a", 1, "user", "hi."), ("a", 2, "assistant", "yes."), ("b", 1, "user", "hm")], "name string, turn int, who string, said string")
    got = result(C.repaired(C.whole(df, "name", "turn", "who", "said"), "name"), "name")
    assert got["a"][5:7] == (0, "KK") and got["b"][5:7] == (3, "D")
