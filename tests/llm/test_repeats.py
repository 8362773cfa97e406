import hashlib
import random
from collections import Counter

import numpy as np

from tidewater.llm import repeats

SCHEMA = "doc_id long, text string, h string, pos string, id string"


def brute(rows, width):
    seen = Counter()
    raw = {i: (t or "").encode() for i, t in rows}
    for b in raw.values():
        for k in range(len(b) - width + 1):
            seen[b[k : k + width]] += 1
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(r.randint(15, 60)) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "x" * 900), (3, "ab" * 300), (4, shared[0]), (5, shared[0]), (6, "y" * 39), (7, "y" * 40), (8, "y" * 41)]
    base = text(200)
    for i in range(10, 40):
        parts = [text(r.randint(1, 60))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(shared), text(r.randint(0, 20))]
        if r.random() < 0.4:
            b = list(base)
            for _ in range(r.randint(0, 6)):
                b[r.randrange(len(b))] = "Q"
            parts.append("".join(b))
        rows.append((i, " ".join(parts)))
    rows.append((50, text(3000) + shared[1] + shared[1]))
    return rows


def check(spark, rows, width, gram):
    df = spark.createDataFrame([(a, b, "x", "y", "z") for a, b in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove(df, width=width, gram=gram).drop("kept").collect()}
    assert got == brute(rows, width)


def test_matches_brute_force(spark):
    check(spark, corpus(1), 40, 20)


def test_hot_anchors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    monkeypatch.setattr(repeats, "SHARE", 2)
    check(spark, corpus(2), 40, 20)


def test_empty_table(spark):
    assert repeats.remove(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_ids_are_documents_of_their_own(spark):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = text(90)
    rows = [(1, text(50) + shared), (1, shared + text(70)), (1, text(200)), (2, "q" + text(120)), (3, None)]
    rows += [rows[3]]
    df = spark.createDataFrame([(a, b, "x", "y", "z") for a, b in rows], SCHEMA)
    want = sorted((k[0], *v) for k, v in zip(rows, brute(list(enumerate(t for _, t in rows)), 40).values(), strict=True))
    got = sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in repeats.remove(df, width=40, gram=20).collect())
    assert got == want
