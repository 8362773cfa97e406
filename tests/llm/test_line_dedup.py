import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tidewater.llm import bytesops as B
from tidewater.llm import line_dedup

SCHEMA = "doc_id long, text string, line string, cls string, id string"


def brute_all(rows, percent=80):
    seen, out = [], {}
    for i, t in sorted(rows):
        kept = []
        for x in (t or "").split("\n"):
            w = set(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x)))
            if not (w and any(len(w & s) * 100 >= percent * len(w | s) for s in seen)):
                kept.append(x)
            if w:
                seen.append(w)
        out[i] = None if t is None else "\n".join(kept)
    return out


def corpus():
    r = random.Random(5)
    vocab = [f"v{k}" for k in range(80)] + ["the", "of"] * 20
    pool = [[r.choice(vocab) for _ in range(r.randint(1, 30))] for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, " \n x \n X\n"), (4, "a a b")]
    for i in range(10, 80):
        lines = []
        for _ in range(r.randint(1, 8)):
            w = list(r.choice(pool))
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    rows.append((99, "\n".join(" ".join(r.choice(vocab) for _ in range(12)) for _ in range(300))))
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(a, b, "l", "c", "i") for a, b in rows], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in line_dedup.report(df).collect()}
    assert got == brute_all(rows)


def test_clean_keeps_columns(spark):
    rows = corpus()
    df = spark.createDataFrame([(a, b, "l", "c", "i") for a, b in rows], SCHEMA)
    out = line_dedup.clean(df)
    assert out.columns == df.columns
    want = {i for i, t in brute_all(rows).items() if (t or "").strip() or t == dict(rows)[i]}
    assert {r["doc_id"] for r in out.collect()} == want
    assert line_dedup.report(df.limit(0)).count() == 0


def test_one_changed_word_in_a_short_line(spark):
    # 11 words against 11 with one changed in the middle: 10 of 12 words are common, but only 2 of 12 five-word shingles.
    a = "one two three four five six seven eight nine ten eleven"
    rows = [(1, a), (2, a.replace("six", "other") + "\nkept"), (3, "p q r s t u v w x"), (4, "x w v u t s r q p")]
    df = spark.createDataFrame([(i, t, "l", "c", "i") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in line_dedup.report(df).collect()}
    assert got == {1: (a, 0), 2: ("kept", 1), 3: ("p q r s t u v w x", 0), 4: ("", 1)}


def test_large_groups_match_brute_force(spark, monkeypatch):
    # Lines near one template, with few to many words changed, are held against leaders first.
    monkeypatch.setattr(line_dedup, "LARGE", 20)
    r = random.Random(9)
    base = [f"t{k}" for k in range(40)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(2):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 9])):
                w[r.randrange(len(w))] = f"x{r.randrange(3000)}" if r.random() < 0.7 else "same"
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame([(a, b, "l", "c", "i") for a, b in rows], SCHEMA)
    assert {x["doc_id"]: x["text"] for x in line_dedup.report(df).collect()} == brute_all(rows)


def test_repeated_ids(spark):
    # Rows that repeat an id stand at the same places: neither counts as earlier.
    rows = [(1, "a b c\nd e f"), (1, "a b c\nx y z"), (1, "a b c\nd e f"), (2, "q\na b c\nx y z\nd e f"), (3, None)]
    df = spark.createDataFrame([(a, b, "l", "c", "i") for a, b in rows], SCHEMA)
    got = sorted((x["doc_id"], x["text"] or "", x["n_removed_lines"]) for x in line_dedup.report(df).collect())
    assert got == [(1, "a b c\nd e f", 0), (1, "a b c\nd e f", 0), (1, "a b c\nx y z", 0), (2, "q", 3), (3, "", 0)]


def test_only_wanted_lines_are_read_for_words():
    # The words of lines that met another were read from whole texts, all lines of them.
    r = random.Random(4)
    texts = [None, "", "\n", "a\n\nB é"] + ["".join(r.choice("aB \n\té") for _ in range(r.randint(0, 60))) for _ in range(200)]
    (_, data, offsets), *more = list(B.text_slices(pa.array(texts)))
    assert not more
    lines = [(t or "").encode().split(b"\n") for t in texts]
    wanted = [(i, k) for i, x in enumerate(lines) for k in range(len(x) + 1) if r.random() < 0.3]
    r.shuffle(wanted)
    wanted.sort(key=lambda x: x[0])
    got, at = line_dedup._pick(data, offsets, *(np.array(x) for x in zip(*wanted, strict=True)))
    want = [lines[i][k] if k < len(lines[i]) else b"" for i, k in wanted]
    assert [got[a:z].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)] == want


def test_entries_of_one_class_are_not_paired():
    # Words that only one class has were sorted, grouped and looked up with the others; the order under equal upper bits must hold too.
    r = np.random.default_rng(6)
    post = np.zeros(4000, line_dedup.POST)
    post["t"], post["cls"] = r.integers(0, 900, 4000), r.integers(0, 300, 4000) << r.choice([0, 50], 4000)
    post["n"] = post["cls"] % 7 + 1
    post = np.concatenate([post, post[:500]])
    have = {(int(t), int(n), int(c)) for t, n, c in zip(post["t"], post["n"], post["cls"], strict=True)}
    met = Counter(t for t, _, _ in have)
    got = line_dedup._shared(post)
    assert list(zip(got["t"].tolist(), got["n"].tolist(), got["cls"].tolist(), strict=True)) == sorted(x for x in have if met[x[0]] > 1)
    assert [len(x) for x in line_dedup.near_pairs(post[:1], 80)] == [0, 0, 0]


def test_lines_that_share_only_a_common_word_do_not_meet(spark, monkeypatch):
    # Under each word of a small vocabulary over a thousand unlike lines met; all were read for words and held against each other's leaders.
    monkeypatch.setattr(line_dedup, "OFTEN", 50, raising=False)
    seen, plain = [], line_dedup._large_groups
    monkeypatch.setattr(line_dedup, "_large_groups", lambda groups, *a: seen.append(groups.count()) or plain(groups, *a))
    r = random.Random(3)
    rows = [(i, "\n".join(" ".join(r.sample([f"w{k}" for k in range(40)], 10)) for _ in range(50))) for i in range(110)]
    line_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert seen == [0]


def test_pairs_of_common_words_match_brute_force(spark, monkeypatch):
    # Nearly all words count as often used; lines are short, long, and about as long as those whose words stand alone.
    monkeypatch.setattr(line_dedup, "OFTEN", 3, raising=False)
    r = random.Random(8)
    vocab = [f"w{k}" for k in range(260)]
    pool = [r.sample(vocab, n) for n in (1, 2, 4, 5, 6, 9, 10, 20, 40, 78, 80, 82, 95, 99, 100, 101, 104, 120, 126) for _ in range(3)]
    rows = []
    for i in range(160):
        lines = []
        for _ in range(3):
            w = list(r.choice(pool))
            for _ in range(r.randint(0, max(1, len(w) // 6))):
                w[r.randrange(len(w))] = r.choice(vocab)
            lines.append(" ".join(w[: len(w) - r.randint(0, len(w) // 8)]))
        rows.append((i, "\n".join(lines)))
    got = line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x["doc_id"]: x["text"] for x in got.collect()} == brute_all(rows)
