import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, licenses, mixing, quality_neighbours, quality_rules, token_counts, toxicity
from tidewater.llm import bytesops as B

SCHEMA = "doc_id long, text string, h string, w string, id string"
ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "x"), (4, "x"), (5, "a b c d e f g " * 3000), (6, "é ß ñ 　 \x0b z")]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "1", "2", "3") for a, b in rows], SCHEMA)


def test_sliding_argmin_matches_windows():
    r = np.random.default_rng(1)
    for n, w, hi in ((50, 7, 5), (200, 13, 1 << 30), (30, 30, 3), (5, 9, 3), (300, 20, 2)):
        v = r.integers(0, hi, n).astype(np.uint64) << np.uint64(24)
        want = sorted({i + int(np.argmin(v[i : i + w])) for i in range(n - w + 1)})
        assert B.sliding_argmin(v, w).tolist() == want


# Token counts


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(2)
    rows = ODD + [(10, "hello <|endoftext|> world<|endoftext|>"), (11, "z" * 5000), (12, "".join(r.choice("ab 1.\n'sé") for _ in range(4000)))]
    want = {i: len(t.encode(x or "", add_special_tokens=False)) for i, x in rows}
    got = {x["doc_id"]: x["n_tokens"] for x in token_counts.count_documents(frame(spark, rows)).collect()}
    assert got == want
    for i, x in rows:  # small chunks force splices and wider overlaps
        assert token_counts.count_tokens(x or "", "byte_bpe_50k.tiktoken", chunk=97, overlap=8)[0] == want[i]
    # Texts of many chunks at the production size, with runs that no short overlap can break.
    for seed in range(3):
        q = random.Random(seed)
        x = "".join(q.choice(["é", "日本", "word ", "  ", "\n\n", "12345", "it's", "." * 40, " " * 3000, "x" * 2500, "\U0001f600"]) for _ in range(12_000))
        n, chunks = token_counts.count_tokens(x, "byte_bpe_50k.tiktoken")
        assert chunks > 5 and n == len(t.encode(x, add_special_tokens=False))


# Quality rules


def base_of(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed


def test_rule_measurements_match_brute_force(spark):
    r = random.Random(4)
    rows = ODD + [(20 + k, "\n".join(" ".join(r.choice(["a", "bb", "#c", "d|", "é"]) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 20)))) for k in range(30)]
    got = {x[0]: tuple(x[1:7]) for x in quality_rules.judge(frame(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: base_of(t) for i, t in rows}
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_em_separates_planted_classes():
    r = random.Random(1)
    votes = Counter()
    for _ in range(4000):
        good = r.random() < 0.8
        votes[tuple((1 if good else 0) if r.random() < 0.85 else (0 if good else 1) for _ in range(5))] += 1
    prior, table = quality_rules.fit(sorted(votes.items()))
    assert abs(prior - 0.8) < 0.05
    assert quality_rules.posterior((1,) * 5, prior, table) > 0.95 > 0.05 > quality_rules.posterior((0,) * 5, prior, table)


def test_em_decides_and_leaves_clean_corpora_alone():
    """Two accurate rules against four that guess: estimated accuracies beat equal votes. Without bad documents nothing is dropped."""
    r = random.Random(3)
    rows = []
    for _ in range(6000):
        good = int(r.random() < 0.75)
        sure = [good if r.random() < 0.97 else 1 - good for _ in range(2)]
        rows.append((good, (*sure, *(-1 if r.random() < 0.2 else r.choice([1, 1, 1, 0]) for _ in range(4)))))
    patterns = sorted(Counter(v for _, v in rows).items())
    right = {}
    for rounds in (0, 60):
        prior, table = quality_rules.fit(patterns, rounds=rounds)
        right[rounds] = sum((quality_rules.posterior(v, prior, table) >= 0.5) == bool(g) for g, v in rows) / len(rows)
    assert right[60] > 0.95 and right[60] > right[0] + 0.02
    clean = Counter(tuple(-1 if r.random() < 0.3 else int(r.random() > 0.002) for _ in range(8)) for _ in range(6000))
    prior, table = quality_rules.fit(sorted(clean.items()))
    assert sum(n for v, n in clean.items() if quality_rules.posterior(v, prior, table) < 0.5) == 0


# Licences


def test_licences(spark):
    rows = ODD + [
        (10, "Foo. Released under the MIT License. MIT licensed? mit license"),
        (11, "Licensed under the Apache License, Version 2.0."),
        (12, "This work is licensed under the GNU General Public License, version 3."),
        (13, "All rights reserved."),
        (14, "Licensed under CC BY-NC 4.0."),
        (15, "rights and all were reserved by the apache, licensed in 2 0"),
        (16, "Mİt licenſe"),
    ]
    got = {x["doc_id"]: x for x in licenses.scan(frame(spark, rows)).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = sorted(k for p in licenses.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        labels = sorted({lab for p, lab in licenses.BASE_PHRASES.items() if any(w[k : k + len(p.split())] == p.split() for k in range(len(w)))})
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], got[i]["base_labels"]) == (len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(labels)), i
    assert [got[k]["labels"] for k in (10, 11, 12, 13, 14, 15)] == ["mit", "apache", "gpl", "proprietary", "cc-by-nc", ""]
    assert licenses.scan(frame(spark, [])).count() == 0


def test_license_templates_match_brute_force(spark):
    """Each template is found whole, with words around it and every ninth word lost; without its key phrase it is not. Repeated ids stand apart."""
    rows, want = [], {}
    for k, (label, text, key) in enumerate(licenses.TEMPLATES):
        w = text.split()
        rows.append((k, "Foo bar. " + text.upper() + " qux"))
        want[k] = label
        at = next(i for i in range(len(w)) if w[i : i + len(key.split())] == key.split())
        lost = ["zz" if i % 9 == 8 and not at <= i < at + len(key.split()) else x for i, x in enumerate(w)]
        rows.append((100 + k, " ".join(lost)))
        want[100 + k] = label
        rows.append((200 + k, " ".join(x for i, x in enumerate(w) if not at <= i < at + len(key.split()))))
    rows += [(300, "all rights reserved"), (300, "nothing here"), (300, "all rights reserved")]
    got = licenses.scan(frame(spark, rows)).select("doc_id", "labels", "score").collect()
    for x in got:
        if x["doc_id"] < 200:
            assert want[x["doc_id"]] in x["labels"].split(","), x
        elif x["doc_id"] < 300:
            assert licenses.TEMPLATES[x["doc_id"] - 200][0] not in x["labels"].split(","), x
    assert sorted(x["labels"] for x in got if x["doc_id"] == 300) == ["", "proprietary", "proprietary"]


# Decontamination


def test_decontamination_finds_planted_items(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(r.randint(20, 50)))) for k in range(30)] + [(90, None), (91, ""), (92, "only four words here")]
    rows, want = list(ODD), {i: [] for i, _ in ODD}
    for i in range(20, 60):
        filler = [word() for _ in range(r.randint(30, 200))]
        item = r.choice(items[:30])
        hit = r.random() < 0.5
        at = r.randrange(len(filler))
        body = item[1].upper().split() if hit else item[1].split()[:6]
        rows.append((i, " ".join(filler[:at] + body + filler[at:])))
        want[i] = [item[0]] if hit else []
    rows.append((70, "Only four words here"))
    want[70] = [92]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: x["item_ids"] for x in decontaminate.report(frame(spark, rows), bench).collect()}
    assert got == want
    kept = decontaminate.clean(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns
    assert {x["doc_id"] for x in kept.collect()} == {i for i, v in want.items() if not v}
    assert decontaminate.report(frame(spark, []), bench).count() == 0
    assert decontaminate.clean(frame(spark, rows), bench.limit(0)).count() == len(rows)


# Mixing


def test_mixing_meets_budget_and_entropy(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(r.randint(1, 40))), "big" if i % 3 else f"s{i % 7}" if i % 5 else None) for i in range(3000)] + [(5000, None, "s1"), (5001, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, entropy=0.9, max_repeats=3.0, block_tokens=50).toPandas()
    assert len(out) == len(rows)
    tokens = out.groupby("source").n_tokens.sum()
    spent = (out.n_tokens * out.copies).groupby(out.source).sum()
    weight = out.groupby("source").weight.first()
    assert (spent <= weight * tokens.sum() + 1e-6).all()
    assert (spent > weight * tokens.sum() - 60).all()
    assert (weight * tokens.sum() / tokens).max() <= 3.0 + 1e-9
    again = mixing.mix(df.repartition(7), entropy=0.9, max_repeats=3.0, block_tokens=50).toPandas()
    assert out.set_index("doc_id").copies.sort_index().equals(again.set_index("doc_id").copies.sort_index())
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_exponent():
    t = {"a": 900, "b": 90, "c": 10}
    w = mixing.mixture(t, mixing.solve(t, 1000, 0.6, 100))
    assert abs(-sum(x * math.log(x) for x in w.values()) / math.log(3) - 0.6) < 1e-6
    assert mixing.solve({"a": 5}, 5, 0.9, 2) == 1.0
    assert max(x * 1000 / t[s] for s, x in mixing.mixture(t, mixing.solve(t, 1000, 1.0, 4.0)).items()) <= 4.0001


# Toxicity


def edit_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1] <= 1


def test_automaton_matches_edit_distance():
    r = random.Random(8)
    terms = ["idiot", "moron", "scum", "pathetic", "idiots"]
    auto = toxicity.compile_lexicon([t.encode() for t in terms], [b"lowei"])
    words = list(terms) + ["lowei", "loweixx", "lowe"]
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(r.randint(1, 2)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randint(0, 1)] = r.choice(["", "a", "i", "o"])
            words.append("".join(w) or "q")
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = B.words(data, np.array([0, len(data)]))
    for w, got in zip(words, toxicity.read_words(auto, data, s, e), strict=True):
        if w in terms:
            want = toxicity.EXACT
        elif w.startswith("lowei"):
            want = toxicity.PREFIX
        elif any(len(t) >= 5 and edit_within_one(w, t) for t in terms):
            want = toxicity.FUZZY
        else:
            want = -1
        assert got == want, w


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    r = random.Random(12)
    clean = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows, labels = list(ODD), []
    for i in range(100, 700):
        w = [r.choice(clean) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["zidiotz", "zscumzz", "zmoronz"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad), int(not bad)))
    rows += [(900, " ".join(clean[:30]) + " zidioz zidiot zmorxnz"), (901, " ".join(clean[:30]) + ' he said "zidiotz" and left'), (902, " ".join(clean[:40]))]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_finds_terms_and_misspellings(spark, toxic_corpus):
    docs, labels = toxic_corpus
    model = toxicity.train(docs, labels)
    p = {x["doc_id"]: x["p"] for x in docs.select("doc_id", toxicity.score(F.col("text"), model).alias("p")).collect()}
    assert all((p[i] >= 0.3) == (i % 4 == 0) for i in range(100, 700))
    assert all(p[i] < 0.3 for i in (0, 1, 2, 3, 4, 5, 6, 902))
    assert p[901] < p[100]  # quoted, not abusive
    # Misspelt terms alone tell a text off, and it is the automaton's edit that does it.
    assert p[900] >= 0.3 and p[900] > 10 * p[902]
    plain = toxicity.compile_lexicon([], [], [])
    assert toxicity.count_hits(model.auto, docs.where("doc_id = 900").toArrow()["text"])[0].tolist()[:4] == [0, 0, 3, 0]
    assert toxicity.count_hits(plain, docs.where("doc_id = 900").toArrow()["text"])[0].tolist()[:4] == [0, 0, 0, 0]
    assert (model.weights[1:] >= 0).all()
    none = toxicity.train(docs, labels.limit(0))
    assert docs.select(toxicity.score(F.col("text"), none).alias("p")).agg(F.max("p")).first()[0] < 1e-6
    assert docs.limit(0).select(toxicity.score(F.col("text"), model)).count() == 0


def test_neighbours_vote(spark, toxic_corpus):
    r = random.Random(5)
    rows = [(i, " ".join("".join(r.choice("abcdef") for _ in range(5)) + ("###" if i % 3 == 0 else "") for _ in range(50))) for i in range(300)]
    docs = frame(spark, rows + [(i + 1000, t) for i, t in ODD])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int")
    model = quality_neighbours.train(docs, labels)
    # Neither the order of the rows nor their partitions change a score.
    one = lambda d: sorted((x["doc_id"], x["p"]) for x in d.select("doc_id", quality_neighbours.score(F.col("text"), model).alias("p")).collect())
    assert one(docs) == one(docs.repartition(7, F.xxhash64("doc_id"))) == one(docs.orderBy(F.desc("doc_id")).coalesce(1))
    p = {x["doc_id"]: x["p"] for x in docs.select("doc_id", quality_neighbours.score(F.col("text"), model).alias("p")).collect()}
    assert all((p[i] >= 0.3) == (i % 3 > 0) for i in range(300))
    assert p[1000] == p[1001] == 0
    assert quality_neighbours.train(docs, labels.limit(0)) is None


# Brute force for what SQL cannot express


def test_vote_matches_brute_force():
    r = np.random.default_rng(5)
    train = r.standard_normal((60, 6)).astype(np.float32)
    train /= np.linalg.norm(train, axis=1, keepdims=True)
    train[40:50] = train[0]  # ties
    labels = (r.random(60) < 0.6).astype(np.float32)
    docs = r.standard_normal((1100, 6)).astype(np.float32)
    docs /= np.linalg.norm(docs, axis=1, keepdims=True)
    docs[7] = 0
    got = quality_neighbours.vote(docs, quality_neighbours.Model(None, None, train, labels), voters=9)
    for d, p in zip(docs, got, strict=True):
        sims = [round(float(np.float32(d @ t)), 4) for t in train]
        last = sorted(sims)[-9]
        w = [max(s, 0) ** 4 if s >= last - 1e-9 else 0 for s in sims]
        want = sum(x * y for x, y in zip(w, labels, strict=True)) / sum(w) if sum(w) else 0.0
        assert abs(p - want) < 0.02


def test_terms_of_a_text_depend_on_that_text_only():
    import pyarrow as pa

    r = random.Random(3)
    texts = ["", None, "a a b\na a b\nC!! 12", "ÉÉ %% |"] + ["".join(r.choice("aB1 \n%é") for _ in range(r.randint(0, 300))) for _ in range(200)]
    alone = np.concatenate([quality_neighbours._term_counts(pa.array([t], pa.string())) for t in texts])
    assert np.array_equal(alone, quality_neighbours._term_counts(pa.array(texts)))
    assert np.array_equal(alone[::-1], quality_neighbours._term_counts(pa.array(texts[::-1])))
    for t, row in zip(texts, alone, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [tuple(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (t or "").split("\n")]
        lines = [tuple(sorted(x)) for x in lines if x]
        base = quality_neighbours.WORDS + quality_neighbours.SHAPES
        assert row[: quality_neighbours.WORDS].sum() == row[quality_neighbours.WORDS : base].sum() == len(w)
        assert row[base] == sum(a == b for a, b in zip(w, w[1:], strict=False))
        assert row[base + 1] == len(lines) - len(set(lines))


def test_dose_matches_brute_force():
    import pyarrow as pa

    r = random.Random(6)
    terms, stems, known = ["idiot", "moron", "loser"], ["lowei"], ["idiom", "closer", "morons"]
    auto = toxicity.compile_lexicon([t.encode() for t in terms], [s.encode() for s in stems], [k.encode() for k in known])
    pool = [*terms, *known, "loweiung", "idiots", "idyot", "lser", "moro", "fine", "words", "here", "lose"]
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 25))) for _ in range(80)] + ['he said "idiot" ok', "«moron»", None, ""]
    hits = toxicity.count_hits(auto, pa.array(texts))
    for t, h in zip(texts[:80], hits, strict=False):
        exact = sum(w in terms for w in t.split())
        prefix = sum(w.startswith("lowei") for w in t.split())
        fuzzy = sum(w not in terms and w not in known and not w.startswith("lowei") and any(edit_within_one(w, x) for x in terms) for w in t.split())
        assert h.tolist() == [exact, prefix, fuzzy, 0, len(t.split())]
    assert hits[80].tolist() == [0, 0, 0, 1, 4] and hits[81].tolist() == [0, 0, 0, 1, 1]
    assert toxicity.design(hits)[80][2] == pytest.approx(math.log1p(0.2))


def test_posteriors_match_brute_force(spark):
    r = random.Random(13)
    good = [f"word{k}" for k in range(300)]
    rows = list(ODD)
    for i in range(20, 220):
        kind = r.choice(["good", "good", "good", "marks", "caps", "same"])
        w = [r.choice(good) + ("," if r.random() < 0.1 else "") for _ in range(r.randint(40, 160))]
        if kind == "marks":
            w = [x + "%%%" for x in w]
        elif kind == "caps":
            w = [x.upper() + "!!" for x in w]
        elif kind == "same":
            w = [w[0]] * len(w)
        rows.append((i, " ".join(w)))

    def votes(t):
        t = t or ""
        n, chars, sym, dup, rep, _ = base_of(t)
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
        up, points, bangs = len(re.findall("[A-Z]", t)), len(re.findall("[.,;:?]", t)), t.count("!")
        runs = len(re.findall(r"[!-/:-@\[-`{-~]{2,}|(?<!\S)[!-/:-@\[-`{-~](?!\S)", t, re.A))
        kinds, marks = len(set(w)), sym + points + bangs
        vote = lambda bad, ok: 0 if bad else 1 if ok else -1
        return (
            vote(sym * 20 > n, sym * 100 <= n), vote(marks * 8 > chars, marks * 20 <= chars), vote(runs * 20 > n, runs * 100 <= n), vote(up * 2 > chars, up * 5 <= chars), vote(bangs * 10 > n, bangs * 100 <= n), vote(rep * 4 > n, rep * 10 <= n),
            vote(kinds * 3 < n, kinds * 2 >= n), vote(dup * 3 > lines and lines >= 3, dup == 0), vote(chars > n * 14 or chars < n * 2, n * 3 <= chars <= n * 10), vote(n < 5, n >= 100), vote(points * 100 < n, points * 25 >= n),
        )

    all_votes = {i: votes(t) for i, t in rows}
    prior, table = quality_rules.fit(sorted(Counter(all_votes.values()).items()))
    got = {x["doc_id"]: x for x in quality_rules.judge(frame(spark, rows)).collect()}
    for i, t in rows:
        p = quality_rules.posterior(all_votes[i], prior, table)
        assert abs(got[i]["quality"] - p) < 1e-9, i
        assert got[i]["kept"] == (not base_of(t)[5] and p >= 0.5)
    assert any(not x["base_failed"] and not x["kept"] for x in got.values())  # the posterior decides
