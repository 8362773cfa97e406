import random
import re

from tidewater.llm import ngram_join

SCHEMA = "doc_id long, text string, n string, cls string, id string"


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both * 100 >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, "a b"), (6, "a b c d"), (7, "a b c d")]
    i = 10
    shared = [r.choice(vocab) for _ in range(25)]
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.randint(5, 150))]
        if r.random() < 0.5:
            base = shared + base
        for _ in range(r.randint(1, 7)):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, " ".join(w)))
            i += 1
    rows.append((i, " ".join(r.choice(vocab) for _ in range(5000))))
    return rows


def test_join_matches_brute_force(spark):
    for size, percent in ((4, 85), (5, 80)):
        rows = corpus(size)
        df = spark.createDataFrame([(a, b, "x", "y", "z") for a, b in rows], SCHEMA)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, size=size, percent=percent).collect()}
        assert got == brute(rows, size, percent)


def test_one_of_each_keeps_columns_and_one_document(spark):
    rows = corpus(9)
    df = spark.createDataFrame([(a, b, "x", "y", "z") for a, b in rows], SCHEMA)
    out = ngram_join.one_of_each(df)
    assert out.columns == df.columns
    want = {i for i, (_, c) in brute(rows, 5, 80).items() if i == c}
    assert {r["doc_id"] for r in out.collect()} == want


def test_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_large_group_of_near_copies(spark):
    # Copies of one template with few to many words changed, most of them in places of their own, and copies of two variants.
    r = random.Random(11)
    base = [f"t{k}" for k in range(160)]
    variants = [base, base[:60] + [f"u{k}" for k in range(25)] + base[85:], [f"v{k}" for k in range(18)] + base[18:]]
    rows = []
    for i in range(900):
        w = list(r.choice(variants))
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 8, 12])):
            w[r.randrange(len(w))] = f"x{i}_{r.randrange(1000)}" if r.random() < 0.8 else "same"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(a, b, "x", "y", "z") for a, b in rows], SCHEMA)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.join(df).collect()}
    assert got == brute(rows, 4, 85)


def test_repeated_ids_are_rows_of_their_own(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(7, a), (7, a), (7, b), (3, a + " end"), (9, b + " end"), (5, None)]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.join(df).collect())
    assert got == [(3, 58, 3), (5, 0, 5), (7, 57, 3), (7, 57, 3), (7, 57, 7), (9, 58, 7)]
