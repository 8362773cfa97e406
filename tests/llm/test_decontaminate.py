import random

from tidewater.llm import decontaminate


def test_edited_copies_of_short_long_and_repeated_items(spark):
    r = random.Random(4)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    items, docs = [], []
    for k in range(400):
        w = words(50 if k % 2 else 14)
        # Three equal items of every tenth text.
        items += [(k + 1000 * c, " ".join(w)) for c in range(3 if k % 10 == 1 else 1)]
        at = 25 if k % 2 else 13
        docs.append((k, " ".join([*words(8), *w[:at], "edit", *w[at + 1 :], *words(8)])))
    # 41 of 51 shingles are common in long items, 9 of 11 in short ones.
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {k: [] for k, _ in docs}
    for i, _ in items:
        want[i % 1000].append(i)
    assert {x["doc_id"]: sorted(x["item_ids"]) for x in got} == {k: sorted(v) for k, v in want.items()}
    assert {round(x["max_similarity"], 4) for x in got} <= {round(41 / 51, 4), round(9 / 11, 4)}


def test_recall_against_brute_force(spark, monkeypatch):
    """All windows of all documents against all items, by exact weighted similarity: at least 0.9 of the pairs are found, and no other."""
    r = random.Random(8)
    vocab = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.randint(8, 60)))) for k in range(60)]
    items += [(100 + k, " ".join(items[k][1].split()[:-1] + ["tail"])) for k in range(10)]  # near-equal items lower each other's weights
    docs = []
    for i in range(300):
        w = r.choice(items)[1].split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([["x"], [], [w[k], "y"]])
        pad = [r.choice(vocab) for _ in range(30)]
        docs.append((i, " ".join([*pad[:15], *w, *pad[15:]])))
    docs += [(7, docs[0][1]), (7, None), (500, "")]
    sh = lambda t: [tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))] if t and t.split() else []
    item_sh = {i: sh(t) for i, t in items}
    rarity = {}
    for s in {tuple(sorted(set(v))) for v in item_sh.values()}:
        for h in s:
            rarity[h] = rarity.get(h, 0) + 1
    weight = lambda h: max(1, int(1000 / rarity[h])) if h in rarity else 1000
    want = set()
    for i, t in docs:
        d = sh(t)
        for k, s in item_sh.items():
            b = set(s)
            for at in range(len(d)):
                a = set(d[at : at + len(s)])
                if a & b and sum(map(weight, a & b)) >= 0.8 * sum(map(weight, a | b)):
                    want.add((i, t, k))
                    break
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = {(x["id"], x["rh"]): x["text"] for x in frame.selectExpr("doc_id AS id", "xxhash64(text) AS rh", "text").collect()}
    for rows in (400_000, 10):  # broadcast, and by shuffles
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
        got = {(x["id"], texts[x["id"], x["rh"]], x["item"]) for x in decontaminate.matches(frame, bench).collect()}
        assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 120
        print(f"recall {len(got)} of {len(want)}")
