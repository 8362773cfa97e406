"""The mixture against a plain version: weights from a fine search, prefixes of sorted units; repeated rows and clashing names."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tidewater.llm import mixing

BUDGET, REPEATS, BLOCK = 9000, 3.0, 60


def corpus(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "a", "a", "a", "b", "b", None])) for k in range(600)]
    rows += [(5, rows[5][1], rows[5][2])] * 7 + [(6, "another text of an id", "a"), (None, None, "b"), (None, None, "b")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def plain_weights(tokens: dict) -> dict:
    """The largest of 20,001 exponents that meets the entropy, raised to the least that keeps the repetition limit."""
    total = sum(tokens.values())

    def at(a):
        raw = {s: (t / total) ** a for s, t in tokens.items()}
        return {s: r / sum(raw.values()) for s, r in raw.items()}

    grid = [k / 20_000 for k in range(20_001)]
    fit = [a for a in grid if -sum(w * math.log(w) for w in at(a).values()) >= 0.9 * math.log(len(tokens))]
    best = max(fit)
    kept = [a for a in grid if a >= best and max(w * BUDGET / tokens[s] for s, w in at(a).items()) <= REPEATS]
    return at(min(kept) if kept else 1.0)


def test_copies_are_prefixes_of_each_epochs_permutation(spark):
    rows, df = corpus(spark)
    options = {"budget": BUDGET, "entropy": 0.9, "max_repeats": REPEATS, "block_tokens": BLOCK}
    out = mixing.mix(df, **options).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((i, s or "") for i, _, s in rows)
    tokens = Counter()
    for i, t, s in rows:
        tokens[s or ""] += max(1, len((t or "").split()))
    weights = plain_weights(tokens)
    units = defaultdict(list)
    for u in mixing._units(df, "doc_id", "text", "source", BUDGET, 0.9, REPEATS, BLOCK, 20).collect():
        units[u.src].append(u)
    for s, t in tokens.items():
        assert units[s][0].weight == pytest.approx(weights[s], abs=2e-4)
        share = int(units[s][0].weight * BUDGET)
        run = 0
        for u in sorted(units[s], key=lambda u: (u.turn % 2**64, u.block, u.own, u.id if u.id is not None else -1, u.tok)):
            run += u.tok * u.k
            assert u.copies == share // t + (run <= share % t)
            assert len(u.turns) == u.copies == len(set(u.turns))
        spent = sum(r.n_tokens * r.copies for r in out if r.source == s)
        assert share - max(u.tok * u.k for u in units[s]) < spent <= share
    for s, mine in units.items():  # a block has one place in each epoch, another in the next
        places = {(u.block, e): turn for u in mine for e, turn in enumerate(u.turns)}
        assert all(places[u.block, e] == turn for u in mine for e, turn in enumerate(u.turns))
        for e in range(max(len(u.turns) for u in mine) - 1):
            blocks = [b for b, at in places if at == e + 1]
            if len(blocks) > 10:
                assert sorted(blocks, key=lambda b: places[b, e]) != sorted(blocks, key=lambda b: places[b, e + 1])


def test_rows_of_one_id_have_places_of_their_own_text(spark):
    rows, df = corpus(spark)
    df = df.selectExpr("*", "1 AS mix_turn", "2 AS MIX_COPIES", "3 AS id", "4 AS own", "5 AS src", "6 AS m_own")
    options = {"budget": BUDGET, "entropy": 0.9, "max_repeats": REPEATS, "block_tokens": BLOCK}
    out = mixing.mixture_of(df, **options).collect()
    want = Counter((r.doc_id, r.source, r.n_tokens, r.copies) for r in mixing.mix(df, **options).collect())
    assert Counter((r.doc_id, r.source or "", r.mix_n_tokens, r.mix_copies_) for r in out) == want
    assert all((r.mix_turn, r.MIX_COPIES, r.own) == (1, 2, 4) and r.mix_n_tokens == max(1, len((r.text or "").split())) for r in out)
