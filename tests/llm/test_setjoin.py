"""Meeting points of differences against all pairs."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import line_dedup
from tidewater.llm.setjoin import MAPS, differences, may_be_similar, meeting_points


def test_pairs_meet_once_and_none_is_lost(spark):
    rng = random.Random(5)
    token = lambda k: (k * 0x9E3779B97F4A7C15 ^ k * 0x51ED27) % (1 << 62)
    centre = [token(k) for k in range(1, 101)]
    sets = {0: set(centre)}
    pool = [token(1000 + k) for k in range(60)]
    families = [(rng.sample(centre[:50], 16), rng.sample(pool, 16)) for _ in range(6)]
    for i in range(1, 90):
        gone, more = families[i % 6]
        sets[i] = (set(centre) - set(gone[rng.randint(0, 4) :]) | set(more[rng.randint(0, 4) :])) - set(rng.sample(centre[50:], rng.randint(0, 4)))
    df = spark.createDataFrame([(i, len(x), list(x)) for i, x in sets.items()], "id long, n int, tok array<long>")
    near = df.select("id", F.lit(0).cast("long").alias("r"), F.lit(False).alias("inside"))
    told = differences(near, df, 80)
    post = meeting_points(told, [])
    x = post.select(F.col("h").alias("xh"), *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "d", "s", "p", "before", *MAPS)])
    met = [tuple(r) for r in x.join(post, (F.col("h") == F.col("xh")) & (F.col("id") < F.col("x_id")) & may_be_similar(80)).select("id", "x_id").collect()]
    close = {r.id for r in told.where("near").select("id").collect()}
    alike = {(a, b) for a, b in itertools.combinations(range(1, 90), 2) if len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]) and not {a, b} <= close}
    assert len(alike) > 50 and alike <= set(met)
    assert len(met) < 1.2 * len(set(met))


def test_distinct_words_keep_their_order():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 300, dtype=np.uint64)[rng.integers(0, 300, 5000)]
    h[::3] = (h[::3] & ~np.uint64((1 << 24) - 1)) | rng.integers(0, 3, len(h[::3]), dtype=np.uint64)  # equal but for the lowest bits
    rank = rng.permutation(1 << 17)
    for line in (np.sort(rng.integers(0, 400, 5000)), np.sort(rng.integers(0, 1 << 30, 40))):
        own = h[: len(line)]
        for key in (None, rank[line_dedup._bucket(own)]):
            got = list(zip(*(x.tolist() for x in line_dedup._distinct(own, line, key)), strict=True))
            rows = {(ln, 0 if key is None else int(key[k]), w) for k, (ln, w) in enumerate(zip(line.tolist(), own.tolist(), strict=True))}
            assert got == [(w, ln) for ln, _, w in sorted(rows)]
