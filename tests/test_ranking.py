"""Order statistics in buckets against plain versions: positions, false-discovery control, inversions, trends and median slopes."""

import itertools
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import ranking, stats


@pytest.fixture(autouse=True)
def few_bounds_a_group(monkeypatch):
    monkeypatch.setattr(ranking, "_FINE", 3)


def test_buckets_are_ordered_and_bounds_have_their_own(spark):
    at = [2.0, 4.0, 4.5, 7.0, 8.0, 9.0, 12.0]
    got = spark.createDataFrame([(x / 4,) for x in range(60)], "x double").select("x", ranking.bucket(F.col("x"), at).alias("b")).collect()
    for r in got:
        assert r.b == 2 * sum(b < r.x for b in at) + (r.x in at)


def plain_bh(ps):
    known = sorted(p for p in ps if p is not None)
    m = len(known)
    return [None if p is None else min(1.0, *(q * m / (k + 1) for k, q in enumerate(known) if q >= p)) for p in ps]


@pytest.mark.parametrize("rows", [None, 25])
def test_false_discovery_control_in_buckets(spark, rows):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, round(rng.random() ** 3, 2)]), k) for k in range(400)]
    df = spark.createDataFrame(data, "f string, p double, rank long")
    for family in (None, ["f"]):
        got = {r["rank"]: r for r in stats.benjamini_hochberg(df, "p", family, rows=rows).collect()}
        assert len(got) == len(data)
        for f in {"a", "b", None} if family else {0}:
            part = [(p, k) for g, p, k in data if not family or g == f]
            for (_, k), q in zip(part, plain_bh([p for p, _ in part]), strict=True):
                assert got[k].q == pytest.approx(q) if q is not None else got[k].q is None
                assert got[k].significant == (q is not None and q <= 0.05)


def test_control_over_very_many_segments(spark):
    df = spark.range(1_000_000).select(F.col("id"), ((F.pmod(F.xxhash64("id"), F.lit(999_983)) / 999_983.0) ** 2).alias("p"))
    plain = stats.benjamini_hochberg(df, "p", rows=10**9).select("id", F.col("q").alias("a"))
    dealt = stats.benjamini_hochberg(df, "p", rows=40_000).select("id", F.col("q").alias("b"))
    assert plain.join(dealt, "id").where("a is null or b is null or abs(a - b) > 1e-12").count() == 0


def series(rng, n, kind):
    y = {"smooth": lambda i: i * 0.3 + rng.gauss(0, 9), "ties": lambda i: rng.randrange(6), "flat": lambda i: 5.0, "line": lambda i: 2.0 * i, "heavy": lambda i: 1.0 if rng.random() < 0.6 else rng.random()}[kind]
    return [(i, None if rng.random() < 0.05 and kind != "line" else float(y(i))) for i in range(n)]


@pytest.mark.parametrize(("kind", "rows"), list(itertools.product(["smooth", "ties", "flat", "heavy"], [None, 30])))
def test_s_equals_all_pairs(spark, kind, rows):
    rng = random.Random(len(kind))
    data = series(rng, 300, kind) + [(i, 3.0) for i in range(40, 60)] + [(None, 1.0)]
    got = stats.mann_kendall(spark.createDataFrame(data, "t int, y double"), "t", "y", rows=rows).first()
    known = [(i, y) for i, y in data if y is not None and i is not None]
    s = sum(np.sign(b[1] - a[1]) * np.sign(b[0] - a[0]) for a, b in itertools.combinations(known, 2))
    assert (got.n, got.s) == (len(known), s)


def test_s_of_five_thousand_points(spark):
    rng = np.random.default_rng(3)
    y = np.round(rng.normal(size=5000).cumsum(), 1)
    s = sum(int(np.sign(y[k + 1 :] - y[k]).sum()) for k in range(len(y)))
    df = spark.createDataFrame([(f"{k:05d}", float(v)) for k, v in enumerate(y)], "t string, y double")
    assert stats.mann_kendall(df, "t", "y", rows=600).first().s == s == stats.mann_kendall(df, "t", "y").first().s


@pytest.mark.parametrize(("kind", "rows", "most"), [("smooth", None, 10**6), ("smooth", 40, 500), ("ties", 40, 3000), ("flat", 60, 100), ("line", 60, 100), ("heavy", None, 2000)])
def test_median_slope_equals_all_pairs(spark, kind, rows, most):
    data = series(random.Random(1), 250, kind)
    got = stats.theil_sen(spark.createDataFrame(data, "t int, y double"), "t", "y", rows=rows, most=most).first()
    known = [(i, y) for i, y in data if y is not None]
    slope = statistics.median((b[1] - a[1]) / (b[0] - a[0]) for a, b in itertools.combinations(known, 2))
    assert got.slope == pytest.approx(slope, rel=1e-8, abs=1e-9)
    assert got.intercept == pytest.approx(statistics.median(y - slope * i for i, y in known), rel=1e-6, abs=1e-6)


def test_few_points(spark):
    empty = spark.createDataFrame([(1, None)], "t int, y double")
    assert stats.mann_kendall(empty, "t", "y").first().trend == "insufficient"
    assert stats.theil_sen(empty, "t", "y").count() == 0


def test_a_task_holds_few_rows(spark, monkeypatch):
    dealt, seen = ranking._dealt, []
    monkeypatch.setattr(ranking, "_dealt", lambda *a: seen.append(dealt(*a)) or seen[-1])
    n = 400_000
    df = spark.range(n).select(F.col("id").alias("x"), F.pmod(F.xxhash64("id"), F.lit(99_991)).cast("double").alias("y"))
    values = df.orderBy("x").toPandas()["y"].to_numpy()
    assert ranking.inversions(df, "x", "y", n) == ranking.count_inverted(values)
    for by in ("a", "v"):
        assert max(r["count"] for r in seen[0][0].where(f"{by} % 2 = 0").groupBy(by).count().collect()) < 250_000
