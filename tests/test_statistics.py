import math

import pytest
from pyspark.sql import functions as F

from tidewater.functions import statistics as S
from tidewater.operators import cross, stats
from tidewater.operators.metrics import Blocked, Metric, compare_periods, headline, resolve


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_tails(spark):
    r = one(spark, z=S.normal_sf(F.lit(S.Z95)), a=S.chi2_sf(F.lit(3.841459), F.lit(1)), b=S.chi2_sf(F.lit(5.991465), F.lit(2)), c=S.chi2_sf(F.lit(16.918978), F.lit(9)))
    assert r["z"] == pytest.approx(0.025, abs=1e-9)
    assert [r["a"], r["b"], r["c"]] == pytest.approx([0.05] * 3, abs=1e-6)


def test_wilson_and_proportions(spark):
    low, high = S.wilson(F.lit(0), F.lit(20))
    t = S.two_proportions(F.lit(30), F.lit(100), F.lit(20), F.lit(100))
    r = one(spark, low=low, high=high, top=S.wilson(F.lit(95), F.lit(100))[1], d=t["diff"], z=t["z"], p=S.two_sided(t["z"]))
    assert r["low"] == 0 and 0.10 < r["high"] < 0.20 and r["top"] < 1
    assert (round(r["d"], 4), round(r["z"], 4), round(r["p"], 4)) == (0.1, 1.633, 0.1025)


def test_false_discovery(spark):
    df = spark.createDataFrame([(p,) for p in (0.01, 0.02, 0.03, 0.04)], "p double")
    rows = stats.benjamini_hochberg(df, "p").collect()
    assert all(abs(r["q"] - 0.04) < 1e-12 and r["significant"] for r in rows)


def test_segments(spark):
    groups = spark.range(1500).select((F.col("id") % 15).cast("string").alias("g"), (F.floor(F.col("id") / 15) % 5 == 0).alias("y"))
    assert stats.segments_vs_rest(groups, "g", "y").where("significant").count() == 0
    hot = groups.withColumn("y", F.when(F.col("g") == "3", F.rand(1) < 0.6).otherwise(F.col("y")))
    assert [r["segment"] for r in stats.segments_vs_rest(hot, "g", "y").where("significant").collect()] == ["3"]
    thin = spark.createDataFrame([("big", True)] * 200 + [("tiny", False)] * 6, "g string, y boolean")
    assert stats.segments_vs_rest(thin, "g", "y").where("tested").count() == 0


def test_survival(spark):
    df = spark.createDataFrame(list(zip([2, 3, 5, 6, 7, 8], [1, 0, 1, 0, 0, 0], strict=True)), "t int, e int")
    curve = stats.kaplan_meier(df, "t", F.col("e") == 1)
    assert {r["time"]: round(r["survival"], 4) for r in curve.collect()} == {2: 0.8333, 5: 0.625}
    assert stats.median_survival(curve).first()[0] is None
    assert round(stats.survival_at(curve, 4).first()[0], 4) == 0.8333


def test_trends(spark):
    up = spark.createDataFrame([(i, float(i)) for i in range(1, 11)], "i int, y double")
    assert stats.mann_kendall(up, "i", "y").first()["s"] == 45
    down = up.withColumn("y", -F.col("y"))
    r = stats.mann_kendall(down, "i", "y").first()
    assert (r["s"], r["trend"]) == (-45, "falling")
    line = stats.theil_sen(spark.createDataFrame([(i, 3.0 * i) for i in range(5)], "i int, y double"), "i", "y").first()
    assert (line["slope"], line["intercept"]) == (3.0, 0.0)


def grid(spark, hot):
    def rate(a, b):
        base = 0.05
        return (0.30 if (a, b) == ("x", "p") else base) if hot else base + (0.10 if a == "x" else 0)

    rows = [(a, b, k < round(200 * rate(a, b))) for a in "xy" for b in "pq" for k in range(200)]
    return spark.createDataFrame(rows, "a string, b string, y boolean")


def test_crossing(spark):
    m = Metric("rate", "y")
    found = cross.crosstab(grid(spark, True), m, "a", "b").where("interaction").collect()
    assert [(r["row"], r["col"]) for r in found] == [("x", "p")]
    assert cross.crosstab(grid(spark, False), m, "a", "b").where("interaction").count() == 0
    thin = grid(spark, True).unionByName(spark.createDataFrame([("z", "p", True)] * 12, "a string, b string, y boolean"))
    cells = cross.crosstab(thin, m, "a", "b").where("level = 'cell'")
    assert [r["n"] for r in cells.where("suppressed").collect()] == [12]
    with pytest.raises(Blocked):
        cross.crosstab(thin, m, "a", "a")


def test_filters():
    assert cross.parse_filter("fee >= 100") == ("fee", ">=", ["100"])
    assert cross.parse_filter("branch not in a, B") == ("branch", "not in", ["a", "B"])
    with pytest.raises(ValueError):
        cross.parse_filter("nonsense")


def test_metrics(spark):
    df = spark.createDataFrame([(None,), (True,), (False,), (True,)], "f boolean")
    assert headline(df, Metric("rate", "f")).first()["value"] == 0.5
    assert headline(df, Metric("rate", "f", null_is_false=False)).first()["value"] == pytest.approx(2 / 3)
    assert headline(df.limit(0), Metric("count")).first()["value"] == 0
    with pytest.raises(Blocked):
        resolve("default_rate", ["x"])
    dated = spark.createDataFrame([(f"2024-0{m}-15", float(m)) for m in (1, 2, 3, 3)], "d string, y double").withColumn("d", F.to_timestamp("d"))
    r = compare_periods(dated, Metric("sum", "y"), "d", 1).first()
    assert (r["current"], r["prior"], r["delta_abs"]) == (6.0, 2.0, 4.0)


def test_independence(spark):
    c = spark.createDataFrame([("a", "x", 40), ("a", "y", 10), ("b", "x", 20), ("b", "y", 30)], "a string, b string, n long")
    r = stats.chi2_independence(c, "a", "b", "n").first()
    assert r["chi2"] == pytest.approx(100 * (40 * 30 - 10 * 20) ** 2 / (50 * 50 * 60 * 40))
    assert r["valid"] and r["p"] == pytest.approx(math.erfc(math.sqrt(r["chi2"] / 2)), rel=1e-9)
