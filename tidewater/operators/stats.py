"""Tests over groups: segments against the rest, false-discovery control, survival, trends, cohorts."""

from __future__ import annotations

import random
from math import inf

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.statistics import chi2_sf, two_proportions, two_sided, wilson
from tidewater.operators import ranking
from tidewater.operators.explore import exact_quantiles
from tidewater.operators.metrics import Blocked
from tidewater.operators.ranking import bounds, bucket, free, inversions, inverted_pairs, joined, running, written

MIN_SIDE = 30


def benjamini_hochberg(df: DataFrame, p: str, family: list[str] | None = None, alpha: float = 0.05, rows: int | None = None, few: bool = False) -> DataFrame:
    """Adds q and significant: the running minimum of p m / rank from the largest p down, within each family. Rows without a p count for nothing and have no q.

    Up to ``rows`` rows (or where the caller says they are ``few``) one window by family does. Beyond, equal p are one value with a count, and ranks are places within buckets of p plus what the buckets below hold; the minimum of a bucket's tail meets those of the
    buckets above it. ``df`` is read several times: hand in a table rather than a computation.
    """
    keys = family or []
    n, rank, m, raw, b, low, later = free(df, "n", "rank", "m", "raw", "bucket", "low", "later")
    if few or df.count() <= (rows or ranking.ROWS):
        own = Window.partitionBy(*keys, F.col(p).isNull())
        ranked = df.withColumn(rank, F.row_number().over(own.orderBy(p))).withColumn(raw, F.col(p) * F.count(F.lit(1)).over(own) / F.col(rank))
        q = F.least(F.min(raw).over(own.orderBy(F.desc(rank)).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
        return ranked.withColumn("q", F.when(F.col(p).isNotNull(), q)).withColumn("significant", F.coalesce(F.col("q") <= alpha, F.lit(False))).drop(rank, raw)
    known = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias(n))
    at = bounds(known, p, known.count(), rows)
    r = running(known, p, n, rank, at, keys)
    own = Window.partitionBy(*keys)
    if not at:
        r = r.withColumn(raw, F.col(p) * F.sum(n).over(own) / F.col(rank))
        q = F.min(raw).over(own.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    else:
        r = joined(r, known.groupBy(*keys).agg(F.sum(n).alias(m)), keys) if keys else r.join(F.broadcast(known.agg(F.sum(n).alias(m))))
        r = r.withColumn(raw, F.col(p) * F.col(m) / F.col(rank)).withColumn(b, bucket(F.col(p), at))
        above = own.orderBy(F.desc(b)).rowsBetween(Window.unboundedPreceding, -1)
        lows = r.groupBy(*keys, b).agg(F.min(raw).alias(low)).withColumn(later, F.min(low).over(above)).drop(low)
        r = joined(r, lows, [*keys, b])
        q = F.least(F.min(raw).over(Window.partitionBy(*keys, b).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)), F.col(later))
    out = joined(df, r.select(*keys, p, F.least(q, F.lit(1.0)).alias("q")), [*keys, p])
    return out.withColumn("significant", F.coalesce(F.col("q") <= alpha, F.lit(False)))


def segments_vs_rest(df: DataFrame, dim: str, flag: str, alpha: float = 0.05, min_side: int = MIN_SIDE) -> DataFrame:
    """Each segment's rate with its interval, and a test against all other rows where both sides have ``min_side`` rows."""
    y = F.coalesce(F.col(flag).cast("long"), F.lit(0))
    g = written(df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).cast("string").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("x")))
    g = g.join(F.broadcast(g.agg(F.sum("n").alias("all_n"), F.sum("x").alias("all_x"))))  # one row
    low, high = wilson(F.col("x"), F.col("n"))
    t = two_proportions(F.col("x"), F.col("n"), F.col("all_x") - F.col("x"), F.col("all_n") - F.col("n"))
    tested = (F.col("n") >= min_side) & (F.col("all_n") - F.col("n") >= min_side)
    g = g.select("segment", "n", "x", (F.col("x") / F.col("n")).alias("rate"), low.alias("ci_low"), high.alias("ci_high"), (F.col("all_x") / F.col("all_n")).alias("overall"), F.when(tested, t["diff"]).alias("diff"), F.when(tested, t["z"]).alias("z"), tested.alias("tested"))
    with_p = g.withColumn("p", F.when(F.col("tested"), two_sided(F.col("z"))))
    return benjamini_hochberg(with_p, "p", None, alpha)


def chi2_independence(counts: DataFrame, a: str, b: str, n: str) -> DataFrame:
    """One row (chi2, dof, n, low_expected, valid, cramers_v, p) from counts of (a, b); absent cells count as 0."""
    rows = counts.groupBy(a).agg(F.sum(n).alias("r"))
    cols = counts.groupBy(b).agg(F.sum(n).alias("c"))
    total = counts.agg(F.sum(n).alias("n"))
    seen = counts.join(rows, a).join(cols, b).join(F.broadcast(total.withColumnRenamed("n", "all")))
    # Cells that nobody has add their expected count: chi2 = sum(observed^2 / expected) - n.
    stat = seen.agg((F.sum(F.col(n) * F.col(n) * F.col("all") / (F.col("r") * F.col("c"))) - F.max("all")).alias("chi2"), F.max("all").alias("n"))
    # Low expected counts over the full grid: margins are counted by value, not crossed row by row.
    rv, cv = rows.groupBy("r").count(), cols.groupBy("c").count()
    low = rv.select("r", F.col("count").alias("k")).join(cv.select("c", F.col("count").alias("m"))).join(F.broadcast(total.withColumnRenamed("n", "all")))
    low = low.agg(F.coalesce(F.sum(F.when(F.col("r") * F.col("c") < 5 * F.col("all"), F.col("k") * F.col("m"))), F.lit(0)).alias("low_expected"))
    size = rows.agg(F.count(F.lit(1)).alias("nr")).join(cols.agg(F.count(F.lit(1)).alias("nc")))
    out = stat.join(low).join(size)
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * F.least(F.col("nr") - 1, F.col("nc") - 1)))
    valid = (F.col("low_expected") == 0) & (dof > 0)
    return out.select("chi2", dof.alias("dof"), "n", "low_expected", valid.alias("valid"), v.alias("cramers_v"), F.when(valid, chi2_sf(F.col("chi2"), dof)).alias("p"))


def kaplan_meier(df: DataFrame, time: str, event: Column, group: str | None = None) -> DataFrame:
    """Rows (group, time, at_risk, deaths, survival) at event times. Blocked without durations or events."""
    keys = [group] if group else []
    per = df.where(F.col(time).isNotNull()).groupBy(*keys, F.col(time).alias("time")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(event.cast("long"), F.lit(0))).alias("deaths"))
    sofar = Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy(*keys))
    risk = per.withColumn("at_risk", total - F.sum("n").over(sofar) + F.col("n")).where("deaths > 0")
    # S is the running product; ln 0 would be lost, so the last step to 0 is set apart.
    drop = F.when(F.col("deaths") < F.col("at_risk"), F.log(1 - F.col("deaths") / F.col("at_risk")))
    s = F.when(F.col("deaths") == F.col("at_risk"), 0.0).otherwise(F.exp(F.sum(F.coalesce(drop, F.lit(0.0))).over(sofar)))
    return risk.withColumn("survival", s).select(*keys, "time", "at_risk", "deaths", "survival")


def median_survival(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First time at which survival (to four places) is at most one half; null if never."""
    return curve.groupBy(*(keys or [])).agg(F.min(F.when(F.round("survival", 4) <= 0.5, F.col("time"))).alias("median_time"))


def survival_at(curve: DataFrame, t: float) -> DataFrame:
    """Survival at the last step up to t (1 before the first)."""
    return curve.agg(F.coalesce(F.max_by(F.when(F.col("time") <= t, F.col("survival")), F.when(F.col("time") <= t, F.col("time"))), F.lit(1.0)).alias("survival"))


def _tied(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("k"))


def mann_kendall(df: DataFrame, order: str, value: str, rows: int | None = None) -> DataFrame:
    """One row (n, s, var_s, z, p, trend) of a series; fewer than four points give trend 'insufficient'. Rows without an order or a value are no points;
    points of equal order are not compared.

    S is what is left of all pairs that differ in order and value after the inverted ones are taken off twice (``ranking.inversions``).
    """
    points = written(df.select(F.col(order).alias("x"), F.col(value).cast("double").alias("y")).where("x is not null and y is not null and not isnan(y)"))
    pairs = F.coalesce(F.sum((F.col("k") * (F.col("k") - 1) / 2).cast("decimal(38,0)")), F.lit(0))
    ties = F.coalesce(F.sum((F.col("k") * (F.col("k") - 1) * (2 * F.col("k") + 5)).cast("decimal(38,0)")), F.lit(0))
    n = points.count()
    same_y, weight = _tied(points, ["y"]).agg(pairs, ties).first()
    same_x, same_both = (int(_tied(points, by).agg(pairs).first()[0]) for by in (["x"], ["x", "y"]))
    inverted = inversions(points, "x", "y", n, rows) if n else 0
    s = n * (n - 1) // 2 - same_x - int(same_y) + same_both - 2 * inverted
    row = df.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(float(s)).alias("s"), F.lit((n * (n - 1) * (2 * n + 5) - int(weight)) / 18).alias("var_s"))
    z = F.try_divide(F.col("s") - F.signum("s"), F.sqrt("var_s"))
    row = row.withColumn("z", F.coalesce(z, F.lit(0.0))).withColumn("p", two_sided(F.col("z")))
    verdict = F.when(F.col("n") < 4, "insufficient").when((F.col("p") <= 0.05) & (F.col("s") > 0), "rising").when((F.col("p") <= 0.05) & (F.col("s") < 0), "falling").otherwise("flat")
    return row.withColumn("trend", verdict)


def _middle_slope(points: DataFrame, n: int, rows: int | None, most: int) -> float | None:
    """The median over pairs (i, y) of n points of (y2 - y1) / (i2 - i1).

    A slope is under t where y - t i is inverted, so slopes are counted, not made. Bounds from random pairs, then from interpolating the counts between them, close in
    on the middle until at most ``most`` slopes lie between; these are listed and ranked exactly.
    """
    total = n * (n - 1) // 2
    if not total:
        return None
    wanted = (total - 1) // 2, total // 2  # the middle ones, from 0
    tilted = lambda t: F.col("i").cast("double") if t == -inf else -F.col("i").cast("double") if t == inf else F.col("y") - F.lit(t) * F.col("i")
    below = lambda t: inversions(points.select(F.col("i"), tilted(t).alias("z")), "i", "z", n, rows)
    low, high, c_low, c_high = -inf, inf, 0, total
    rng, turns = random.Random(7), 0
    far_y, far_i = points.agg(F.max(F.abs("y")), F.max("i")).first()
    while c_high - c_low > most:
        if low == -inf or high == inf:
            some = [tuple(r) for r in points.sample(min(1.0, 4000 / n), seed=turns + 1).select("i", "y").collect()]
            drawn = [rng.sample(some, 2) for _ in range(40_000)] if len(some) > 1 else []
            slopes = sorted((b[1] - a[1]) / (b[0] - a[0]) for a, b in drawn)
            middle, wide = len(slopes) // 2, len(slopes) // 25 * (turns + 1)
            tries = [slopes[max(0, middle - wide)], slopes[min(len(slopes) - 1, middle + wide)]]
        elif turns % 3 == 2:
            tries = [low + (high - low) * f for f in (0.4, 0.6)]
        else:
            share = [(w - c_low) / (c_high - c_low) for w in wanted]
            tries = [low + (high - low) * min(max(f, 0.0), 1.0) for f in (share[0] - 0.03, share[1] + 0.03)]
        steep = max(abs(tries[0]), abs(tries[1]))
        slack = max(1e-9 * steep, 2e-15 * (far_y + steep * far_i))  # what a tilt must change at least to be seen in a double
        if tries[1] - tries[0] <= slack:  # the sample's middle is one slope, or the bounds have met: are all that are left that slope?
            a, b = tries[0] - slack, tries[1] + slack
            if below(a) <= wanted[0] and below(b) > wanted[1]:
                return (tries[0] + tries[1]) / 2
            tries = [a, b]
        for t in tries:
            t += slack * rng.random()  # no slope lies on a bound but by chance
            if low < t < high:
                c = below(t)
                if c <= wanted[0]:
                    low, c_low = t, c
                elif c > wanted[1]:
                    high, c_high = t, c
        turns += 1
        if turns > 60:
            raise Blocked("slopes too close to each other to be told apart")
    both = points.select("i", "y", tilted(low).alias("a"), tilted(high).alias("b"))
    slope = (F.col("v2") - F.col("v1")) / (F.col("k2") - F.col("k1"))
    near = inverted_pairs(both, "a", "b", "i", "y", n, rows).select(slope.alias("slope"))
    ranked = near.groupBy("slope").agg(F.count(F.lit(1)).alias("k")).withColumn("last", F.sum("k").over(Window.orderBy("slope")) - 1 + c_low)  # at most ``most`` rows
    found = ranked.agg(F.sum("k").alias("k"), *[F.min(F.when(F.col("last") >= w, F.col("slope"))).alias(f"m{j}") for j, w in enumerate(wanted)]).first()
    if found["k"] != c_high - c_low:
        raise Blocked("slopes too close to a bound to be told apart")
    return (found["m0"] + found["m1"]) / 2


def theil_sen(df: DataFrame, order: str, value: str, rows: int | None = None, most: int = 1_000_000) -> DataFrame:
    """One row (slope, intercept): medians over pairs of points and over points. Missing values keep their place in the order; rows without an order have none. No row
    for fewer than two points. Equal orders are placed by value.
    """
    every = written(df.select(F.col(order).alias("x"), F.col(value).cast("double").alias("y")).where("x is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("k")))
    size = every.agg(F.sum("k")).first()[0] or 0
    at = bounds(every, "x", size, rows)
    points = written(_ends(every, at).where("y is not null and not isnan(y)").select(F.explode(F.sequence(F.col("end") - F.col("k"), F.col("end") - 1)).alias("i"), "y"))
    slope = _middle_slope(points, points.count(), rows, most)
    if slope is None:
        return df.sparkSession.createDataFrame([], "slope double, intercept double")
    rest = exact_quantiles(points.select((F.col("y") - F.lit(slope) * F.col("i")).alias("r")), ["r"], [0.5])
    return rest.select(F.lit(slope).alias("slope"), F.col("q")[0].alias("intercept"))


def _ends(every: DataFrame, at: list) -> DataFrame:
    """Adds end: rows up to and with each (x, y), x in buckets."""
    t = every.withColumn("b", bucket(F.col("x"), at))
    per = t.groupBy("b").agg(F.sum("k").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a bucket
    return t.join(F.broadcast(per.drop("s")), "b").withColumn("end", F.sum("k").over(Window.partitionBy("b").orderBy("x", "y")) + F.col("before"))


def cohort_rates(df: DataFrame, cohort: str, flag: str) -> DataFrame:
    """Rows (cohort, n, x, rate, ci_low, ci_high, underpowered)."""
    y = F.coalesce(F.col(flag).cast("long"), F.lit(0))
    g = df.where(F.col(cohort).isNotNull()).groupBy(F.col(cohort).cast("string").alias("cohort")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("x"))
    low, high = wilson(F.col("x"), F.col("n"))
    return g.select("cohort", "n", "x", (F.col("x") / F.col("n")).alias("rate"), low.alias("ci_low"), high.alias("ci_high"), (F.col("n") < MIN_SIDE).alias("underpowered"))


def monthly_series(df: DataFrame, date: str, value: str | None = None) -> DataFrame:
    """Rows (month, value): row counts, or the mean of a column. Months without rows are absent."""
    g = df.where(F.col(date).isNotNull()).groupBy(F.date_format(date, "yyyy-MM").alias("month"))
    return g.agg((F.avg(value) if value else F.count(F.lit(1)).cast("double")).alias("value"))


def survival_input(df: DataFrame, duration: str, event: str | None = None, status: str = "completion_status") -> DataFrame:
    """Adds event: the given flag (null: no), else whether the status is not_coming or churned. Blocked without either, or where durations are no numbers."""
    if dict(df.dtypes).get(duration) in (None, "string", "boolean", "date", "timestamp"):
        raise Blocked(f"{duration} is not a number of days")
    if event and event in df.columns:
        return df.withColumn("event", F.coalesce(F.col(event).cast("boolean"), F.lit(False)))
    if status not in df.columns:
        raise Blocked(f"neither an event flag nor {status}")
    return df.withColumn("event", F.coalesce(F.col(status).isin("not_coming", "churned"), F.lit(False)))


def cohort_trend(df: DataFrame, cohort: str, flag: str) -> DataFrame:
    """Mann-Kendall over the cohorts' rates, cohorts in the order of their names."""
    return mann_kendall(cohort_rates(df, cohort, flag), "cohort", "rate")
