"""Exploration: distributions, trends, associations, outliers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.statistics import corrected_kurtosis, corrected_skew
from tidewater.operators.ranking import bounds, free, joined, running, written


def categorical_profile(df: DataFrame, dims: list[str], most: int = 30) -> DataFrame:
    """Rows (dimension, n_distinct, mode, entropy, null_rate) of dimensions with at most ``most`` values; one pass over the data."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("x")).select("x.*")
    counts = long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    # Entropy from sums alone: log N - sum(n log n) / N, so no value meets all others of its dimension.
    total, terms = F.sum(known), F.sum(known * F.log2("n"))
    entropy = F.when(total > 0, F.greatest(F.log2(total) - terms / total, F.lit(0.0))).otherwise(0.0)
    g = counts.groupBy("dimension").agg(F.count("value").alias("n_distinct"), F.min(F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), "value"))).alias("m"), entropy.alias("entropy"), (F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("null_rate"))
    return g.where(F.col("n_distinct") <= most).select("dimension", "n_distinct", F.col("m.value").alias("mode"), "entropy", "null_rate")


def top_values(df: DataFrame, dims: list[str], top: int = 10) -> DataFrame:
    """Rows (dimension, value, n, pct): the most frequent values of each dimension, ties by value. Tasks keep their first ``top`` before the rank is
    made (Spark's limit below the window), and totals are sums apart from it, so an id column is no single task.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("x")).select("x.*").where("value is not null")
    counts = long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "value"))
    first = counts.withColumn("r", rank).where(F.col("r") <= top).drop("r")
    totals = df.agg(*[F.count(d).alias(f"t{k}") for k, d in enumerate(dims)]).select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"t{k}").alias("total")) for k, d in enumerate(dims)])).alias("x")).select("x.*")
    return first.join(F.broadcast(totals), "dimension").select("dimension", "value", "n", (F.col("n") / F.col("total")).alias("pct"))


def group_quantile(df: DataFrame, keys: list[str], column: str, q: float = 0.5, rows: int | None = None) -> DataFrame:
    """Rows (keys, n, q): the interpolated exact quantile of each group; groups without values are absent.

    Values are counted with partial sums, so the state is the distinct values in bounded hash tables, never a list by group; their running counts are made in
    buckets of values (``ranking.running``) where there are many. Without ``rows`` a group's distinct values go to one task.
    """
    v, k, upto = free(df, "v", "k", "upto")
    counts = df.select(*keys, F.col(column).cast("double").alias(v)).where(F.col(v).isNotNull()).groupBy(*keys, v).agg(F.count(F.lit(1)).alias(k))
    at = []
    if rows is not None:
        counts = written(counts)
        at = bounds(counts, v, counts.count(), rows)
    ranked = running(counts, v, k, upto, at, keys)
    total = counts.groupBy(*keys).agg(F.sum(k).alias("n"))
    ranked = joined(ranked, total, keys)
    rank = (F.col("n") - 1) * q
    value = lambda r: F.min(F.when(F.col(upto) - 1 >= r, F.col(v)))
    g = ranked.groupBy(*keys, "n").agg(value(F.floor(rank)).alias(v), value(F.ceil(rank)).alias(upto))
    return g.select(*keys, "n", (F.col(v) + (F.col(upto) - F.col(v)) * (rank - F.floor(rank))).alias("q"))


def exact_quantiles(df: DataFrame, columns: list[str], qs: list[float], slack: float = 5e-4) -> DataFrame:
    """Rows (column, n, q) of interpolated exact quantiles, q an array in the order of ``qs``; columns without values are absent.

    One pass counts and brackets each quantile by approximate ones; a second counts what lies below a bracket and the values within it, a
    thousandth of the rows, so no task holds a column.
    """
    x = {c: F.col(c).cast("double") for c in columns}
    out = "column string, n long, q array<double>"
    ends = [min(max(q + side * slack, 0.0), 1.0) for q in qs for side in (-1, 1)]
    got = df.agg(*[f.alias(f"{name}{k}") for k, c in enumerate(columns) for name, f in (("n", F.count(x[c])), ("lo", F.min(x[c])), ("hi", F.max(x[c])), ("e", F.percentile_approx(x[c], ends, 10_000)))]).first()  # a few numbers a column
    n = [got[f"n{k}"] for k in range(len(columns))]
    some = [(k, c) for k, c in enumerate(columns) if n[k]]
    if not some:
        return df.sparkSession.createDataFrame([], out)
    # Of few values a bracket of a share of them may miss its neighbours: all of them are looked at.
    near_all = {k for k, _ in some if n[k] * slack < 2}
    bracket = lambda k, i: (got[f"lo{k}"], got[f"hi{k}"]) if k in near_all else (got[f"e{k}"][2 * i], got[f"e{k}"][2 * i + 1])
    spots = [(c, i, *bracket(k, i), (n[k] - 1) * q) for k, c in some for i, q in enumerate(qs)]
    below = df.agg(*[F.count_if(x[c] < low).alias(f"b{j}") for j, (c, _, low, _, _) in enumerate(spots)]).first()
    each = F.array(*[F.when(x[c].between(low, high), F.struct(F.lit(j).alias("j"), x[c].alias("v"))) for j, (c, _, low, high, _) in enumerate(spots)])
    near = df.select(F.explode(F.filter(each, lambda s: s.isNotNull())).alias("s")).groupBy("s.j", "s.v").agg(F.count(F.lit(1)).alias("c"))
    where = df.sparkSession.createDataFrame([(j, c, i, n[columns.index(c)], below[j], r) for j, (c, i, _, _, r) in enumerate(spots)], "j int, column string, i int, n long, below long, rank double")
    ranked = near.join(F.broadcast(where), "j").withColumn("last", F.col("below") + F.sum("c").over(Window.partitionBy("j").orderBy("v")) - 1)
    value = lambda r: F.min(F.when(F.col("last") >= r, F.col("v")))
    low, high = value(F.floor("rank")), value(F.ceil("rank"))
    q = ranked.groupBy("column", "n", "i", "rank").agg(low.alias("a"), high.alias("z")).withColumn("v", F.col("a") + (F.col("z") - F.col("a")) * (F.col("rank") - F.floor("rank")))
    return q.groupBy("column", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("q"))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, n, mean, median, sd, min, max, iqr, skew, kurtosis); exact quantiles, corrected moments."""
    parts = ("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max), ("skew", corrected_skew), ("kurtosis", corrected_kurtosis)
    agg = df.agg(*[f(F.col(c).cast("double")).alias(f"{name}{k}") for k, c in enumerate(columns) for name, f in parts])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{name}{k}").alias(name) for name, _ in parts]) for k, c in enumerate(columns)])
    rest = agg.select(F.explode(cells).alias("x")).select("x.*")
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    return q.join(F.broadcast(rest), "column").select("column", "n", "mean", F.col("q")[1].alias("median"), "sd", "min", "max", (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "skew", "kurtosis")


def time_profile(df: DataFrame, date: str) -> DataFrame:
    """Rows (grain, period, n): monthly, quarterly and by-weekday counts in one pass."""
    d = F.col(date)
    grains = F.array(F.struct(F.lit("month").alias("grain"), F.date_format(d, "yyyy-MM").alias("period")), F.struct(F.lit("quarter").alias("grain"), F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")).alias("period")), F.struct(F.lit("weekday").alias("grain"), F.weekday(d).cast("string").alias("period")))
    return df.where(d.isNotNull()).select(F.explode(grains).alias("g")).groupBy("g.grain", "g.period").agg(F.count(F.lit(1)).alias("n"))


def trend_direction(series: DataFrame, order: str, value: str) -> DataFrame:
    """One row (n, first, second, direction): second half's mean against the first's, 10 % apart or stable."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    halves = series.select((F.row_number().over(Window.orderBy(order)) <= F.floor(n / 2)).alias("early"), F.col(value).cast("double").alias("y"))
    r = halves.agg(F.count("y").alias("n"), F.avg(F.when(F.col("early"), F.col("y"))).alias("first"), F.avg(F.when(~F.col("early"), F.col("y"))).alias("second"))
    change = F.try_divide(F.col("second") - F.col("first"), F.abs("first"))
    return r.withColumn("direction", F.when(F.col("n") < 4, "insufficient").when(change > 0.1, "rising").when(change < -0.1, "falling").otherwise("stable"))


def spikes(series: DataFrame, order: str, value: str, trailing: int = 3, least: float = 0.5) -> DataFrame:
    """Rows (order, value, baseline, change, kind) at least ``least`` away from the mean of the periods before."""
    w = Window.orderBy(order).rowsBetween(-trailing, -1)
    full = F.count(F.lit(1)).over(w) == trailing
    s = series.withColumn("baseline", F.when(full, F.avg(value).over(w))).withColumn("change", F.try_divide(F.col(value) - F.col("baseline"), F.col("baseline")))
    return s.where(F.abs("change") >= least).select(order, value, "baseline", "change", F.when(F.col("change") > 0, "spike").otherwise("dip").alias("kind"))


def iqr_outliers(df: DataFrame, column: str, least: int = 8) -> DataFrame:
    """One row (n, low, high, outliers, pct); no row where there are under ``least`` values or no spread."""
    x = F.col(column).cast("double")
    b = exact_quantiles(df, [column], [0.25, 0.75]).select("n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")).where((F.col("n") >= least) & (F.col("q3") > F.col("q1")))
    b = b.select("n", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"))
    return df.select(x.alias("x")).join(F.broadcast(b)).groupBy("n", "low", "high").agg(F.count_if(~F.col("x").between(F.col("low"), F.col("high"))).alias("outliers")).withColumn("pct", F.col("outliers") / F.col("n"))


def associations(df: DataFrame, dims: list[str], least: int = 20) -> DataFrame:
    """Rows (dim_a, dim_b, n, chi2, dof, cramers_v, strength, cell_a, cell_b, residual) of all pairs of dimensions, aggregated
    together: absent cells add only their expected count, so no grid is built. Margins are sums that are joined back, so no task holds a pair's cells.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("dim_a"), F.lit(b).alias("dim_b"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for a, b in combinations(dims, 2)])
    cells = df.select(F.explode(pairs).alias("p")).select("p.*").where("a is not null and b is not null").groupBy("dim_a", "dim_b", "a", "b").agg(F.count(F.lit(1)).alias("o"))
    pair = ["dim_a", "dim_b"]
    side = lambda c, name: cells.groupBy(*pair, c).agg(F.sum("o").alias(name))
    rows, cols = side("a", "r"), side("b", "c")
    size = rows.groupBy(*pair).agg(F.sum("r").alias("n"), F.count(F.lit(1)).alias("nr")).join(cols.groupBy(*pair).agg(F.count(F.lit(1)).alias("nc")), pair)
    m = cells.join(rows, [*pair, "a"]).join(cols, [*pair, "b"]).join(F.broadcast(size), pair).withColumn("e", F.col("r") * F.col("c") / F.col("n"))  # a row a pair of dimensions
    m = m.withColumn("residual", (F.col("o") - F.col("e")) / F.sqrt("e"))
    g = m.groupBy(*pair, "n", "nr", "nc").agg((F.sum(F.col("o") * F.col("o") / F.col("e")) - F.col("n")).alias("chi2"), F.min(F.struct((-F.abs("residual")).alias("s"), "a", "b", "residual")).alias("top"))
    g = g.where((F.col("n") >= least) & (F.col("nr") >= 2) & (F.col("nc") >= 2))
    v = F.sqrt(F.col("chi2") / (F.col("n") * F.least(F.col("nr") - 1, F.col("nc") - 1)))
    return g.select("dim_a", "dim_b", "n", "chi2", ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("dof"), v.alias("cramers_v"), F.when(v < 0.1, "weak").when(v < 0.3, "moderate").otherwise("strong").alias("strength"), F.col("top.a").alias("cell_a"), F.col("top.b").alias("cell_b"), F.col("top.residual").alias("residual"))


def calendar_profile(df: DataFrame, date: str) -> DataFrame:
    """One row (n, weekend_share, busiest_day, busiest_n) of a date column; days by name, ties to the earlier day of the week."""
    by = df.where(F.col(date).isNotNull()).groupBy(F.weekday(date).alias("w"), F.date_format(date, "EEEE").alias("day")).agg(F.count(F.lit(1)).alias("k"))
    top = F.min(F.struct((-F.col("k")).alias("k"), "w", "day"))
    g = by.agg(F.sum("k").alias("n"), F.sum(F.when(F.col("w") >= 5, F.col("k")).otherwise(0)).alias("weekend"), top.alias("t"))
    return g.where("n > 0").select("n", (F.col("weekend") / F.col("n")).alias("weekend_share"), F.col("t.day").alias("busiest_day"), (-F.col("t.k")).alias("busiest_n"))


def hypotheses(associated: DataFrame, direction: DataFrame, spiky: DataFrame, period: str, calendar: DataFrame, most: int = 12) -> DataFrame:
    """Rows (rank, kind, subject, measure): associations that are more than weak, a trend, spikes and dips, weekends of half the rows and more."""
    row = lambda k, kind, subject, measure: [F.lit(k).alias("k"), F.lit(kind).alias("kind"), subject.alias("subject"), measure.cast("double").alias("measure")]
    a = associated.where("strength <> 'weak'").select(*row(0, "association", F.concat_ws(" x ", "dim_a", "dim_b"), F.col("cramers_v")))
    t = direction.where("direction in ('rising', 'falling')").select(*row(1, "trend", F.col("direction"), F.try_divide(F.col("second") - F.col("first"), F.abs("first"))))
    s = spiky.select(*row(2, "spike", F.col(period).cast("string"), F.col("change")))
    w = calendar.where("weekend_share >= 0.5").select(*row(3, "weekend", F.lit("weekend"), F.col("weekend_share")))
    rank = F.row_number().over(Window.orderBy("k", F.desc(F.abs("measure")), "subject"))  # a few rows of result tables
    return a.unionByName(t).unionByName(s).unionByName(w).withColumn("rank", rank).where(F.col("rank") <= most).drop("k")
