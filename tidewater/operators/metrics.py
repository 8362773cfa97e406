"""Metrics with intervals, breakdowns, period comparisons and drivers, from sums that one aggregation yields.

A metric is a kind and two columns. Its sufficient statistics are n, sums and sums of squares, so each result
takes one shuffle of a few rows per group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.statistics import Z95, wilson

#: Below this many rows a segment's value is marked as of low confidence.
THIN = 30


class Blocked(Exception):
    """An operator lacks its inputs; the reason says which."""


@dataclass(frozen=True)
class Metric:
    """``kind``: rate, count, sum, mean or ratio (num over den). For rates ``null_is_false`` counts nulls as misses."""

    kind: str
    num: str | None = None
    den: str | None = None
    null_is_false: bool = True
    lower_is_better: bool = False


#: The catalogue: name -> (kind, numerator, denominator, nulls count as false, lower is better).
CATALOGUE: dict[str, Metric] = {
    **{m: Metric("rate", c) for m, c in {"admission_conversion_rate": "is_admitted", "counselling_to_admission_rate": "is_admitted", "completion_rate": "is_completed", "repeat_enrollment_rate": "is_repeat_enrollment"}.items()},
    **{m: Metric("rate", c, lower_is_better=True) for m, c in {"default_rate": "is_default", "dropout_rate": "is_dropped", "not_coming_rate": "is_not_coming", "certificate_pending_rate": "is_certificate_pending", "duplicate_certificate_rate": "is_duplicate_certificate", "enquiry_backlog_rate": "is_enquiry_backlog"}.items()},
    "churn_rate": Metric("rate", "is_churn", null_is_false=False, lower_is_better=True),
    **{m: Metric("count") for m in ("admissions_confirmed", "total_leads", "qualified_leads", "walk_in_count")},
    "gross_fee_collected": Metric("sum", "paid"),
    "pending_fee": Metric("sum", "pending", lower_is_better=True),
    "overdue_fee": Metric("sum", "pending", lower_is_better=True),
    "average_fee_per_student": Metric("mean", "amount"),
    "certificate_issue_lag_days": Metric("mean", "certificate_delay_days", lower_is_better=True),
    "lead_to_admission_days": Metric("mean", "lead_to_admission_days", lower_is_better=True),
    "collection_efficiency": Metric("ratio", "paid", "amount"),
}


def resolve(name: str, columns: list[str], metric: Metric | None = None) -> Metric:
    """The metric if its columns are there, else Blocked with the reason. An unknown name counts rows."""
    m = metric or CATALOGUE.get(name, Metric("count"))
    if name == "collection_efficiency" and m.num not in columns and "amount_collected" in columns:
        m = Metric("ratio", "amount_collected", m.den)
    missing = [c for c in (m.num, m.den) if c and c not in columns]
    if missing:
        raise Blocked(f"{name} needs {', '.join(missing)}")
    return m


def sums(m: Metric) -> list[Column]:
    """Aggregates n, sy, sy2, sx, sx2, sxy."""
    y = F.lit(1.0) if m.kind == "count" else F.col(m.num).cast("double")
    if m.kind == "rate" and m.null_is_false:
        y = F.coalesce(y, F.lit(0.0))
    x = F.col(m.den).cast("double") if m.kind == "ratio" else F.lit(1.0)
    ok = y.isNotNull() & x.isNotNull() if m.kind == "ratio" else y.isNotNull()
    y, x = F.when(ok, y), F.when(ok, x)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [F.count(y).alias("n"), zero(F.sum(y)).alias("sy"), zero(F.sum(y * y)).alias("sy2"), zero(F.sum(x)).alias("sx"), zero(F.sum(x * x)).alias("sx2"), zero(F.sum(x * y)).alias("sxy")]


def value(m: Metric) -> Column:
    n, sy, sx = F.col("n"), F.col("sy"), F.col("sx")
    if m.kind in ("rate", "mean"):
        return F.coalesce(F.try_divide(sy, n), F.lit(0.0))
    return F.coalesce(F.try_divide(sy, sx), F.lit(0.0)) if m.kind == "ratio" else sy


def deviation(m: Metric) -> Column:
    """Standard error of the value."""
    n, sy, sy2, sx, sx2, sxy = (F.col(c) for c in ("n", "sy", "sy2", "sx", "sx2", "sxy"))
    var = F.greatest(F.try_divide(sy2 - sy * sy / n, n - 1), F.lit(0.0))
    if m.kind == "count":
        return F.sqrt(n.cast("double"))
    if m.kind == "sum":
        return F.sqrt(var * n)
    if m.kind == "mean":
        return F.sqrt(F.try_divide(var, n))
    if m.kind == "rate":
        p = F.try_divide(sy, n)
        return F.sqrt(F.try_divide(p * (1 - p), n))
    r = F.try_divide(sy, sx)
    rest = F.greatest(sy2 - 2 * r * sxy + r * r * sx2, F.lit(0.0))
    return F.try_divide(F.sqrt(F.try_divide(n.cast("double"), n - 1) * rest), F.abs(sx))


def interval(m: Metric) -> tuple[Column, Column]:
    """95 % interval: Wilson for rates, normal for the rest; ratios and counts do not go below 0."""
    if m.kind == "rate":
        return wilson(F.col("sy"), F.col("n"))
    half = Z95 * deviation(m)
    low = value(m) - half
    return (F.greatest(low, F.lit(0.0)) if m.kind in ("ratio", "count") else low), value(m) + half


def headline(df: DataFrame, m: Metric) -> DataFrame:
    """One row: n, value, ci_low, ci_high."""
    low, high = interval(m)
    return df.agg(*sums(m)).select("n", value(m).alias("value"), low.alias("ci_low"), high.alias("ci_high"))


def breakdown(df: DataFrame, m: Metric, dims: list[str], top: int = 25) -> DataFrame:
    """Rows (dimension, segment, n, value, ci_low, ci_high, baseline, delta, low_confidence); the ``top`` segments by rows
    of each dimension. All dimensions are aggregated in one pass.
    """
    low, high = interval(m)
    used = dict.fromkeys(c for c in (m.num, m.den) if c)
    long = df.select(*used, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment")) for d in dims])).alias("__d"))
    groups = long.where(F.col("__d.segment").isNotNull()).groupBy("__d.dimension", "__d.segment").agg(*sums(m), F.count(F.lit(1)).alias("rows"))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("rows"), "segment"))
    base = df.agg(*sums(m)).select(value(m).alias("baseline"))
    cut = groups.withColumn("r", rank).where(F.col("r") <= top).join(F.broadcast(base))  # one row
    return cut.select("dimension", "segment", "n", value(m).alias("value"), low.alias("ci_low"), high.alias("ci_high"), "baseline", (value(m) - F.col("baseline")).alias("delta"), (F.col("n") < THIN).alias("low_confidence"))


def compare_periods(df: DataFrame, m: Metric, date: str, months: int = 1) -> DataFrame:
    """One row: current (t - k, t] against prior (t - 2k, t - k], t the last date; delta, share, z, significant."""
    last = df.agg(F.max(date).alias("t"))
    step = lambda k: F.make_interval(F.lit(0), F.lit(k))
    dated = df.join(F.broadcast(last))
    period = F.when(F.col(date) > F.col("t") - step(months), "current").when(F.col(date) > F.col("t") - step(2 * months), "prior")
    by = dated.withColumn("period", period).where("period is not null").groupBy("period").agg(*sums(m))
    se = deviation(m)
    side = by.select("period", "n", "sy", value(m).alias("v"), se.alias("se"))
    pick = lambda p, c: F.max(F.when(F.col("period") == p, F.col(c)))
    row = side.agg(*[F.coalesce(pick(p, c), F.lit(0)).alias(f"{p}_{c}") for p in ("current", "prior") for c in ("n", "sy", "v", "se")])
    cv, pv = F.col("current_v"), F.col("prior_v")
    if m.kind == "count":
        z = F.try_divide(cv - pv, F.sqrt(cv + pv))
    elif m.kind == "rate":
        pool = F.try_divide(F.col("current_sy") + F.col("prior_sy"), F.col("current_n") + F.col("prior_n"))
        z = F.try_divide(cv - pv, F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), F.col("current_n")) + F.try_divide(F.lit(1.0), F.col("prior_n")))))
    else:
        z = F.try_divide(cv - pv, F.sqrt(F.col("current_se") ** 2 + F.col("prior_se") ** 2))
    return row.select(
        F.col("current_n").cast("long").alias("current_n"), F.col("prior_n").cast("long").alias("prior_n"), cv.alias("current"), pv.alias("prior"), (cv - pv).alias("delta_abs"), F.try_divide(cv - pv, F.abs(pv)).alias("delta_pct"), z.alias("z"), F.coalesce(F.abs(z) >= 1.96, F.lit(False)).alias("significant")
    )


def drivers(df: DataFrame, m: Metric, dims: list[str], top: int = 5) -> DataFrame:
    """Segments by their weight in the deviation from the baseline: (value - baseline) n / sum n of the dimension."""
    b = breakdown(df, m, dims)
    share = F.col("delta") * F.col("n") / F.sum("n").over(Window.partitionBy("dimension"))
    return b.withColumn("contribution", share).select("dimension", "segment", "n", "value", "contribution").orderBy(F.desc(F.abs("contribution")), "dimension", "segment").limit(top)


def domain_metrics(df: DataFrame, domain: str, amount: str, pending: str) -> DataFrame:
    """Totals of each source domain in one pass."""
    return df.groupBy(domain).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(amount), F.lit(0.0)).alias("total_fees"), F.coalesce(F.sum(pending), F.lit(0.0)).alias("total_pending"), F.count_if(F.col(pending) <= 0).alias("fully_paid"))


def resolve_dimensions(asked: list[str], aliases: dict[str, str], columns: list[str], most: int = 6) -> list[str]:
    """Columns of the asked dimensions, each column once, at most ``most``."""
    found = [aliases.get(a, a) for a in asked]
    return list(dict.fromkeys(c for c in found if c in columns))[:most]


def caveats(head: DataFrame, segments: DataFrame, comparison: DataFrame, thin: int = THIN, window: DataFrame | None = None) -> DataFrame:
    """Rows (topic, n) that a reader of a metric should know: few rows, thin segments, an insignificant change, a thin prior period, and rows that a time window (a report row of
    ``clean.time_window``) left out.
    """
    few = head.where(F.col("n") < thin).select(F.lit("few_rows").alias("topic"), "n")
    low = segments.agg(F.count_if("low_confidence").alias("n")).where("n > 0").select(F.lit("thin_segments").alias("topic"), "n")
    c = comparison.select(F.explode(F.filter(F.array(F.when(~F.col("significant"), F.struct(F.lit("change_not_significant").alias("topic"), F.col("current_n").alias("n"))), F.when(F.col("prior_n") < thin, F.struct(F.lit("thin_prior_period").alias("topic"), F.col("prior_n").alias("n")))), lambda x: x.isNotNull())).alias("x")).select("x.*")
    out = few.unionByName(low).unionByName(c)
    if window is not None:
        out = out.unionByName(window.where("rows_after < rows_before").select(F.lit("outside_window").alias("topic"), (F.col("rows_before") - F.col("rows_after")).alias("n")))
    return out


#: How each kind of metric is computed and compared.
METHODS = {
    "rate": ("proportion of a flag, Wilson interval of 95 %", "two-proportion z-test"),
    "mean": ("mean, normal interval of 95 %", "two-sample z-test"),
    "sum": ("sum, normal interval of 95 %", "two-sample z-test"),
    "count": ("number of rows, normal interval of a Poisson count of 95 %", "two-sample z-test"),
    "ratio": ("ratio of totals, ratio-estimator interval of 95 %", "two-sample z-test"),
}


def methodology(name: str, m: Metric, dims: list[str] = (), months: int | None = None) -> str:
    """How a metric's figures come about, in one sentence: the estimate, the breakdown and the test of a comparison."""
    estimate, test = METHODS[m.kind]
    parts = [f"{name} computed as {estimate}"]
    if dims:
        parts.append("broken down by " + ", ".join(dims))
    if months:
        parts.append(f"{months} months compared with the {months} before by a {test} (|z| >= 1.96)")
    return "; ".join(parts) + "."
