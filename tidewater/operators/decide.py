"""Decision tables: findings, risks, chart data, thresholds and alerts, all from small metric tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import tables as T
from tidewater.operators.metrics import THIN

SEVERITY = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def findings(breakdown: DataFrame, kind: str, lower_is_better: bool = False, points: float = 0.05, share: float = 0.10) -> DataFrame:
    """Rows (dimension, segment, n, scaled, baseline, gap, kind, severity, confidence) of material segments.

    Sums and counts are compared per row; segments under 30 rows are never findings. Material: five points for
    rates, a tenth of the baseline for the rest.
    """
    per_row = kind in ("sum", "count")
    b = breakdown.where(F.col("n") >= THIN)
    total = Window.partitionBy("dimension")
    scaled = F.col("value") / F.col("n") if per_row else F.col("value")
    base = F.sum("value").over(total) / F.sum("n").over(total) if per_row else F.col("baseline")
    b = b.withColumn("scaled", scaled).withColumn("base", base).withColumn("gap", F.col("scaled") - F.col("base"))
    rel = F.abs(F.try_divide(F.col("gap"), F.col("base")))
    material = (F.abs("gap") >= points) if kind == "rate" else rel >= share
    good = (F.col("gap") < 0) if lower_is_better else (F.col("gap") > 0)
    size = F.coalesce(rel, F.lit(0.0))
    return b.where(material).select("dimension", "segment", "n", "scaled", F.col("base").alias("baseline"), "gap", F.when(good, "opportunity").otherwise("risk").alias("kind"), F.when(size >= 0.5, "critical").when(size >= 0.3, "high").when(size >= 0.15, "medium").otherwise("low").alias("severity"), F.when(F.col("n") >= 100, "high").otherwise("medium").alias("confidence"))


def actions(found: DataFrame, owners: DataFrame, top: int = 10) -> DataFrame:
    """Findings joined with an (dimension, owner, action) lookup, ranked: risks by severity first; one row per action."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    j = found.join(F.broadcast(owners), "dimension").withColumn("effect", F.col("gap") * F.col("n")).withColumn("r", rank)
    one = F.row_number().over(Window.partitionBy("action").orderBy("r", F.desc(F.abs("effect")), "segment"))
    j = j.withColumn("k", one).where("k = 1")
    return j.withColumn("priority", F.row_number().over(Window.orderBy("r", F.desc(F.abs("effect")), "action"))).where(F.col("priority") <= top).select("priority", "action", "owner", "dimension", "segment", "severity", "effect")


def action_plan(found: DataFrame, kind: str, roles: dict[str, str] | None = None, questions: list[str] = (), backlog: bool = False) -> DataFrame:
    """Rows (priority, action, dimension, segment, owner, category, effort, risk, timeline, bucket, quick_win, gap, n, estimate, current, target) from findings.

    A risk is a gap to close, an opportunity (1.3 times its baseline and more) a lever to scale. Only rates have an estimate, |gap| x n, and a
    target, for only there the product means something: gaps of other kinds are dropped, levers stay without figures. Dimensions that nobody owns give no action. A certificate ``backlog`` is
    one action more, each of the open ``questions`` an investigation, which ranks below all else. ``roles``: dimension column -> role.
    """
    spark = found.sparkSession
    role = F.col("dimension")
    if roles:
        role = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in roles.items() for x in kv]), role), role)
    lever = F.col("kind") == "opportunity"
    quantified = F.lit(kind == "rate")
    seen = found.where((~lever & quantified) | (lever & (F.try_divide("scaled", "baseline") >= 1.3)))
    rows = seen.select(F.when(lever, "scale_lever").otherwise("close_gap").alias("action"), role.alias("role"), "dimension", "segment", *[F.when(quantified, c).alias(name) for c, name in ((F.abs("gap"), "gap"), (F.col("n"), "n"), (F.abs("gap") * F.col("n"), "estimate"), (F.col("scaled"), "current"), (F.col("baseline"), "target"))])
    fixed = "action string, role string, dimension string, segment string, gap double, n long, estimate double, current double, target double"
    more = [("reduce_backlog", "certificate", None, None)] * backlog + [("investigate", None, None, q) for q in questions]
    rows = rows.unionByName(spark.createDataFrame([(*m, None, None, None, None, None) for m in more], fixed)).dropDuplicates(["action", "dimension", "segment"])
    look = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    effort = look({a: e for a, (e, _) in T.ACTION_EFFORT_RISK.items()}, F.col("action"))
    risk = look({a: r for a, (_, r) in T.ACTION_EFFORT_RISK.items()}, F.col("action"))
    owner = F.when(F.col("action") == "investigate", "analytics_team").otherwise(look(T.ACTION_OWNER, F.col("role")))
    told = rows.withColumns({"owner": owner, "category": F.coalesce(look(T.ACTION_CATEGORY, F.col("role")), F.lit("Operations")), "effort": effort, "risk": risk}).where("owner is not null")
    known = F.col("estimate").isNotNull()
    cheap = known & (F.col("effort") == "low") & (F.col("risk") == "low")
    bucket = F.when(~known, "P4").when(cheap, "P1").when(F.col("risk").isin("low", "medium") & F.col("effort").isin("low", "medium"), "P2").otherwise("P3")
    score = F.when(F.col("action") == "investigate", -1.0).otherwise(F.coalesce("estimate", F.lit(0.0)))
    place = F.row_number().over(Window.orderBy(F.desc(score), "action", "dimension", "segment"))  # a row a finding
    told = told.withColumns({"timeline": look(T.ACTION_TIMELINE, F.col("effort")), "bucket": bucket, "quick_win": cheap, "priority": place})
    return told.select("priority", "action", "dimension", "segment", "owner", "category", "effort", "risk", "timeline", "bucket", "quick_win", "gap", "n", "estimate", "current", "target")


def chart_tables(head: DataFrame | None = None, breakdown: DataFrame | None = None, comparison: DataFrame | None = None, monthly: DataFrame | None = None, steps: DataFrame | None = None, driving: DataFrame | None = None) -> DataFrame:
    """Tidy rows (chart, place, label, value, low, high, note) of what a report draws: the headline with its interval, one chart a dimension from the highest segment (note: n), prior against
    current (note: significant), months of a series of two and more, a funnel (low: what was lost since the step before), drivers by size. Parts that are not given are left out.
    """
    none = F.lit(None).cast("double")
    parts = []

    def add(df: DataFrame, chart: Column, order: list, label: Column, v: Column, low: Column = none, high: Column = none, note: Column = F.lit(None).cast("string")) -> None:
        cut = df.select(chart.alias("chart"), label.cast("string").alias("label"), v.cast("double").alias("value"), low.cast("double").alias("low"), high.cast("double").alias("high"), note.cast("string").alias("note"), *[o.alias(f"o{k}") for k, o in enumerate(order)])
        by = [F.col(f"o{k}") for k in range(len(order))]
        parts.append(cut.withColumn("place", F.row_number().over(Window.partitionBy("chart").orderBy(*by))).select("chart", "place", "label", "value", "low", "high", "note"))  # a few rows a chart

    if head is not None:
        add(head, F.lit("headline"), [F.lit(0)], F.lit("value"), F.col("value"), F.col("ci_low"), F.col("ci_high"), F.col("n"))
    if breakdown is not None:
        add(breakdown, F.concat(F.lit("by "), "dimension"), [-F.col("value"), F.col("segment")], F.col("segment"), F.col("value"), F.col("ci_low"), F.col("ci_high"), F.col("n"))
    if comparison is not None:
        two = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("period"), F.col(n).cast("double").alias("v")) for k, n in enumerate(("prior", "current"))])).alias("x")
        add(comparison.select("significant", two), F.lit("comparison"), [F.col("x.k")], F.col("x.period"), F.col("x.v"), note=F.when(F.col("significant"), "significant").otherwise("not significant"))
    if monthly is not None:
        enough = monthly.agg((F.count(F.lit(1)) >= 2).alias("enough"))
        add(monthly.join(F.broadcast(enough)).where("enough"), F.lit("months"), [F.col("month")], F.col("month"), F.col("value"))
    if steps is not None:
        add(steps, F.lit("funnel"), [F.col("step_no")], F.col("step"), F.col("n"), F.col("drop_off"))
    if driving is not None:
        add(driving, F.lit("drivers"), [-F.abs("contribution"), F.col("segment")], F.concat_ws("=", "dimension", "segment"), F.col("contribution"), note=F.col("n"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def kpi_card(head: DataFrame, comparison: DataFrame | None = None, lower_is_better: bool = False) -> DataFrame:
    """One row (value, delta_pct, status, confidence): good or bad by the direction of the change, neutral without one; confidence by the interval's width against the value (0.2, 0.5)."""
    width = F.try_divide(F.abs(F.col("ci_high") - F.col("ci_low")), F.abs("value"))
    told = head.select("value", F.when(width <= 0.2, "high").when(width <= 0.5, "medium").otherwise("low").alias("confidence"))
    if comparison is None:
        return told.select("value", F.lit(None).cast("double").alias("delta_pct"), F.lit("neutral").alias("status"), "confidence")
    better = F.col("delta_pct") < 0 if lower_is_better else F.col("delta_pct") > 0
    status = F.when(F.coalesce(F.col("delta_pct"), F.lit(0.0)) == 0, "neutral").when(better, "good").otherwise("bad")
    return told.join(F.broadcast(comparison.select("delta_pct"))).select("value", "delta_pct", status.alias("status"), "confidence")


def funnel(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """Rows (step_no, step, n, drop_off): rows that satisfy each step's flag, and the share lost since the step before."""
    counts = df.agg(*[F.count_if(F.col(c)).alias(f"s{k}") for k, (_, c) in enumerate(steps)])
    rows = counts.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("step"), F.col(f"s{k}").alias("n")) for k, (n, _) in enumerate(steps)])).alias("step_no", "x")).select("step_no", "x.*")
    return rows.withColumn("drop_off", 1 - F.try_divide(F.col("n"), F.lag("n").over(Window.orderBy("step_no"))))


def parse_threshold(text: str) -> tuple[str, float] | None:
    """'below 31%' -> ('<', 0.31); None if it does not read."""
    m = re.search(r"(below|under|less than|<|above|over|more than|>)\s*=?\s*(-?\d+(?:\.\d+)?)\s*(%)?", text.lower())
    if not m:
        return None
    return "<" if m[1] in ("below", "under", "less than", "<") else ">", float(m[2]) / (100 if m[3] else 1)


def evaluate_hooks(hooks: DataFrame, values: DataFrame) -> DataFrame:
    """Hooks (id, metric, scope, op, threshold, severity) that fire against values (metric, scope, value)."""
    j = hooks.join(values, ["metric", "scope"])
    fired = F.when(F.col("op") == "<", F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    return j.where(fired).select("id", "metric", "scope", "value", "op", "threshold", "severity")


def upsert(registry: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The registry with the changes' rows in place of its own; of several changes to a key the last (by seq) counts."""
    last = changes.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).where("__n = 1").drop("__n", "seq")
    return registry.join(last, key, "left_anti").unionByName(last)


def business_rules(values: DataFrame, rules: DataFrame, alerted: DataFrame | None = None) -> DataFrame:
    """One event per metric: its severest rule that fires; metrics already alerted are skipped."""
    fired = evaluate_hooks(rules, values)
    if alerted is not None:
        fired = fired.join(alerted.select("metric").distinct(), "metric", "left_anti")
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return fired.withColumn("k", F.row_number().over(Window.partitionBy("metric").orderBy(order, "id"))).where("k = 1").drop("k")


def target_deviation(values: DataFrame, targets: DataFrame) -> DataFrame:
    """Metrics below their target; critical below 85 % of it."""
    j = values.join(targets, "metric").where(F.col("value") < F.col("target"))
    return j.withColumn("severity", F.when(F.col("value") < 0.85 * F.col("target"), "critical").otherwise("high"))


def health(events: DataFrame) -> DataFrame:
    """Events without repeats of (metric, scope, type), and the state they add up to: Critical, Watch or Good."""
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    one = events.withColumn("k", F.row_number().over(Window.partitionBy("metric", "scope", "type").orderBy(order))).where("k = 1").drop("k")
    return one.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("severity") == "critical").alias("critical")).withColumn("state", F.when(F.col("critical") > 0, "Critical").when(F.col("events") > 0, "Watch").otherwise("Good"))


def severity(share: Column) -> Column:
    """Band of a relative gap: 0.15, 0.3 and 0.5."""
    return F.when(share >= 0.5, "critical").when(share >= 0.3, "high").when(share >= 0.15, "medium").otherwise("low")


def confidence(n: Column) -> Column:
    """Band of a number of rows: 30 and 100."""
    return F.when(n >= 100, "high").when(n >= 30, "medium").otherwise("low")


def potential(ratio: Column) -> Column:
    """Band of a segment's value over its baseline: 1.3 and 1.5."""
    return F.when(ratio >= 1.5, "high").when(ratio >= 1.3, "medium").otherwise("low")


def segment_insights(breakdown: DataFrame) -> DataFrame:
    """The best segment of each dimension (ties: the smaller name), however few rows it has; confidence tells."""
    best = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("value"), "segment"))
    return breakdown.withColumn("k", best).where("k = 1").select("dimension", "segment", "n", "value", confidence(F.col("n")).alias("confidence"))


def trend_insights(comparison: DataFrame, least: float = 0.02) -> DataFrame:
    """Rows (trend, strength) of period comparisons with a relative change."""
    d = F.col("delta_pct")
    return comparison.where("delta_pct is not null").select(F.when(d > least, "growing").when(d < -least, "declining").otherwise("stable").alias("trend"), F.when(F.col("significant"), "significant").otherwise("weak").alias("strength"), "delta_pct")


def root_causes(drivers: DataFrame, associations: DataFrame, top: int = 2, least: float = 0.1) -> DataFrame:
    """Rows (cause, kind, impact): the largest drivers, and the strongest association that is more than weak."""
    d = drivers.orderBy(F.desc(F.abs("contribution")), "dimension", "segment").limit(top).select(F.concat_ws("=", "dimension", "segment").alias("cause"), F.lit("driver").alias("kind"), F.col("contribution").alias("impact"))
    a = associations.where(F.col("cramers_v") >= least).orderBy(F.desc("cramers_v"), "dim_a", "dim_b").limit(1).select(F.concat_ws(" x ", "dim_a", "dim_b").alias("cause"), F.lit("association").alias("kind"), F.col("cramers_v").alias("impact"))
    return d.unionByName(a)


def business_health(comparison: DataFrame, found: DataFrame, lower_is_better: bool = False, quality: float | None = None) -> DataFrame:
    """One row (score, state): 70, plus 15 or minus 20 for each significant change, minus 10 for each grave risk, plus 5 for each large
    opportunity. Quality below 50 keeps the state from 'good' and better.
    """
    worse = (F.col("delta_pct") > 0) if lower_is_better else (F.col("delta_pct") < 0)
    moved = comparison.where("significant and delta_pct is not null").agg(F.coalesce(F.sum(F.when(worse, -20).otherwise(15)), F.lit(0)).alias("a"))
    gain = F.try_divide(F.col("scaled"), F.col("baseline")) >= 1.5
    risks = found.agg((-10 * F.count_if((F.col("kind") == "risk") & F.col("severity").isin("high", "critical")) + 5 * F.count_if((F.col("kind") == "opportunity") & gain)).alias("b"))
    score = F.lit(70) + F.col("a") + F.col("b")
    open_ = quality is None or quality >= 50
    state = F.when(score >= 50, "stable").when(score >= 30, "concerning").otherwise("critical")
    if open_:
        state = F.when(score >= 85, "excellent").when(score >= 70, "good").otherwise(state)
    return moved.join(risks).select(score.cast("long").alias("score"), state.alias("state"))


def confidence_score(comparison: DataFrame, associations: DataFrame, quality: float | None = None, least: float = 0.1) -> DataFrame:
    """One row (confidence): 0.4 data quality, 0.4 whether a comparison is significant, 0.2 whether an association is more than weak; of 100."""
    part = lambda any_, hit: F.when(~any_, 0.5).when(hit, 0.9).otherwise(0.4)
    c = comparison.agg(part(F.count(F.lit(1)) > 0, F.coalesce(F.bool_or("significant"), F.lit(False))).alias("c"))
    a = associations.agg(part(F.count(F.lit(1)) > 0, F.coalesce(F.bool_or(F.col("cramers_v") >= least), F.lit(False))).alias("a"))
    data = 0.6 if quality is None else quality / 100
    return c.join(a).select(F.round(100 * (0.4 * F.lit(data) + 0.4 * F.col("c") + 0.2 * F.col("a"))).cast("int").alias("confidence"))


def trend_alerts(comparison: DataFrame, metric: str, lower_is_better: bool = False) -> DataFrame:
    """A warning for each significant adverse change of a metric."""
    adverse = (F.col("delta_abs") > 0) if lower_is_better else (F.col("delta_abs") < 0)
    return comparison.where(F.col("significant") & adverse).select(F.lit(metric).alias("metric"), F.lit("trend_alert").alias("type"), F.lit("warning").alias("severity"), F.when(F.col("delta_abs") < 0, "declining").otherwise("rising").alias("trend"), F.col("current").alias("observed"), F.col("prior").alias("threshold"), "delta_pct")


def report_summary(answers: DataFrame, acts: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(summary, actions)``: one row (answered, skipped, metrics) of answers (metric, value, blocked), and the first actions by priority."""
    s = answers.agg(F.count_if(F.col("blocked").isNull()).alias("answered"), F.count_if(F.col("blocked").isNotNull()).alias("skipped"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("blocked").isNull(), F.col("metric")))), ",").alias("metrics"))
    return s, acts.orderBy("priority").limit(top)


def quality_report(df: DataFrame, date: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows (kind, item, n): rows read, rows without a date, rows whose key repeats an earlier one, and blanks by column; one aggregation
    besides the distinct keys.
    """
    known = F.struct(*keys)
    whole = [F.col(k).isNotNull() for k in keys]
    keyed = whole[0]
    for w in whole[1:]:
        keyed = keyed & w
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(date).isNull()).alias("undated"), (F.count_if(keyed) - F.count_distinct(F.when(keyed, known))).alias("repeats"), *[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"c{k}") for k, c in enumerate(columns)])
    row = lambda kind, item, c: F.struct(F.lit(kind).alias("kind"), F.lit(item).alias("item"), F.col(c).alias("n"))
    return r.select(F.explode(F.array(row("rows", "read", "n"), row("dropped", "undated", "undated"), row("dropped", "repeated " + ",".join(keys), "repeats"), *[row("blank", c, f"c{k}") for k, c in enumerate(columns)])).alias("x")).select("x.*")
