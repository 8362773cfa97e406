"""Time-dependent churn labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.explore import group_quantile
from tidewater.operators.metrics import Blocked


def as_of(df: DataFrame, dates: list[str]) -> DataFrame:
    """One row: the last of all dates."""
    return df.agg(F.greatest(*[F.max(d) for d in dates]).alias("as_of") if len(dates) > 1 else F.max(dates[0]).alias("as_of"))


def resolve_duration(df: DataFrame, duration: str, course: str, table: dict[str, float] | None = None) -> DataFrame:
    """Adds duration_days and duration_basis: own positive value, then the course's median, then the given table."""
    own = F.when(F.col(duration) > 0, F.col(duration).cast("double"))
    median = group_quantile(df.where((F.col(duration) > 0) & F.col(course).isNotNull()).select(F.col(course).alias("__c"), F.col(duration).alias("__d")), ["__c"], "__d").select("__c", F.col("q").alias("__median"))
    out = df.join(median, F.col(course) == F.col("__c"), "left")
    given = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(course)].cast("double") if table else F.lit(None).cast("double")
    basis = F.when(own.isNotNull(), "own").when(F.col("__median").isNotNull(), "course_median").when(given.isNotNull(), "table")
    return out.withColumns({"duration_days": F.coalesce(own, F.col("__median"), given), "duration_basis": basis}).drop("__c", "__median")


def default_durations(df: DataFrame, by_category: dict[str, float], columns: list[str]) -> DataFrame:
    """Fills duration_days that is still null from a table of category -> days (case and outer blanks aside), by the first of ``columns`` (the student's category, then the
    course) whose value it has; duration_basis becomes category_default:<column>.
    """
    table = F.create_map(*[F.lit(x) for k, v in by_category.items() for x in (k.strip().lower(), float(v))])
    have = [c for c in columns if c in df.columns]
    found = [F.try_element_at(table, F.lower(F.trim(F.col(c).cast("string")))) for c in have]
    if not have or not by_category:
        return df
    basis = F.coalesce(*[F.when(f.isNotNull(), F.lit(f"category_default:{c}")) for c, f in zip(have, found, strict=True)])
    open_ = F.col("duration_days").isNull()
    return df.withColumns({"duration_days": F.coalesce("duration_days", *found), "duration_basis": F.when(open_, basis).otherwise(F.col("duration_basis"))})


def churn(df: DataFrame, status: str, start: str, as_of: Column, grace_months: int = 6, staff: str | None = None, unconditional: bool = False) -> DataFrame:
    """Adds churn_status, is_churn (null where it cannot be told), deadline and tenure_days.

    The clock starts at the course's end: start plus duration_days; the deadline is ``grace_months`` later. ``unconditional``: who is not to be entertained has
    churned whatever the calendar says. Rows that the flag ``staff`` marks (students who became staff) have left for no other reason: they are staff_alumni, not churned, paused or unlabelled.
    """
    end = F.col(start) + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.col("duration_days").cast("int"))
    deadline = end + F.make_interval(F.lit(0), F.lit(grace_months))
    risk = F.col(status).isin("not_coming", "not_to_entertain")
    label = F.when(F.col(status).isNull(), "no_membership").when(F.col(status).isin("completed", "active"), F.col(status)).when(risk & F.col("__deadline").isNull(), "unlabelled").when(risk & (as_of >= F.col("__deadline")), "churned").when(risk, "paused").otherwise("unlabelled")
    if unconditional:
        label = F.when(F.col(status) == "not_to_entertain", "churned").otherwise(label)
    if staff:
        label = F.when(F.coalesce(F.col(staff).cast("boolean"), F.lit(False)) & label.isin("churned", "paused", "unlabelled"), "staff_alumni").otherwise(label)
    out = df.withColumn("__deadline", deadline).withColumn("churn_status", label)
    days = lambda a, b: F.floor((F.unix_micros(a) - F.unix_micros(b)) / 86_400_000_000)
    until = F.when(F.col("churn_status") == "churned", F.col("__deadline")).otherwise(as_of)
    flag = F.when(F.col("churn_status") == "churned", True).when(F.col("churn_status").isin("paused", "active", "completed", "staff_alumni"), False)
    return out.withColumns({"is_churn": flag, "tenure_days": days(until.cast("timestamp"), F.col(start).cast("timestamp"))}).withColumnRenamed("__deadline", "deadline")


def churn_summary(df: DataFrame) -> DataFrame:
    """Rows (churn_status, n) with the rate churned / (churned + paused) beside."""
    counts = df.groupBy("churn_status").agg(F.count(F.lit(1)).alias("n"))
    rate = df.agg(F.try_divide(F.count_if(F.col("churn_status") == "churned"), F.count_if(F.col("churn_status").isin("churned", "paused"))).alias("churn_rate"))
    return counts.join(F.broadcast(rate))


def start_date(df: DataFrame, joining: str, admission: str) -> DataFrame:
    """Adds start_date: the joining date if the table has any, else the admission date; one column for all rows."""
    have = {c: c in df.columns for c in (joining, admission)}
    any_joined = have[joining] and df.where(F.col(joining).isNotNull()).limit(1).count() > 0
    if not any_joined and not have[admission]:
        raise Blocked(f"neither {joining} nor {admission} starts the clock")
    return df.withColumn("start_date", F.col(joining if any_joined else admission))


def past_course_end(df: DataFrame, start: str, as_of: Column) -> DataFrame:
    """Adds days_past_course_end (start plus duration_days to ``as_of``; never below 0)."""
    end = F.date_add(F.col(start).cast("date"), F.col("duration_days").cast("int"))
    return df.withColumn("days_past_course_end", F.greatest(F.datediff(as_of, end), F.lit(0)))


def months_table(months: dict[str, float]) -> dict[str, float]:
    """Course durations in days from months of 30 days."""
    return {course: 30 * m for course, m in months.items()}
