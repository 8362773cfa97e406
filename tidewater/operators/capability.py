"""What given sources can answer: role sets of metrics, the data that is missing, values that flags would need; roles over joined sources."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import canon
from tidewater.functions import tables as T
from tidewater.operators.identity import DISCRIMINATORS
from tidewater.operators.roles import lifecycle_column, role_sources

STALE_DAYS = 30


def probes(df: DataFrame, roles: dict[str, str]) -> list[str]:
    """Those of cancel_marker, stale_enquiry, repeat_person and lifecycle_column that the values would give: flags that a header alone does not promise.

    Marks and dates take one aggregation; repeats one of counts by person, as the cleaning will key them.
    """
    have = {r: F.col(f"`{c}`") for r, c in roles.items() if c in df.columns}
    found = []
    marked = [c.cast("string").rlike(p) for r, c in have.items() if r in ("name", "status", "status_reason") for p, label in T.STATUS_MARKS if label in ("cancelled", "refunded")]
    admitted = have.get("admission_date", have.get("joining_date", F.lit(None)))
    asked = F.to_date(have["enquiry_date"]) if "enquiry_date" in have else F.lit(None).cast("date")
    row = df.agg(*[F.max(F.coalesce(m, F.lit(False))).alias(f"m{k}") for k, m in enumerate(marked)], F.max(asked).alias("last"), F.min(F.when(admitted.isNull(), asked)).alias("oldest")).first()
    if any(row[f"m{k}"] for k in range(len(marked))):
        found.append("cancel_marker")
    if row["oldest"] is not None and (row["last"] - row["oldest"]).days > STALE_DAYS:
        found.append("stale_enquiry")
    other = next((r for r in DISCRIMINATORS if r in have), None)
    if "name" in have and other:
        key = df.select(canon.person_name(have["name"]).alias("name"), DISCRIMINATORS[other](have[other]).alias("other")).where("name <> ''")
        if not key.groupBy("name", "other").count().where("count > 1").isEmpty():
            found.append("repeat_person")
    if not lifecycle_column(df).isEmpty():
        found.append("lifecycle_column")
    return found


def roles_present(spark: SparkSession, sources: dict[str, dict[str, str]], probed: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows (role, sources): the roles that some source has by its columns or, for flags, by its values."""
    found = role_sources(sources)
    for name, flags in (probed or {}).items():
        for flag in flags:
            found.setdefault(flag, []).append(name)
    return spark.createDataFrame([(r, sorted(s)) for r, s in sorted(found.items())], "role string, sources array<string>")


def requirements(spark: SparkSession, table: dict[str, list[list[str]]] = T.REQUIREMENTS) -> DataFrame:
    """Rows (metric, choice, role) of the alternative role sets of each metric."""
    return spark.createDataFrame([(m, k, r) for m, sets in table.items() for k, roles in enumerate(sets) for r in roles], "metric string, choice int, role string")


def metric_capability(needed: DataFrame, present: DataFrame) -> DataFrame:
    """Rows (metric, available, using, missing): the first role set that is there, else the least that is missing (ties: the first set)."""
    told = needed.join(present.select("role", F.lit(True).alias("here")), "role", "left")
    sets = told.groupBy("metric", "choice").agg(F.sort_array(F.collect_list("role")).alias("all"), F.sort_array(F.collect_list(F.when(F.col("here").isNull(), F.col("role")))).alias("missing"))
    best = sets.groupBy("metric").agg(F.min(F.struct(F.size("missing").alias("k"), "choice", "all", "missing")).alias("b"))
    return best.select("metric", (F.col("b.k") == 0).alias("available"), F.when(F.col("b.k") == 0, F.col("b.all")).alias("using"), F.when(F.col("b.k") > 0, F.col("b.missing")).alias("missing"))


def question_capability(asked: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Rows (question, answerable, asked_for, answer_with, substituted, needs) for rows (question, rank, metric), rank 0 being what is asked for.

    A question is answerable by its first available metric; if that is not the one asked for, it is a substitute. An unknown metric counts rows and
    needs a date, as ``capabilities`` tells for date_any.
    """
    anything = capabilities.where("metric = 'total_leads'").select(F.col("available").alias("any_ok"), F.col("missing").alias("any_missing"))
    known = asked.join(capabilities, "metric", "left").crossJoin(F.broadcast(anything)) if "available" not in asked.columns else asked
    ok = F.coalesce("available", "any_ok")
    lack = F.coalesce("missing", F.when(F.col("available").isNull(), F.col("any_missing")))
    g = known.groupBy("question").agg(F.min_by("metric", "rank").alias("asked_for"), F.min_by("metric", F.when(ok, F.col("rank"))).alias("answer_with"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce(lack, F.array().cast("array<string>")).alias("lack")))), lambda x: x["lack"]))).alias("needs"))
    answerable = F.col("answer_with").isNotNull()
    return g.select("question", answerable.alias("answerable"), "asked_for", "answer_with", F.when(answerable, F.col("answer_with") != F.col("asked_for")).alias("substituted"), F.when(~answerable, F.col("needs")).alias("needs"))


def shopping_list(asked: DataFrame, capabilities: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows (role, n_unlocks, unlocks): missing roles by how much they unlock, most first. A blocked question wants its roles under its own name, an answerable one under
    question:metric for each metric that it cannot have, so that substitutes do not hide what was asked for.
    """
    each = asked.join(capabilities.where("not available"), "metric").join(questions.select("question", "answerable"), "question")
    want = each.select(F.explode("missing").alias("role"), F.when(F.col("answerable"), F.concat_ws(":", "question", "metric")).otherwise(F.col("question")).alias("unlocks"))
    return want.groupBy("role").agg(F.sort_array(F.collect_set("unlocks")).alias("unlocks")).select("role", F.size("unlocks").alias("n_unlocks"), "unlocks").orderBy(F.desc("n_unlocks"), "role")


# Joined sources --------------------------------------------------------------------------------------------------


def merged_roles(sources: dict[str, dict[str, str]], columns: list[str]) -> dict[str, str]:
    """Role -> column of a joined table: the bare one or, where a join has prefixed it, <source>__<column>; the first source that has a role keeps it."""
    out: dict[str, str] = {}
    for name, roles in sources.items():
        prefix = re.sub(r"\W+", "_", name).strip("_").lower()
        for role, c in roles.items():
            column = next((x for x in (c, f"{prefix}__{c}") if x in columns), None)
            if column:
                out.setdefault(role, column)
    return out


def source_summary(sources: dict[str, tuple[str, DataFrame]], joined: list[str]) -> DataFrame:
    """Rows (source, domain, n_rows, n_columns, joined); one count a source."""
    out = None
    for name, (domain, df) in sources.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("source"), F.lit(domain).alias("domain"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(name in joined).alias("joined"))
        out = row if out is None else out.unionByName(row)
    return out


def domain_totals(sources: dict[str, tuple[str, DataFrame, dict[str, str]]]) -> DataFrame:
    """Rows (domain, measure, value, n_sources) over sources (name -> domain, table, roles): fees, pending fees and full payments of finance, certificates, enrolments, leads. One
    aggregation a source, then sums of a few rows.
    """
    count = F.count(F.lit(1)).cast("double")
    out = None
    for domain, df, roles in sources.values():
        have = {r: F.col(f"`{c}`") for r, c in roles.items() if c in df.columns}
        m = {}
        if domain == "finance":
            if "amount" in have:
                m["total_fees"] = F.coalesce(F.sum(have["amount"]), F.lit(0)).cast("double")
            if "pending" in have:
                m["pending_fees"] = F.coalesce(F.sum(have["pending"]), F.lit(0)).cast("double")
                m["full_paid"] = F.count_if(F.coalesce(have["pending"], F.lit(0)) == 0).cast("double")
            elif "status" in have:
                m["full_paid"] = F.count_if(F.coalesce(F.lower(have["status"].cast("string")).contains("full paid"), F.lit(False))).cast("double")
        elif domain == "certificate" and "is_certificate_pending" in df.columns:
            waits = F.count_if(F.coalesce("is_certificate_pending", F.lit(False))).cast("double")
            m |= {"certificates_pending": waits, "certificates_issued": count - waits}
        elif domain in ("student", "product"):
            m["enrollments"] = count
        elif domain in ("admission", "marketing"):
            m["leads"] = count
        if m:
            rows = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in m]))
            part = df.agg(*[c.alias(k) for k, c in m.items()]).select(F.lit(domain).alias("domain"), rows.alias("x")).select("domain", "x.*")
            out = part if out is None else out.unionByName(part)
    return out.groupBy("domain", "measure").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n_sources"))
