"""What columns mean: roles by header, profiles by value, capabilities by role."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import tables as T
from tidewater.functions.canon import squeezed
from tidewater.operators.metrics import CATALOGUE, Blocked


def detect(columns: list[str]) -> dict[str, str]:
    """Role -> column by header words; a column serves one role, a role takes its first column."""
    free = [c for c in columns if not c.lower().startswith("unnamed")]
    out: dict[str, str] = {}
    for role, (include, exclude) in T.ROLES.items():
        for needle in include:
            c = next((c for c in free if needle in c.lower() and not any(x in c.lower() for x in exclude)), None)
            if c:
                out[role] = c
                free.remove(c)
                break
    return out


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, n, n_distinct, pii_share, numeric_share, date_share, kind) of text columns, from one aggregation each way."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]))
    long = df.select(cells.alias("x")).select("x.*").where("v is not null and trim(v) <> ''")
    digits = F.regexp_replace("v", r"\D", "")
    bare = F.regexp_replace("v", r"[₹$£€,\s]", "")
    phone = F.length(digits).between(10, 12) & F.col("v").rlike(r"^[\d\s()+.\-]+$") & ~F.col("v").rlike(r"[/:]")
    date = F.col("v").rlike(r"^\s*\d{1,4}[/\-.]\d{1,2}[/\-.]\d{1,4}") | F.col("v").rlike(r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b.*\d")
    number = bare.try_cast("double")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    g = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("n_distinct"), share(phone | F.col("v").contains("@")).alias("pii_share"), share(number.isNotNull()).alias("numeric_share"), share(date).alias("date_share"), share(bare.rlike(r"^\d+$")).alias("int_share"), F.percentile(F.length("v"), 0.5).alias("len"))
    unique = F.col("n_distinct") / F.col("n")
    an_id = (F.col("n") >= 20) & (F.col("int_share") >= 0.95) & (F.col("len") >= 6) & (unique >= 0.95)
    kind = F.when(F.col("pii_share") >= 0.6, "pii").when((F.col("numeric_share") >= 0.8) & ~an_id, "numeric").when(F.col("date_share") >= 0.6, "date").when((F.col("n_distinct") <= 50) & (unique < 0.5), "dimension").otherwise("none")
    return g.select("column", "n", "n_distinct", "pii_share", "numeric_share", "date_share", kind.alias("kind"))


#: Relative error of distinct counts that are only estimated, and how many of them a threshold must be away.
ERROR, AWAY = 0.01, 4


def distinct_where_it_matters(df: DataFrame, shown: dict[str, Column], n: dict[str, int], estimate: dict[str, int], thresholds) -> dict[str, int]:
    """Distinct counts: the estimates, or an exact count for columns whose estimate is near a threshold (name -> numbers that decide). A count a column, each without a copy of the rows."""
    out = dict(estimate)
    for name, about in estimate.items():
        if n[name] and any(abs(about - t) <= AWAY * ERROR * max(about, t) + 1 for t in thresholds(name)):
            out[name] = df.select(shown[name].alias("v")).where("v is not null").distinct().count()
    return out


def column_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, n, pii_share, numeric_share, date_share, kind) of text columns, decided as ``profile`` decides, from one aggregation that neither
    copies rows by column nor holds distinct values: distinct counts are sketches, made exact only where they decide nothing surely.
    """
    text = {c: F.trim(F.col(f"`{c}`").cast("string")) for c in columns}
    shown = {c: F.when(t != "", F.col(f"`{c}`").cast("string")) for c, t in text.items()}
    share = lambda v, hit: F.avg(F.when(v.isNotNull(), F.coalesce(hit, F.lit(False)).cast("double")))
    aggs = []
    for k, v in enumerate(shown.values()):
        digits, bare = F.regexp_replace(v, r"\D", ""), F.regexp_replace(v, r"[₹$£€,\s]", "")
        phone = F.length(digits).between(10, 12) & v.rlike(r"^[\d\s()+.\-]+$") & ~v.rlike(r"[/:]")
        date = v.rlike(r"^\s*\d{1,4}[/\-.]\d{1,2}[/\-.]\d{1,4}") | v.rlike(r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b.*\d")
        parts = {"n": F.count(v), "d": F.approx_count_distinct(v, ERROR), "pii": share(v, phone | v.contains("@")), "num": share(v, bare.try_cast("double").isNotNull()), "date": share(v, date), "int": share(v, bare.rlike(r"^\d+$")), "long": F.count_if(F.length(v) >= 6), "odd": F.count_if(F.length(v) >= 7)}
        aggs += [c.alias(f"{name}{k}") for name, c in parts.items()]
    row = df.agg(*aggs).first()
    get = lambda name, k: row[f"{name}{k}"] or 0
    n = {c: get("n", k) for k, c in enumerate(columns)}
    distinct = distinct_where_it_matters(df, shown, n, {c: get("d", k) for k, c in enumerate(columns)}, lambda c: (50, 0.5 * n[c], 0.95 * n[c]))
    out = []
    for k, c in enumerate(columns):
        if not n[c]:
            continue
        unique = distinct[c] / n[c]
        half_long = get("long", k) * 2 >= n[c] if n[c] % 2 or get("long", k) * 2 != n[c] else False
        an_id = n[c] >= 20 and get("int", k) >= 0.95 and half_long and unique >= 0.95
        kind = "pii" if get("pii", k) >= 0.6 else "numeric" if get("num", k) >= 0.8 and not an_id else "date" if get("date", k) >= 0.6 else "dimension" if distinct[c] <= 50 and unique < 0.5 else "none"
        out.append((c, n[c], float(get("pii", k)), float(get("num", k)), float(get("date", k)), kind))
    return df.sparkSession.createDataFrame(out, "column string, n long, pii_share double, numeric_share double, date_share double, kind string")


def schema_kinds(df: DataFrame) -> DataFrame:
    """Rows (column, kind, n_values) as ``infer_schema`` tells kinds, from sketches; n_values is exact and given for categorical columns only."""
    shown = {c: F.col(f"`{c}`") for c in df.columns}
    n, *d = df.agg(F.count(F.lit(1)), *[F.approx_count_distinct(c, ERROR) for c in shown.values()]).first()
    about = dict(zip(df.columns, d, strict=True))
    whole = {c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint")}
    about = distinct_where_it_matters(df, shown, dict.fromkeys(df.columns, n), about, lambda c: (20, 0.95 * n) if c in whole else (50, 0.5 * n))
    rows = [(c, kind, about[c]) for c, kind in kinds_of(df.dtypes, n, about)]
    few = {c: df.select(shown[c].alias("v")).where("v is not null").distinct().count() for c, kind, _ in rows if kind == "categorical"}
    return df.sparkSession.createDataFrame([(c, kind, few.get(c)) for c, kind, _ in rows], "column string, kind string, n_values long")


def kinds_of(dtypes: list[tuple[str, str]], n: int, distinct: dict[str, int]) -> list[tuple[str, str]]:
    """Kinds of columns by type and cardinality."""
    out = []
    for name, kind in dtypes:
        whole, k = kind in ("tinyint", "smallint", "int", "bigint"), distinct[name]
        if kind.startswith(("date", "timestamp")) or (kind == "string" and "date" in name.lower()):
            out.append((name, "date"))
        elif whole and k >= max(20, 0.95 * n):
            out.append((name, "id"))
        elif whole or kind in ("float", "double") or kind.startswith("decimal"):
            out.append((name, "amount"))
        else:
            out.append((name, "categorical" if k <= 50 and n and k / n < 0.5 else "text"))
    return out


def null_rates(df: DataFrame) -> DataFrame:
    """Rows (column, null_rate), four decimals, one aggregation."""
    rates = df.agg(*[F.round(F.avg(F.col(f"`{c}`").isNull().cast("double")), 4).alias(f"c{k}") for k, c in enumerate(df.columns)])
    return rates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{k}").alias("null_rate")) for k, c in enumerate(df.columns)])).alias("x")).select("x.*")


def lifecycle_column(df: DataFrame, floor: float = 0.6, states: int = 2) -> DataFrame:
    """Rows (column, share, n_states) of text columns that speak the lifecycle vocabulary, the best first."""
    text = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    if not text:
        return df.sparkSession.createDataFrame([], "column string, share double, n_states long")
    pairs = F.create_map(*[F.lit(x) for kv in T.LIFECYCLE_VALUES.items() for x in kv])
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), squeezed(F.col(f"`{c}`")).alias("v")) for c in text])).alias("x")).select("x.*").where("v <> ''")
    state = F.try_element_at(pairs, F.col("v"))
    g = long.groupBy("column").agg(F.avg((state.isNotNull() | F.col("v").isin(T.LIFECYCLE_UNKNOWN)).cast("double")).alias("share"), F.count_distinct(state).alias("n_states"))
    return g.where((F.col("share") >= floor) & (F.col("n_states") >= states)).orderBy(F.desc("share"), "column")


def drift(columns: list[str], required: list[str], optional: list[str] = (), deprecated: list[str] = ()) -> dict[str, list[str]]:
    """Missing, extra and deprecated columns, case aside."""
    have = {c.lower() for c in columns}
    known = {c.lower() for c in [*required, *optional, *deprecated]}
    return {"missing": [c for c in required if c.lower() not in have], "extra": [c for c in columns if c.lower() not in known], "deprecated": [c for c in deprecated if c.lower() in have]}


def capability(spark, columns: list[str]) -> DataFrame:
    """Rows (metric, available, missing) for the metric catalogue."""
    rows = []
    for name, m in CATALOGUE.items():
        missing = [c for c in (m.num, m.den) if c and c not in columns]
        rows.append((name, not missing, ",".join(missing)))
    return spark.createDataFrame(rows, "metric string, available boolean, missing string")


def missing_roles(capabilities: DataFrame) -> DataFrame:
    """Missing columns by the number of metrics they would unlock."""
    return capabilities.where("not available").select("metric", F.explode(F.split("missing", ",")).alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("unlocks")).orderBy(F.desc("unlocks"), "column")


def domain(name: str, columns: list[str]) -> str:
    """Domain of a source by words of its name and headers."""
    text = " ".join([name, *columns]).lower()
    for label, needles in {"finance": ["fee", "receipt", "payment"], "certificate": ["certificate"], "student": ["student", "timetable", "roster"], "admission": ["admission"], "marketing": ["enquiry", "lead", "campaign"], "operations": ["faculty", "batch"]}.items():
        if any(n in text for n in needles):
            return label
    return "unknown"


def repeated_keys(df: DataFrame, key: list[str]) -> bool:
    """Whether some key occurs twice: an existence query."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    return df.where(known).groupBy(*key).count().where("count > 1").limit(1).count() > 0


#: Values of a mode that tell how a class is attended.
ATTENDING = ["online", "offline", "hybrid", "both"]


def specialise(df: DataFrame, roles: dict[str, str]) -> dict[str, str]:
    """The roles with what headers of many meanings mean beside the others. A Timestamp is the record's; it dates an enquiry only where no column does so by name and no admission stands beside
    it. A mode whose values are all ways of attending is the learning mode, else on a sheet of enquiries theirs. A status beside fees is the fees', beside a reason for leaving the churn's. The general
    role stays, the special one is added.
    """
    out = dict(roles)
    asked = out.get("enquiry_date", "")
    if asked.strip().lower() == "timestamp":
        out["record_timestamp"] = asked
        named = next((c for c in df.columns if "date of enquiry" in c.strip().lower()), None)
        if named:
            out["enquiry_date"] = named
        elif "admission_date" in out or "joining_date" in out:
            del out["enquiry_date"]
    if out.get("mode") in df.columns:
        way = F.lower(F.trim(F.col(f"`{out['mode']}`").cast("string")))
        n, others = df.agg(F.count(way), F.count_if(~way.isin(ATTENDING))).first()
        if n and not others:
            out["learning_mode"] = out["mode"]
        elif "enquiry_date" in out and "admission_date" not in out:
            out["enquiry_mode"] = out["mode"]
    if "status" in out:
        if {"pending", "amount", "paid"} & set(out):
            out["fee_status"] = out["status"]
        elif "status_reason" in out or "completion_status" in df.columns:
            out["churn_status"] = out["status"]
    return out


def infer_schema(df: DataFrame) -> DataFrame:
    """Rows (column, kind, n_distinct) by type and cardinality: date, id (whole numbers, nearly all distinct), amount, categorical, text; one pass."""
    n, *d = df.agg(F.count(F.lit(1)), *[F.count_distinct(F.col(f"`{c}`")) for c in df.columns]).first()
    distinct = dict(zip(df.columns, d, strict=True))
    rows = [(c, kind, distinct[c]) for c, kind in kinds_of(df.dtypes, n, distinct)]
    return df.sparkSession.createDataFrame(rows, "column string, kind string, n_distinct long")


def validate(sources: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Rows (source, item, kind, value): the rows and the null rate of each column of each source from one aggregation, and the repeats of each key column from counts by key."""
    out = None
    for name, df in sources.items():
        agg = df.agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"c{k}") for k, c in enumerate(df.columns)])
        cells = [("rows", "rows", "n"), *[(c, "null_rate", f"c{k}") for k, c in enumerate(df.columns)]]
        parts = [agg.select(F.explode(F.array(*[F.struct(F.lit(a).alias("item"), F.lit(b).alias("kind"), F.col(c).alias("value")) for a, b, c in cells])).alias("x")).select("x.*")]
        for k in (k for k in keys if k in df.columns):
            per = df.where(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias("n"))
            parts.append(per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double").alias("value")).select(F.lit(k).alias("item"), F.lit("repeated_keys").alias("kind"), "value"))
        rows = reduce(lambda a, b: a.unionByName(b), parts).select(F.lit(name).alias("source"), "item", "kind", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def join_plan(spark: SparkSession, columns: dict[str, list[str]], key: str = "student_id", identity: list[str] = ("name", "student_mobile", "email")) -> DataFrame:
    """Rows (source, role, on, confidence): the master by what its name and columns say, and how each other source would join it."""
    def points(name: str) -> int:
        d = domain(name, columns[name])
        return 100 * (key in columns[name]) + {"student": 50, "finance": -20, "certificate": -20, "admission": -10}.get(d, 0)

    lead = max(columns, key=lambda n: (points(n), -list(columns).index(n)))
    rows = [(lead, "master", None, None)]
    for name, cols in columns.items():
        if name == lead:
            continue
        shared = [c for c in identity if c in cols and c in columns[lead]]
        on, how = (key, "high") if key in cols and key in columns[lead] else (",".join(shared), "medium") if shared else (None, "low")
        rows.append((name, "left join" if on else "none", on, how))
    return spark.createDataFrame(rows, "source string, role string, on string, confidence string")


def role_sources(sources: dict[str, dict[str, str]]) -> dict[str, list[str]]:
    """Role -> sources that have it; date_any where a source has any date, completion_source where it has a status or is named as a roster's part."""
    out: dict[str, list[str]] = {}
    for name, roles in sources.items():
        have = list(roles)
        if any(r.endswith("_date") for r in roles):
            have.append("date_any")
        if "status" in roles or any(needle in name.lower() for needle, _ in T.LIFECYCLE_BY_SOURCE):
            have.append("completion_source")
        for r in have:
            out.setdefault(r, []).append(name)
    return out


def adapt(questions: list[tuple[str, list[str]]], columns: list[str]) -> list[tuple[str, list[str], str]]:
    """Questions (metric, dimensions) with the dimensions that are there, and full, partial or no; metrics without their columns are left out."""
    out = []
    for metric, dims in questions:
        m = CATALOGUE.get(metric)
        if m and any(c and c not in columns for c in (m.num, m.den)):
            continue
        kept = [d for d in dims if d in columns]
        out.append((metric, kept, "full" if len(kept) == len(dims) else "partial" if kept else "no"))
    return out


def prune_questions(questions: list[tuple[str, str, list[str]]], columns: list[str]) -> list[tuple[str, str, list[str]]]:
    """Questions (id, metric, dimensions) that can be computed come first; of equal (metric, first dimension) the first stays. The first question always stays."""
    ready = lambda q: not (m := CATALOGUE.get(q[1])) or all(not c or c in columns for c in (m.num, m.den))
    out, seen = [], set()
    for q in sorted(questions, key=lambda q: not ready(q)):
        mark = (q[1], q[2][0] if q[2] else None)
        if mark not in seen or q[0] == questions[0][0]:
            out.append(q)
        seen.add(mark)
    return out


def generic_question(df: DataFrame, most: int = 6, low: int = 2, high: int = 50) -> tuple[str, list[str]]:
    """``(measure, dimensions)`` for a table of unknown meaning: its first amount, and the dimensions of 2 to 50 values. Blocked without either."""
    kinds = {r["column"]: (r["kind"], r["n_values"]) for r in schema_kinds(df).collect()}  # a row per column
    measure = next((c for c in df.columns if kinds[c][0] == "amount"), None)
    dims = [c for c in df.columns if kinds[c][0] == "categorical" and low <= kinds[c][1] <= high][:most]
    if measure is None or not dims:
        raise Blocked("no amount to add up, or no dimension to add it up by")
    return measure, dims


def reporting_column(role: str, roles: dict[str, str], columns: list[str]) -> str | None:
    """The column that a role is reported by: for courses the derived category, where there is one and the role is not a header itself."""
    if role in columns:
        return role
    if role == "course" and "course_category_derived" in columns:
        return "course_category_derived"
    return roles[role] if roles.get(role) in columns else None
