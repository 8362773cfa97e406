"""Cleaning of messy tables: columns to drop, dates of mixed order, money, keys that are measured before use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import canon
from tidewater.operators.metrics import Blocked
from tidewater.operators.ranking import free, written

_AB = r"^\s*(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2}|\d{4})(?:\s+.*)?$"


def drop_broken_columns(df: DataFrame) -> DataFrame:
    """Columns whose header holds #REF!, columns without any value (one aggregation), and X where 'Cleaned X' exists."""
    df = df.drop(*[c for c in df.columns if "#ref!" in c.lower()])
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(df.columns)]).first()
    df = df.drop(*[c for k, c in enumerate(df.columns) if not counts[k]])
    for c in df.columns:
        if c.lower().startswith("cleaned "):
            old = next((o for o in df.columns if o.lower() == c[8:].lower()), None)
            df = (df.drop(old) if old else df).withColumnRenamed(c, old or c[8:])
    return df


def purge_placeholders(df: DataFrame) -> DataFrame:
    """Without rows in which some text cell starts with 'zzz'."""
    text = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    if not text:
        return df
    return df.where(~reduce(lambda a, b: a | b, [F.coalesce(F.col(f"`{c}`").rlike(r"(?i)^\s*z{3,}"), F.lit(False)) for c in text]))


def date_votes(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Whether each column reads day first: unambiguous values vote, all columns in one pass; ties read day first."""
    votes = []
    for k, c in enumerate(columns):
        a, b = (F.regexp_extract(F.col(f"`{c}`"), _AB, g).try_cast("int") for g in (1, 2))
        votes += [F.count_if((a > 12) & (b <= 12)).alias(f"d{k}"), F.count_if((b > 12) & (a <= 12)).alias(f"m{k}")]
    row = df.agg(*votes).first()
    return {c: row[f"d{k}"] >= row[f"m{k}"] for k, c in enumerate(columns)}


def parse_date(c: Column, day_first: bool = True) -> Column:
    """Timestamp of a/b/y in the preferred order, the other order where that is impossible, or of ISO text; else null."""
    a, b, y = (F.regexp_extract(c, _AB, g).try_cast("int") for g in (1, 2, 3))
    year = F.when(y < 100, F.when(y < 69, y + 2000).otherwise(y + 1900)).otherwise(y)
    make = lambda d, m: F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, m, d), F.lit("yyyy-MM-dd"))
    first, other = (make(a, b), make(b, a)) if day_first else (make(b, a), make(a, b))
    return F.when(c.rlike(_AB), F.coalesce(first, other)).otherwise(F.trim(c).try_cast("timestamp"))


def bound_date(c: Column, today: str, birth: bool = False) -> Column:
    """Null outside 1900 to today (births) or 2000 to two years from today."""
    low, high = (F.lit("1900-01-01"), F.lit(today).cast("timestamp")) if birth else (F.lit("2000-01-01"), F.lit(today).cast("timestamp") + F.make_interval(F.lit(2)))
    return F.when(c.between(low.cast("timestamp"), high), c)


def money(c: Column, floor: bool = True) -> Column:
    """Number without currency signs, commas and spaces; negatives become 0 unless ``floor`` is off (pending amounts)."""
    x = F.regexp_replace(c.cast("string"), r"[₹$£€,\s]", "").try_cast("double")
    return F.when(x < 0, 0.0).otherwise(x) if floor else x


def pincode(c: Column) -> Column:
    d = F.regexp_replace(c.cast("string"), r"\D", "")
    return F.when(d.rlike(r"^\d{6}$"), d)


def multi_values(c: Column, sep: str = ",") -> Column:
    """Array of trimmed parts; empty, nan and none parts go; null if nothing is left."""
    parts = F.filter(F.transform(F.split(c, sep), F.trim), lambda x: ~F.lower(x).isin("", "nan", "none"))
    return F.when(F.size(parts) > 0, parts)


def time_dimensions(df: DataFrame, date: str) -> DataFrame:
    """Adds year, month, month_name, quarter (Qn-YYYY), iso_week, day_name and is_weekend."""
    d = F.col(date)
    return df.withColumns({"year": F.year(d), "month": F.month(d), "month_name": F.date_format(d, "MMM"), "quarter": F.concat(F.lit("Q"), F.quarter(d), F.lit("-"), F.year(d)), "iso_week": F.weekofyear(d), "day_name": F.date_format(d, "EEEE"), "is_weekend": F.weekday(d) >= 5})


def drop_undated(df: DataFrame, date: str, most: float = 0.10, status: str | None = None) -> DataFrame:
    """Rows with a date; Blocked where more than ``most`` of the rows have none. A table whose rows all have one and the same
    ``status`` is a membership list: it needs no dates and is returned whole.
    """
    n, kept, labels = df.agg(F.count(F.lit(1)), F.count(date), F.count_distinct(status) if status else F.lit(0)).first()
    if labels == 1:
        return df
    if n and (n - kept) / n > most:
        raise Blocked(f"{n - kept} of {n} rows have no {date}")
    return df.where(F.col(date).isNotNull())


def choose_key(df: DataFrame, candidates: list[list[str]], tolerance: float = 0.02) -> list[str] | None:
    """The first candidate that collapses at most ``tolerance`` of the rows. Candidates are measured in order, each by one
    count of its distinct values; those after the first key are not looked at.
    """
    for cols in candidates:
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
        r = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("k"), F.first(known).alias("w")).agg(F.sum("k").alias("n"), F.sum(F.when(F.col("w"), F.col("k") - 1)).alias("more")).first()
        if r["n"] and r["more"] is not None and r["more"] / r["n"] <= tolerance:
            return cols
    return None


def dedupe(df: DataFrame, candidates: list[list[str]], order: str) -> DataFrame:
    """First row (by ``order``) of each value of the measured key; all rows if no candidate is a key."""
    key = choose_key(df, candidates)
    if key is None:
        return df
    w = Window.partitionBy(*key).orderBy(order)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    return df.where(~known).unionByName(df.where(known).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n"))


def natural_key(df: DataFrame, roles: dict[str, str], domain: str | None = None, tolerance: float = 0.02) -> tuple[list[str], DataFrame]:
    """``(key, measured)``: the columns that name a row, [] if none do, and rows (level, columns, n_groups, collapsed).

    A receipt or certificate number is a key if it collapses at most ``tolerance`` of the rows (nulls alike); else it is widened by date, amounts and mode, then by the person. Without such
    a number the person's columns are taken as they are. Finance rows with a student id are never deduplicated. The levels make a chain: rows are grouped once, by the widest,
    and each narrower level from the groups of the next.
    """
    col = lambda names: [roles[r] for r in names if roles.get(r) in df.columns]
    none = df.sparkSession.createDataFrame([], "level int, columns string, n_groups long, collapsed double")
    if domain == "finance" and col(["student_id"]):
        return [], none
    person = col(["student_id", "name", "student_mobile", "enquiry_date", "joining_date"])
    number = (col(["receipt_id"]) or col(["certificate_number"]))[:1]
    if not number:
        return list(dict.fromkeys(person)), none
    chain = [number, list(dict.fromkeys([*number, *col(["receipt_date", "amount", "paid", "payment_mode"]), *person]))]
    finest = written(df.groupBy(*chain[-1]).agg(F.count(F.lit(1)).alias("__k")))
    sizes, level = [], finest
    for cols in reversed(chain):
        level = level.groupBy(*cols).agg(F.sum("__k").alias("__k")) if cols != chain[-1] else level
        groups, n = level.agg(F.count(F.lit(1)), F.coalesce(F.sum("__k"), F.lit(0))).first()
        sizes.insert(0, (groups, (n - groups) / n if n else 1.0))
    measured = df.sparkSession.createDataFrame([(k, ",".join(c), g, x) for k, (c, (g, x)) in enumerate(zip(chain, sizes, strict=True))], none.schema)
    return next((c for c, (_, x) in zip(chain, sizes, strict=True) if x <= tolerance), []), measured


def drop_repeats(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row (by ``order``, then by the other columns) of each value of the key, nulls alike; all rows for no key. One shuffle of partial firsts, so a frequent value is no single task."""
    if not key:
        return df
    rest = [order, *(c for c in df.columns if c not in key and c != order)] if order not in key else [c for c in df.columns if c not in key]
    (first,) = free(df, "first")
    firsts = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias(first))
    return firsts.select(*[F.col(c) if c in key else F.col(f"{first}.{c}") for c in df.columns])


def normal_id(c: Column) -> Column:
    return c.cast("string").try_cast("double").try_cast("bigint")


#: Roles of dates in the order in which they date a row's event. Births never do.
EVENT_DATES = ["admission_date", "joining_date", "receipt_date", "issue_date", "enquiry_date"]


def event_date(df: DataFrame, roles: dict[str, str], others: list[str] | tuple = ()) -> DataFrame:
    """Adds event_date, the first known date in the order of EVENT_DATES and then of ``others``, and event_date_basis, its column."""
    dates = [roles[r] for r in EVENT_DATES if roles.get(r) in df.columns]
    dates += [c for c in others if c in df.columns and c not in dates and c != roles.get("dob")]
    if not dates:
        raise Blocked("no column dates the rows' events")
    basis = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in dates])
    return df.withColumns({"event_date": F.coalesce(*[F.col(c).cast("timestamp") for c in dates]), "event_date_basis": basis})


def time_window(df: DataFrame, date: str, start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows from ``start`` to ``end``, both included (a day is included whole), and a report row (rows_before, rows_after)."""
    inside = F.col(date).isNotNull()
    if start:
        inside = inside & (F.to_date(date) >= F.lit(start).cast("date"))
    if end:
        inside = inside & (F.to_date(date) <= F.lit(end).cast("date"))
    return df.where(inside), df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(inside).alias("rows_after"))


def apply_localities(df: DataFrame, column: str) -> DataFrame:
    """Localities in a branch column become their branch; what stood there is kept in <column>_locality."""
    served = canon.branch_of_locality(F.col(column))
    return df.withColumns({f"{column}_locality": F.when(served.isNotNull(), F.col(column)), column: F.coalesce(served, canon.branch(F.col(column)))})


def apply_taxonomy(df: DataFrame, column: str, bucket: Column, basis: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The column as its bucket, with the raw text in <column>_raw, and rows (bucket, n, n_values, n_assumed): the size of each bucket,
    'empty' for blank cells and 'unlearned' for text without a bucket; assumed rows are those whose ``basis`` is not a rule.
    """
    # Rules run once for each distinct text; a table of distinct texts is small beside the rows.
    values = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n")).withColumns({"__bucket": bucket, "__basis": basis if basis is not None else F.lit("rule")})
    blank = F.coalesce(F.trim(column), F.lit("")) == ""
    label = F.when(blank & F.col("__bucket").isNull(), "empty").otherwise(F.coalesce("__bucket", F.lit("unlearned")))
    sizes = values.groupBy(label.alias("bucket")).agg(F.sum("__n").alias("n"), F.count(column).alias("n_values"), F.coalesce(F.sum(F.when(F.col("__basis") != "rule", F.col("__n"))), F.lit(0)).alias("n_assumed"))
    return df.withColumn(f"{column}_raw", F.col(column)).withColumn(column, bucket), sizes
