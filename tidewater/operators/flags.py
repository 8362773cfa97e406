"""Derived measures and flags; bands; privacy rewriting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import canon
from tidewater.functions import tables as T
from tidewater.operators.explore import exact_quantiles
from tidewater.operators.roles import detect


def amount_collected(amount: Column, pending: Column) -> Column:
    return F.greatest(amount - F.coalesce(pending, F.lit(0.0)), F.lit(0.0))


def is_default(pending: Column) -> Column:
    return F.coalesce(pending, F.lit(0.0)) > 0


def certificate_delay(issue: Column, joined: Column) -> Column:
    return F.datediff(issue, joined)


def certificate_pending(issue: Column, joined: Column) -> Column:
    return joined.isNotNull() & issue.isNull()


def touch_flags(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Adds is_enquiry, is_admitted and is_fee_paid, each only where the role behind it has a column."""
    have = {r: F.col(c) for r, c in roles.items() if c in df.columns}
    out = {}
    if "enquiry_date" in have:
        out["is_enquiry"] = have["enquiry_date"].isNotNull()
    if "admission_date" in have:
        out["is_admitted"] = have["admission_date"].isNotNull()
    if "paid" in have:
        out["is_fee_paid"] = F.coalesce(have["paid"] > 0, F.lit(False))
    return df.withColumns(out) if out else df


def lead_to_admission(df: DataFrame, enquired: str, admitted: str) -> DataFrame:
    """Adds lead_to_admission_days (calendar days) and admission_before_enquiry_flag."""
    days = F.datediff(admitted, enquired)
    return df.withColumns({"lead_to_admission_days": days, "admission_before_enquiry_flag": F.coalesce(days < 0, F.lit(False))})


def is_dropped(cancelled: Column, not_coming: Column) -> Column:
    no = F.lit(False)
    return F.coalesce(cancelled, no) | F.coalesce(not_coming, no)


def attribute_currency(status: Column) -> Column:
    """Whether a row's attributes are those of today or of the day its person left."""
    return F.when(status == "active", "current").when(status.isNotNull(), "at_exit")


def duplicate_serials(df: DataFrame, serial: str) -> DataFrame:
    """Adds is_duplicate_certificate: every copy of a non-blank serial that occurs twice or more."""
    s = F.nullif(F.trim(F.col(serial).cast("string")), F.lit(""))
    # Blank serials get keys of their own, so they do not gather in one task.
    key = F.coalesce(s, F.concat(F.lit("\0"), F.monotonically_increasing_id()))
    return df.withColumn("__s", key).withColumn("is_duplicate_certificate", (F.count(F.lit(1)).over(Window.partitionBy("__s")) > 1) & s.isNotNull()).drop("__s")


def enquiry_backlog(df: DataFrame, enquired: str, admitted: str, days: int = 30) -> DataFrame:
    """Adds is_enquiry_backlog: not admitted and older than ``days`` against the table's own last enquiry."""
    last = df.agg(F.max(enquired).alias("__last"))
    age = F.datediff("__last", F.col(enquired))
    return df.join(F.broadcast(last)).withColumn("is_enquiry_backlog", F.coalesce((age > days) & F.col(admitted).isNull(), F.lit(False))).drop("__last")


def person_id(name: Column, phone: Column, dob: Column, email: Column, salt: str = "") -> Column:
    joined = F.concat_ws("|", canon.person_name(name), canon.phone(phone), canon.date_digits(dob), canon.email(email))
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), joined), 256), 1, 16)


def person_rows(df: DataFrame, person: str, joined: str, row_id: str) -> DataFrame:
    """Adds person_enrollment_count, is_repeat_enrollment, person_admission_seq (1 is the latest) and is_current_admission."""
    w = Window.partitionBy(person)
    seq = F.row_number().over(w.orderBy(F.desc_nulls_last(joined), F.desc_nulls_last(row_id)))
    n = F.count(F.lit(1)).over(w)
    return df.withColumns({"person_enrollment_count": n, "person_admission_seq": seq}).withColumns({"is_repeat_enrollment": F.col("person_enrollment_count") > 1, "is_current_admission": F.col("person_admission_seq") == 1})


def staff_alumni(df: DataFrame, name: str, staff: list[str]) -> DataFrame:
    """Adds is_staff_alumni: the row's name is also a staff name of the same table. A left join on distinct names."""
    names = df.select(F.explode(F.array(*[canon.person_name(canon.faculty(F.col(c))) for c in staff])).alias("__staff")).where("__staff <> ''").distinct()
    return df.join(names, canon.person_name(F.col(name)) == F.col("__staff"), "left").withColumn("is_staff_alumni", F.col("__staff").isNotNull()).drop("__staff")


def quality_score(kept: float, nulls: float) -> float:
    return 100 * (0.6 * kept + 0.4 * (1 - nulls))


def band(c: Column, bands: list[tuple[float, float, str]], below: str | None = None) -> Column:
    """Label of the first band (low, high, both included) that holds the value; null stays null."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    if below is not None and bands:
        out = out.when(c < bands[0][0], below)
    for low, high, label in bands:
        out = out.when(c.between(low, high), label)
    return out


DURATION_GROUPS = [(0, 90, "Short"), (91, 180, "Medium"), (181, float("inf"), "Long")]
OUTSTANDING = [(0, 0, "Nil"), (0.01, 5000, "1-5000"), (5000.01, 15000, "5001-15000"), (15000.01, float("inf"), "15001+")]


DURATION_BUCKETS = [(0, 30, "0-30"), (31, 60, "31-60"), (61, 90, "61-90"), (91, 180, "91-180"), (181, 365, "181-365"), (366, float("inf"), "366+")]


def joining_cohort(*dates: Column) -> Column:
    """Month of the first known date."""
    return F.date_format(F.coalesce(*dates), "yyyy-MM")


def months_since(date: Column, as_of: Column) -> Column:
    return F.round(F.datediff(as_of, date) / 30.44, 1)


def is_ending_soon(days_remaining: Column, within: int = 30) -> Column:
    return days_remaining.between(0, within)


def propose(df: DataFrame, features: dict[str, tuple[Column, list[str]]], least: float = 0.4) -> DataFrame:
    """Rows (feature, coverage, offered) for derived columns (name -> expression, columns it reads): a feature is offered where
    at least that share of rows has all its sources. One aggregation.
    """
    known = {n: [F.col(c).isNotNull() for c in cols] for n, (_, cols) in features.items() if all(c in df.columns for c in cols)}
    shares = [F.avg(reduce(lambda a, b: a & b, k).cast("double")).alias(f"s{i}") for i, k in enumerate(known.values())]
    rows = [F.struct(F.lit(n).alias("feature"), F.coalesce(F.col(f"s{i}"), F.lit(0.0)).alias("coverage")) for i, n in enumerate(known)]
    rows += [F.struct(F.lit(n).alias("feature"), F.lit(0.0).alias("coverage")) for n in features if n not in known]
    got = df.agg(*shares, F.count(F.lit(1)).alias("__n")).select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return got.withColumn("offered", F.col("coverage") >= least)


def preview(df: DataFrame, features: dict[str, tuple[Column, list[str]]], top: int = 6) -> DataFrame:
    """Rows (feature, label, value) of what features would hold: min, median and max of numbers, the ``top`` values with their counts else."""
    out = None
    for name, (c, cols) in features.items():
        if not all(x in df.columns for x in cols):
            continue
        one = df.select(c.alias("v")).where("v is not null")
        if one.schema["v"].dataType.typeName() in ("string", "boolean", "date"):
            rows = one.groupBy(F.col("v").cast("string").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("value")).orderBy(F.desc("value"), "label").limit(top)
        else:
            m = exact_quantiles(one, ["v"], [0.0, 0.5, 1.0])
            rows = m.select(F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col("q")[k].alias("value")) for k, label in enumerate(("min", "median", "max"))])).alias("x")).select("x.*")
        rows = rows.select(F.lit(name).alias("feature"), "label", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def materialise(df: DataFrame, features: dict[str, tuple[Column, list[str]]], approved: list[str]) -> DataFrame:
    """The approved features as columns; an unknown name is an error."""
    return df.withColumns({n: features[n][0] for n in approved}) if approved else df


def age_band(dob: Column, as_of: Column, bands: list[tuple[float, float, str]]) -> Column:
    return band(F.floor(F.datediff(as_of, dob) / 365), bands)


def batch_slot(c: Column) -> Column:
    hour = F.regexp_extract(c, r"(\d{1,2})", 1).try_cast("int")
    hour = F.when(hour < 7, hour + 12).otherwise(hour)
    return band(hour, [(0, 11, "morning"), (12, 16, "afternoon"), (17, 24, "evening")])


def collection_band(paid: Column, billed: Column) -> Column:
    r = F.try_divide(paid, billed)
    return F.when(r <= 0, "none").when(r < 1, "partial").when(r >= 1, "full")


# Privacy ---------------------------------------------------------------------------------------------------------

#: A run of at least ten digits, with the separators that phone numbers are typed with.
PHONE = r"\+?\d(?:[\s().\-]{0,3}\d){9,14}"
EMAIL = r"[\w.\-+]+@[\w\-]+\.[\w.\-]+"


def mask(c: Column, salt: str) -> Column:
    """Salted hash, 16 hexadecimal digits; null stays null."""
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), c.cast("string")), 256), 1, 16)


def mask_columns(df: DataFrame, roles: dict[str, str], salt: str) -> DataFrame:
    """Masks the columns of personal roles (role -> column), all contact roles included."""
    return df.withColumns({c: mask(F.col(c), salt) for r, c in roles.items() if r in T.PII_ROLES and c in df.columns})


def scrub(c: Column) -> Column:
    """Phones of ten digits or more and e-mail addresses within free text become tokens."""
    return F.regexp_replace(F.regexp_replace(c, EMAIL, "[email]"), PHONE, "[mobile]")


def sanitise(df: DataFrame) -> DataFrame:
    """A sample that can be shown: columns whose header names a personal role become '[masked]', free text is scrubbed."""
    personal = {c for r, c in detect(df.columns).items() if r in T.PII_ROLES}
    text = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    cols = {c: F.when(F.col(f"`{c}`").isNotNull(), F.lit("[masked]")) for c in df.columns if c in personal}
    cols |= {c: scrub(F.col(f"`{c}`")) for c in text if c not in personal}
    return df.withColumns(cols) if cols else df


def leaks(df: DataFrame, row_id: str) -> DataFrame:
    """Rows (column, row_id, kind) for each text cell that shows a phone number or an e-mail address; one pass over all columns."""
    text = [f.name for f in df.schema if f.dataType.typeName() == "string" and f.name != row_id]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("v")) for c in text]))
    kinds = F.filter(F.array(F.when(F.col("x.v").rlike(PHONE), "phone"), F.when(F.col("x.v").rlike(EMAIL), "email")), lambda k: k.isNotNull())
    return df.select(F.col(row_id).cast("string").alias("row_id"), cells.alias("x")).select("x.column", "row_id", F.explode(kinds).alias("kind"))


def pseudonym(c: Column, pool: list[str], salt: str) -> Column:
    """A stable value from a closed pool, chosen by hash."""
    return F.when(c.isNotNull(), F.element_at(F.array(*map(F.lit, pool)), (F.pmod(F.xxhash64(F.lit(salt), c), F.lit(len(pool))) + 1).cast("int")))
