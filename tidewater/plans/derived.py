"""More registered queries: derived columns, linkage, crossing, classification, decisions and roles over the given tables.

Where the tables hold no text of the kind a rule reads, Spark derives it from them row by row; the SQL states the expected
result directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import canon
from tidewater.functions import tables as T
from tidewater.operators import classify, clean, cross, decide, explore, flags, lifecycle, link, roles, stats
from tidewater.operators import metrics as measures
from tidewater.operators.metrics import Metric, breakdown, compare_periods, drivers
from tidewater.plans.catalogue import _BREAK, _ENROL, _OC, _TWO_SIDED, _WILSON, _Z, _churn, _enrolments, _orders, _orders_customers, _rounded, _t, query


def _pick(by: str, *texts: str | None):
    """The text whose place is the remainder of a key."""
    out = F.when(F.pmod(by, F.lit(len(texts))) == 0, F.lit(texts[0]))
    for k, t in enumerate(texts[1:], 1):
        out = out.when(F.pmod(by, F.lit(len(texts))) == k, F.lit(t))
    return out


def _case(by: str, *texts: str | None) -> str:
    quote = lambda t: "NULL" if t is None else "'" + t.replace("'", "''") + "'"
    return f"CASE {by} % {len(texts)} " + " ".join(f"WHEN {k} THEN {quote(t)}" for k, t in enumerate(texts)) + " END"


# Cleaning and taxonomies -----------------------------------------------------------------------------------------

_TOUCH = """t AS (SELECT o_orderkey, o_custkey, o_orderdate AS enquired, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days((o_orderkey % 40)::INT - 5) END AS admitted,
CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 9 DAY END AS joined, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL 90 DAY END AS issued, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice - 100000 END AS paid, o_orderstatus = 'P' AS cancelled, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 11 = 0 END AS not_coming FROM orders)"""


def _touches(spark: SparkSession, d: str) -> DataFrame:
    o, k = _t(spark, d, "orders"), F.col("o_orderkey")
    later = lambda c: F.col("o_orderdate") + F.make_dt_interval(c)
    return o.select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").alias("enquired"), F.when(F.col("o_orderstatus") == "F", later((k % 40 - 5).cast("int"))).alias("admitted"), F.when(k % 3 == 0, later(F.lit(9))).alias("joined"), F.when(k % 7 == 0, later(F.lit(90))).alias("issued"),
        F.when(k % 4 > 0, F.col("o_totalprice") - 100000).alias("paid"), (F.col("o_orderstatus") == "P").alias("cancelled"), F.when(k % 5 != 0, k % 11 == 0).alias("not_coming"),
    )


_ROLES = {"enquiry_date": "enquired", "admission_date": "admitted", "joining_date": "joined", "issue_date": "issued", "paid": "paid", "receipt_date": "nowhere"}


@query(f"WITH {_TOUCH} SELECT o_orderkey, strftime(coalesce(admitted, joined, issued, enquired), '%Y-%m-%d') AS event_date, CASE WHEN admitted IS NOT NULL THEN 'admitted' WHEN joined IS NOT NULL THEN 'joined' WHEN issued IS NOT NULL THEN 'issued' ELSE 'enquired' END AS basis FROM t")
def c12_event_date(spark, d):
    out = clean.event_date(_touches(spark, d), _ROLES)
    return out.select("o_orderkey", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), F.col("event_date_basis").alias("basis"))


@query("SELECT count(*) AS rows_before, count(*) FILTER (o_orderdate::DATE BETWEEN '1996-03-01' AND '1997-02-15') AS rows_after FROM orders")
def c17_window(spark, d):
    return clean.time_window(_t(spark, d, "orders"), "o_orderdate", "1996-03-01", "1997-02-15")[1]


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate::DATE >= '1997-01-01'")
def c17_rows(spark, d):
    return clean.time_window(_t(spark, d, "orders"), "o_orderdate", "1997-01-01")[0].select("o_orderkey", "o_totalprice")


@query("SELECT 'dated' AS part, count(*) AS n FROM orders WHERE o_orderkey % 20 > 0 UNION ALL SELECT 'membership', count(*) FROM orders WHERE o_orderstatus = 'F'")
def c14_undated(spark, d):
    o = _orders(spark, d).withColumn("day", F.when(F.pmod("o_orderkey", F.lit(20)) > 0, F.col("o_orderdate")))
    dated = clean.drop_undated(o, "day", status="o_orderstatus")
    members = clean.drop_undated(o.where("o_orderstatus = 'F'").withColumn("day", F.lit(None).cast("timestamp")), "day", status="o_orderstatus")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(dated, "dated").unionByName(count(members, "membership"))


_BRANCH = ("City Light", " VESU  branch", "pal", "Adajan", "n/a", "Rander")


@query(f"SELECT c_custkey, {_case('c_custkey', 'citylight', 'vesu', 'pal', 'adajan', None, 'rander')} AS branch, c_custkey % 6 < 3 AS known FROM customer")
def t2_branches(spark, d):
    c = F.col("branch")
    return _t(spark, d, "customer").withColumn("branch", _pick("c_custkey", *_BRANCH)).select("c_custkey", canon.branch(c).alias("branch"), canon.is_known_branch(c).alias("known"))


@query(f"SELECT c_custkey, {_case('c_custkey', 'citylight', 'vesu', 'pal', 'pal', None, 'rander')} AS branch, CASE WHEN c_custkey % 6 = 3 THEN 'Adajan' END AS branch_locality FROM customer")
def t3_localities(spark, d):
    return clean.apply_localities(_t(spark, d, "customer").select("c_custkey", _pick("c_custkey", *_BRANCH).alias("branch")), "branch")


_COURSES = ("Full Stack Devlopemnet", "Adv. Excel (M-1)", "Graohic Design", "Tally with GST", "Kids Scratch", "Yoga", "  ", "SQL (2 modules)")
_FAMILIES = ("full stack development", "advanced excel", "graphic designing", "accounting", "scratch programming", "yoga", None, "sql")
_CATEGORIES = ("Programming & Development", "Office & Productivity", "Design & Creative", "Accounting & Finance", "Foundational/School", "Other", None, "Programming & Development")


@query(f"SELECT p_partkey, {_case('p_partkey', *_FAMILIES)} AS family, {_case('p_partkey', *_CATEGORIES)} AS category FROM part")
def t6_categories(spark, d):
    c, family = F.col("course"), canon.course_family(F.col("course"))
    return _t(spark, d, "part").withColumn("course", _pick("p_partkey", *_COURSES)).select("p_partkey", family.alias("family"), canon.course_category(c, family).alias("category"))


@query(f"SELECT p_partkey, {_case('p_partkey', *_FAMILIES)} AS family, {_case('p_partkey', None, 'm-1', None, None, None, None, None, '2 modules')} AS module, {_case('p_partkey', *_CATEGORIES)} AS category FROM part")
def t5_courses(spark, d):
    c = F.col("course")
    family = canon.course_family(c)
    return _t(spark, d, "part").withColumn("course", _pick("p_partkey", *_COURSES)).select("p_partkey", family.alias("family"), canon.course_module(c).alias("module"), canon.course_category(c, family).alias("category"))


@query(f"SELECT coalesce({_case('p_partkey', *_CATEGORIES)}, 'empty') AS bucket, count(*) AS n, count(DISTINCT p_partkey % 8) AS n_values, 0::BIGINT AS n_assumed FROM part GROUP BY 1")
def t9_accounting(spark, d):
    p = _t(spark, d, "part").withColumn("course", _pick("p_partkey", *_COURSES))
    return clean.apply_taxonomy(p, "course", canon.course_category(F.col("course"), canon.course_family(F.col("course"))))[1]


_LEADS = ("Walk in", "My friend Asha", "Google search", "-", "Others", "Ramesh bhai", "Hoarding near pal", "insta ad")


@query(f"SELECT event_id, {_case('event_id', 'Walk-in', 'Referral', 'Online/Google/Social', 'Walk-in', None, 'Referral', 'Walk-in', 'Online/Google/Social')} AS bucket, {_case('event_id', 'rule', 'rule', 'rule', 'blank', 'other', 'named-referrer', 'rule', 'rule')} AS basis FROM events")
def t7_sources(spark, d):
    s = canon.lead_source(_pick("event_id", *_LEADS))
    return _t(spark, d, "events").select("event_id", s["bucket"].alias("bucket"), s["basis"].alias("basis"))


@query(f"SELECT event_id, {_case('event_id', 'Housewife', 'Student', 'Other', 'Business / Job', None, 'Other', 'Business / Job')} AS occupation FROM events")
def t8_occupations(spark, d):
    return _t(spark, d, "events").select("event_id", canon.occupation(_pick("event_id", "House wife", "12 th std", "Retired", "Diamond trader", "na", "others", "Freelance designer")).alias("occupation"))


@query(f"SELECT c_custkey, {_case('c_custkey', 'asha patel', 'ravi', 'n. shah', 'sir')} AS faculty FROM customer")
def t4_staff(spark, d):
    return _t(spark, d, "customer").select("c_custkey", canon.faculty(_pick("c_custkey", "Asha  Patel Mam", "Ravi Sir.", "N. Shah,", "sir")).alias("faculty"))


@query(f"SELECT c_custkey, {_case('c_custkey', 'Asha Patel', 'Ravi', 'N Shah', 'Meera (evening)', 'Jay')} AS name, {_case('c_custkey', 'cancelled', 'refunded', 'active', 'active', 'not_coming')} AS status, c_custkey % 5 < 2 AS is_cancelled, c_custkey % 5 = 2 AS is_fast_track FROM customer")
def t11_markers(spark, d):
    m = canon.name_markers(_pick("c_custkey", "Asha Patel (cancelled)", "Ravi (refund done)", "N Shah (fast track)", "Meera (evening)", "Jay (not coming)"))
    return _t(spark, d, "customer").select("c_custkey", m["name"].alias("name"), m["enrollment_status"].alias("status"), m["is_cancelled"].alias("is_cancelled"), m["is_fast_track"].alias("is_fast_track"))


@query(f"SELECT c_custkey, {_case('c_custkey', 'asha r patel', 'ravi', '')} AS name, {_case('c_custkey', '9876543210', '', '9123456780')} AS phone, {_case('c_custkey', 'a@b.co', '', 'x.y@z.in')} AS email FROM customer")
def t12_people(spark, d):
    name, phone, mail = (_pick("c_custkey", *t) for t in (("Asha R. Patel", " ravi!", None), ("+91 98765-43210", "12345", "9123456780.0"), ("A@B .co", "no mail", "x.y@z,in")))
    return _t(spark, d, "customer").select("c_custkey", canon.person_name(name).alias("name"), canon.phone(phone).alias("phone"), canon.email(mail).alias("email"))


# Flags and features ----------------------------------------------------------------------------------------------


@query(f"WITH {_TOUCH} SELECT o_orderkey, true AS is_enquiry, admitted IS NOT NULL AS is_admitted, coalesce(paid > 0, false) AS is_fee_paid FROM t")
def d3_touch(spark, d):
    return flags.touch_flags(_touches(spark, d), _ROLES).select("o_orderkey", "is_enquiry", "is_admitted", "is_fee_paid")


@query(f"WITH {_TOUCH} SELECT o_orderkey, datediff('day', joined, issued)::INT AS delay, joined IS NOT NULL AND issued IS NULL AS pending FROM t")
def d4_certificates(spark, d):
    return _touches(spark, d).select("o_orderkey", flags.certificate_delay(F.col("issued"), F.col("joined")).alias("delay"), flags.certificate_pending(F.col("issued"), F.col("joined")).alias("pending"))


@query(f"WITH {_TOUCH} SELECT o_orderkey, datediff('day', enquired, admitted)::INT AS lead_to_admission_days, coalesce(datediff('day', enquired, admitted) < 0, false) AS admission_before_enquiry_flag FROM t")
def d7_lead_days(spark, d):
    return flags.lead_to_admission(_touches(spark, d), "enquired", "admitted").select("o_orderkey", "lead_to_admission_days", "admission_before_enquiry_flag")


@query(f"WITH {_TOUCH}, r AS (SELECT count(*) AS n, avg((coalesce(cancelled, false) OR coalesce(not_coming, false))::INT) AS p FROM t) SELECT n, round(p, 6) AS value, round({_WILSON[0]}, 6) AS ci_low, round({_WILSON[1]}, 6) AS ci_high FROM r")
def d9_dropout_rate(spark, d):
    df = _touches(spark, d).withColumn("is_dropped", flags.is_dropped(F.col("cancelled"), F.col("not_coming")))
    return _rounded(measures.headline(df, measures.resolve("dropout_rate", df.columns)))


@query(f"WITH {_ENROL} SELECT o_orderkey, CASE WHEN churn_status = 'active' THEN 'current' ELSE 'at_exit' END AS attribute_currency FROM c")
def d10_currency(spark, d):
    return _churn(spark, d).select("o_orderkey", flags.attribute_currency(F.col("churn_status")).alias("attribute_currency"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) AS is_staff_alumni FROM customer")
def d14_staff(spark, d):
    # Every second customer bears the name of the supplier of its number, if there is one.
    c = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Supplier "), "c_custkey")).otherwise("Nobody").alias("name"), F.lit(None).cast("string").alias("tutor"))
    s = _t(spark, d, "supplier").select(F.lit(None).cast("long").alias("c_custkey"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("supplier "), "s_suppkey", F.lit(" sir")).alias("tutor"))
    return flags.staff_alumni(c.unionByName(s), "name", ["tutor"]).where("c_custkey is not null").select("c_custkey", "is_staff_alumni")


@query("SELECT o_orderkey, CASE WHEN k <= 90 THEN 'Short' WHEN k <= 180 THEN 'Medium' ELSE 'Long' END AS duration_group, CASE WHEN k <= 30 THEN '0-30' WHEN k <= 60 THEN '31-60' WHEN k <= 90 THEN '61-90' WHEN k <= 180 THEN '91-180' WHEN k <= 365 THEN '181-365' ELSE '366+' END AS duration_bucket FROM (SELECT o_orderkey, o_orderkey % 500 AS k FROM orders)")
def f2_durations(spark, d):
    k = F.pmod("o_orderkey", F.lit(500))
    return _t(spark, d, "orders").select("o_orderkey", flags.band(k, flags.DURATION_GROUPS).alias("duration_group"), flags.band(k, flags.DURATION_BUCKETS).alias("duration_bucket"))


@query("SELECT o_orderkey, CASE WHEN a < 15 THEN '0-14' WHEN a < 26 THEN '15-25' ELSE '26+' END AS age_band, CASE o_orderkey % 3 WHEN 0 THEN 'morning' WHEN 1 THEN 'evening' ELSE 'afternoon' END AS slot FROM (SELECT o_orderkey, floor(datediff('day', o_orderdate - to_days((o_orderkey % 15000)::INT), o_orderdate)/365) AS a FROM orders)")
def f3_ages(spark, d):
    born = F.col("o_orderdate") - F.make_dt_interval(F.pmod("o_orderkey", F.lit(15000)).cast("int"))
    bands = [(0, 14, "0-14"), (15, 25, "15-25"), (26, float("inf"), "26+")]
    return _t(spark, d, "orders").select("o_orderkey", flags.age_band(born, F.col("o_orderdate"), bands).alias("age_band"), flags.batch_slot(_pick("o_orderkey", "9 to 11", "6 pm", "2 - 4")).alias("slot"))


@query(f"WITH {_TOUCH} SELECT strftime(coalesce(admitted, joined, enquired), '%Y-%m') AS cohort, count(*) AS n FROM t GROUP BY 1")
def f5_cohorts(spark, d):
    return _touches(spark, d).groupBy(flags.joining_cohort(F.col("admitted"), F.col("joined"), F.col("enquired")).alias("cohort")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, round(datediff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders))/30.44, 1) AS months FROM orders")
def f6_months(spark, d):
    o = _t(spark, d, "orders")
    return o.join(F.broadcast(lifecycle.as_of(o, ["o_orderdate"]))).select("o_orderkey", flags.months_since(F.col("o_orderdate"), F.col("as_of")).alias("months"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice*(1-l_discount) <= 0 THEN 'none' WHEN l_discount > 0 THEN 'partial' ELSE 'full' END AS collected FROM lineitem")
def f7_collected(spark, d):
    paid = F.when(F.col("l_discount") > 0, F.col("l_extendedprice") * (1 - F.col("l_discount"))).otherwise(F.col("l_extendedprice"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", flags.collection_band(paid, F.col("l_extendedprice")).alias("collected"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 100 - 20 BETWEEN 0 AND 30 END AS is_ending_soon FROM orders")
def f9_ending(spark, d):
    left = F.when(F.pmod("o_orderkey", F.lit(9)) > 0, F.pmod("o_orderkey", F.lit(100)) - 20)
    return _t(spark, d, "orders").select("o_orderkey", flags.is_ending_soon(left).alias("is_ending_soon"))


def _features():
    return {"cohort": (flags.joining_cohort(F.col("admitted")), ["admitted"]), "delay": (flags.certificate_delay(F.col("issued"), F.col("enquired")), ["issued", "enquired"]), "surplus": (F.col("paid") > 0, ["paid"]), "lost": (F.col("nowhere"), ["nowhere"])}


@query(f"WITH {_TOUCH}, s AS (SELECT 'cohort' AS feature, avg((admitted IS NOT NULL)::INT) AS c FROM t UNION ALL SELECT 'delay', avg((issued IS NOT NULL AND enquired IS NOT NULL)::INT) FROM t UNION ALL SELECT 'surplus', avg((paid IS NOT NULL)::INT) FROM t UNION ALL SELECT 'lost', 0.0) SELECT feature, round(c, 6) AS coverage, c >= 0.4 AS offered FROM s")
def f10_proposals(spark, d):
    return _rounded(flags.propose(_touches(spark, d), _features()))


@query(f"""WITH {_TOUCH}, c AS (SELECT strftime(admitted, '%Y-%m') AS label, count(*)::DOUBLE AS value FROM t WHERE admitted IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6), s AS (SELECT (paid > 0)::VARCHAR AS label, count(*)::DOUBLE AS value FROM t WHERE paid IS NOT NULL GROUP BY 1)
SELECT 'cohort' AS feature, label, value FROM c UNION ALL SELECT 'delay', 'min', 90.0 UNION ALL SELECT 'delay', 'median', 90.0 UNION ALL SELECT 'delay', 'max', 90.0 UNION ALL SELECT 'surplus', label, value FROM s""")
def f10_previews(spark, d):
    return flags.preview(_touches(spark, d), _features())


@query(f"WITH {_TOUCH} SELECT o_orderkey, strftime(admitted, '%Y-%m') AS cohort, paid > 0 AS surplus FROM t")
def f10_approved(spark, d):
    return flags.materialise(_touches(spark, d), _features(), ["cohort", "surplus"]).select("o_orderkey", "cohort", "surplus")


@query("""SELECT conv_id, turn, CASE WHEN role IS NOT NULL THEN '[masked]' END AS student_name, sha256(regexp_replace(regexp_replace(text, '[\\w.\\-+]+@[\\w\\-]+\\.[\\w.\\-]+', '[email]', 'g'), '\\+?\\d(?:[\\s().\\-]{0,3}\\d){9,14}', '[mobile]', 'g')) AS said FROM conversations""".replace("\\\\", "\\"))
def i4_sanitised(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("student_name"), F.col("text").alias("said"))
    return flags.sanitise(c).withColumn("said", F.sha2("said", 256))


# Lifecycle -------------------------------------------------------------------------------------------------------


@query(f"WITH {_TOUCH} SELECT o_orderkey, strftime(joined, '%Y-%m-%d') AS from_joining, strftime(admitted, '%Y-%m-%d') AS from_admission FROM t")
def l2_start(spark, d):
    day = lambda df, name: df.select("o_orderkey", F.date_format("start_date", "yyyy-MM-dd").alias(name))
    t = _touches(spark, d)
    joined = day(lifecycle.start_date(t, "joined", "admitted"), "from_joining")
    return joined.join(day(lifecycle.start_date(t.withColumn("joined", F.lit(None).cast("timestamp")), "joined", "admitted"), "from_admission"), "o_orderkey")


@query(f"WITH {_ENROL} SELECT o_orderkey, greatest(datediff('day', o_orderdate::DATE + floor(dur)::INT, t::DATE), 0)::INT AS days_past_course_end FROM r")
def l6_past_end(spark, d):
    e = lifecycle.resolve_duration(_enrolments(spark, d), "days", "o_orderpriority")
    e = e.join(F.broadcast(lifecycle.as_of(e, ["o_orderdate"])))
    return lifecycle.past_course_end(e, "o_orderdate", F.col("as_of")).select("o_orderkey", "days_past_course_end")


# Linkage ---------------------------------------------------------------------------------------------------------

_COURSE = "CASE WHEN o_orderkey % 4 = 0 THEN 'OTHER' ELSE c_mktsegment END"


@query(f"""WITH r AS (SELECT DISTINCT o_custkey AS p, {_COURSE} AS c FROM orders JOIN customer ON o_custkey = c_custkey), l AS (SELECT CASE WHEN c_custkey % 13 > 0 THEN c_custkey END AS p, c_mktsegment AS c FROM customer)
SELECT CASE WHEN p IS NULL THEN 'no_person' WHEN EXISTS (SELECT 1 FROM r WHERE r.p = l.p AND r.c = l.c) THEN 'matched' WHEN EXISTS (SELECT 1 FROM r WHERE r.p = l.p) THEN 'other_course' ELSE 'absent' END AS coverage, count(*) AS n FROM l GROUP BY 1""")
def x5_coverage(spark, d):
    left = _t(spark, d, "customer").select(F.when(F.col("c_custkey") % 13 > 0, F.col("c_custkey")).alias("p"), F.col("c_mktsegment").alias("c"))
    right = _orders_customers(spark, d).select(F.col("o_custkey").alias("p"), F.when(F.col("o_orderkey") % 4 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("c"))
    return link.coverage(left, right, "p", "c")


@query("""WITH o AS (SELECT o_custkey AS id, sum(o_totalprice) AS price FROM orders GROUP BY 1) SELECT c_custkey AS id, round(price, 2) AS orders__price, n_name AS nations__n_name FROM customer LEFT JOIN o ON c_custkey = id JOIN nation ON c_nationkey = n_nationkey""")
def x7_sources(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n_nationkey"))
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))
    out, _ = link.join_sources(c, {"orders": o, "nations": _t(spark, d, "nation").select("n_nationkey", "n_name"), "events": _t(spark, d, "events").select("event_id")}, ["id"], [["n_nationkey"]], "seq")
    return out.select("id", F.round("orders__price", 2).alias("orders__price"), "nations__n_name")


@query("""SELECT 'orders' AS source, (SELECT count(*) FROM orders SEMI JOIN customer ON o_custkey = c_custkey) > 0 AS accepted, CASE WHEN count(*) = count(DISTINCT o_custkey) THEN 'key' ELSE 'collapsed' END AS basis, NULL AS reason FROM orders
UNION ALL SELECT 'nations', count(*) = count(DISTINCT n_nationkey), CASE WHEN count(*) = count(DISTINCT n_nationkey) THEN 'identity:n_nationkey' END, CASE WHEN count(*) > count(DISTINCT n_nationkey) THEN 'no candidate identifies rows on the right' END FROM nation
UNION ALL SELECT 'events', false, NULL, 'no candidate identifies rows on the right' FROM events HAVING count(*) > 0""")
def x7_report(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n_nationkey"))
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))
    return link.join_sources(c, {"orders": o, "nations": _t(spark, d, "nation").select("n_nationkey", "n_name"), "events": _t(spark, d, "events").select("event_id")}, ["id"], [["n_nationkey"]], "seq")[1]


@query("""WITH u AS (SELECT CASE WHEN o_orderkey % 17 > 0 THEN o_custkey END AS k, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 2 END AS r FROM orders WHERE o_orderstatus IN ('F', 'P')), w AS (SELECT *, min(r) OVER (PARTITION BY k) AS b, max(r) OVER (PARTITION BY k) AS m FROM u)
SELECT count(*) AS rows_read, count(*) FILTER (k IS NULL OR r = b) AS rows_kept, count(DISTINCT k) FILTER (k IS NOT NULL AND b < m) AS contradicting_keys, count(*) FILTER (k IS NULL) AS rows_without_key, count(*) FILTER (k IS NOT NULL AND r > b) AS rows_dropped FROM w""")
def x10_union_quality(spark, d):
    o = _t(spark, d, "orders").select(F.when(F.col("o_orderkey") % 17 > 0, F.col("o_custkey")).alias("k"), "o_orderkey", "o_orderstatus")
    return link.union_quality({"sheet__Course_Completed": o.where("o_orderstatus = 'F'"), "sheet__Not_Coming": o.where("o_orderstatus = 'P'")}, ["k"])


@query("""WITH a AS (SELECT o_custkey AS id, 'admissions' AS src, 0 AS k, NULL AS segment, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'not_coming' END AS s FROM orders UNION ALL SELECT c_custkey, 'people', 1, c_mktsegment, NULL FROM customer UNION ALL SELECT user_id, 'events', 2, event_type, NULL FROM events)
SELECT id, string_agg(DISTINCT src, ',' ORDER BY src) AS found_in, coalesce(min(segment) FILTER (k = 1), min(segment) FILTER (k = 2)) AS segment, CASE min(CASE s WHEN 'completed' THEN 0 WHEN 'not_coming' THEN 2 END) WHEN 0 THEN 'completed' WHEN 2 THEN 'not_coming' ELSE 'Unknown' END AS completion_status FROM a WHERE id IS NOT NULL GROUP BY 1""")
def x14_students(spark, d):
    o = _t(spark, d, "orders").withColumn("completion_status", F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "not_coming"))
    people = _t(spark, d, "customer").withColumnRenamed("c_mktsegment", "segment")
    return link.master({"admissions": (o, "o_custkey"), "people": (people, "c_custkey"), "events": (_t(spark, d, "events").withColumnRenamed("event_type", "segment"), "user_id")}, ["segment"])


_ENQ = """e AS (SELECT o_orderkey AS enq, o_custkey AS mobile, 'Name ' || (o_orderkey % 50)::VARCHAR AS name FROM orders WHERE o_orderkey % 3 > 0), f AS (SELECT event_id, user_id AS mobile FROM events), s AS (SELECT c_custkey AS sid, CASE WHEN c_custkey % 5 > 0 THEN c_custkey END AS mobile FROM customer),
v AS (SELECT 1000000 + o_orderkey AS enq, o_custkey AS mobile, 'name ' || (o_orderkey % 70)::VARCHAR AS name FROM orders WHERE o_orderkey % 3 = 0)"""


def _repaired(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    e = o.where(k % 3 > 0).select(k.alias("enq"), F.col("o_custkey").alias("mobile"), F.concat(F.lit("Name "), (k % 50).cast("string")).alias("name"), F.lit(None).cast("long").alias("sid"))
    v = o.where(k % 3 == 0).select((k + 1000000).alias("enq"), F.col("o_custkey").alias("mobile"), F.concat(F.lit("name "), (k % 70).cast("string")).alias("name"))
    s = _t(spark, d, "customer").select(F.col("c_custkey").alias("sid"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey")).alias("mobile"))
    f = _t(spark, d, "events").select("event_id", F.col("user_id").alias("mobile"), F.lit(None).cast("long").alias("enq"))
    return link.repair_enquiries(e, f, v, s, "enq", "mobile", "sid", "name")


@query(f"WITH {_ENQ}, b AS (SELECT *, 'enquiries' AS source_sheet FROM e UNION ALL SELECT *, 'converted' FROM v) SELECT enq, s.sid, source_sheet, source_sheet = 'converted' AND EXISTS (SELECT 1 FROM e WHERE lower(e.name) = lower(b.name)) AS possible_duplicate FROM b LEFT JOIN s USING (mobile)")
def x15_enquiries(spark, d):
    return _repaired(spark, d)[0].select("enq", "sid", "source_sheet", "possible_duplicate")


@query(f"WITH {_ENQ} SELECT event_id, m.enq FROM f LEFT JOIN (SELECT mobile, min(enq) AS enq FROM e GROUP BY 1) m USING (mobile)")
def x15_followups(spark, d):
    return _repaired(spark, d)[1].select("event_id", "enq")


# Statistics and crossing -----------------------------------------------------------------------------------------


@query(f"""WITH g AS (SELECT strftime(o_orderdate, '%Y-%m') AS cohort, avg((o_orderstatus = 'F')::INT) AS y FROM orders GROUP BY 1), s AS (SELECT row_number() OVER (ORDER BY cohort) - 1 AS i, y FROM g), p AS (SELECT sum(sign(b.y - a.y))::DOUBLE AS s FROM s a JOIN s b ON a.i < b.i),
t AS (SELECT sum(c*(c-1)*(2*c+5)) AS t FROM (SELECT count(*) AS c FROM s GROUP BY y)), n AS (SELECT count(*) AS n FROM s), v AS (SELECT n, s, (n*(n-1)*(2*n+5) - t)/18 AS var_s FROM p, t, n),
z AS (SELECT *, CASE WHEN s > 0 THEN (s-1)/sqrt(var_s) WHEN s < 0 THEN (s+1)/sqrt(var_s) ELSE 0.0 END AS z FROM v), q AS (SELECT *, {_TWO_SIDED} AS p FROM z)
SELECT n, s, round(z, 6) AS z, round(p, 6) AS p, CASE WHEN n < 4 THEN 'insufficient' WHEN p <= 0.05 AND s > 0 THEN 'rising' WHEN p <= 0.05 AND s < 0 THEN 'falling' ELSE 'flat' END AS trend FROM q""")
def m12_trend(spark, d):
    out = stats.cohort_trend(_orders(spark, d).withColumn("cohort", F.date_format("o_orderdate", "yyyy-MM")), "cohort", "done")
    return _rounded(out.select("n", "s", "z", "p", "trend"))


@query(f"WITH {_ENROL} SELECT churn_status, count(*) AS n, count(*) FILTER (churn_status = 'churned') AS events FROM c GROUP BY 1")
def m14_events(spark, d):
    e = stats.survival_input(_churn(spark, d), "tenure_days", status="churn_status")
    return e.groupBy("churn_status").agg(F.count(F.lit(1)).alias("n"), F.count_if("event").alias("events"))


_GRID = f"""oc AS {_OC}, c AS (SELECT c_mktsegment || '|' || o_orderpriority AS a, done AS b, count(*) AS o FROM oc GROUP BY ALL), m AS (SELECT *, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS k, sum(o) OVER () AS n FROM c)"""


@query(f"WITH {_GRID} SELECT round(sum(o*o*n/(r*k)) - max(n), 4) AS chi2, ((count(DISTINCT a)-1)*(count(DISTINCT b)-1))::BIGINT AS dof, max(n)::BIGINT AS n, round(sqrt((sum(o*o*n/(r*k)) - max(n))/(max(n)*least(count(DISTINCT a)-1, count(DISTINCT b)-1))), 6) AS cramers_v FROM m")
def k5_grid(spark, d):
    out = cross.grid_independence(_orders_customers(spark, d), Metric("rate", "done"), "c_mktsegment", "o_orderpriority")
    return out.select(F.round("chi2", 4).alias("chi2"), "dof", "n", F.round("cramers_v", 6).alias("cramers_v"))


_CROSS_ROLES = {"branch": "c_mktsegment", "course": "o_orderpriority", "faculty": "o_orderstatus", "source": "one", "payment_mode": "c_mktsegment"}


_PAIRS = ", ".join(f"({k}, '{_CROSS_ROLES[a]}', '{_CROSS_ROLES[b]}')" for k, (a, b) in enumerate(T.CROSS_PAIRS) if a in _CROSS_ROLES and b in _CROSS_ROLES)


@query(f"""WITH oc AS {_OC}, v AS (SELECT 'c_mktsegment' AS c, count(DISTINCT c_mktsegment) AS n FROM oc UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM oc UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM oc UNION ALL SELECT 'one', count(DISTINCT o_orderkey >= 0) FROM oc)
SELECT row_number() OVER (ORDER BY k) - 1 AS place, rows, cols FROM (VALUES {_PAIRS}) t(k, rows, cols) JOIN v a ON a.c = rows JOIN v b ON b.c = cols WHERE rows <> cols AND a.n > 1 AND b.n > 1""")
def k6_pairs(spark, d):
    pairs = cross.suggest_pairs(_orders_customers(spark, d).withColumn("one", (F.col("o_orderkey") >= 0).cast("string")), _CROSS_ROLES)
    return spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "place int, rows string, cols string")


#: A flag that one cell of two dimensions raises by itself.
_PLANTED = f"oc AS (SELECT *, (hash_ % 10 = 0) OR (c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT' AND hash_ % 10 < 2) AS hit FROM (SELECT *, o_orderkey * 7 % 1000 AS hash_ FROM {_OC}))"

#: P(|Z| > |z|) at any z: the series up to 4; beyond, where it needs ever more terms, the continued fraction of the tail.
_TAIL = f"CASE WHEN abs(z) > 4 THEN 2 * exp(-z*z/2) / sqrt(2*pi()) / list_reduce(list_concat([abs(z)], list_transform(range(0, 100), lambda k: (100-k)::DOUBLE)), lambda f, k: abs(z) + k/f) ELSE {_TWO_SIDED} END"


def _planted(spark: SparkSession, d: str) -> DataFrame:
    h = F.pmod(F.col("o_orderkey") * 7, F.lit(1000)) % 10
    return _orders_customers(spark, d).withColumn("hit", (h == 0) | ((F.col("c_mktsegment") == "BUILDING") & (F.col("o_orderpriority") == "1-URGENT") & (h < 2)))


@query(f"""WITH {_PLANTED}, c AS (SELECT c_mktsegment AS r, o_orderpriority AS k, count(*) AS n, avg(hit::INT) AS v FROM oc GROUP BY ALL)
SELECT 'c_mktsegment' AS rows, 'o_orderpriority' AS cols, r AS "row", k AS col, n, round(v, 6) AS value, round(v - ((SELECT avg(hit::INT) FROM oc WHERE c_mktsegment = r) + (SELECT avg(hit::INT) FROM oc WHERE o_orderpriority = k) - (SELECT avg(hit::INT) FROM oc)), 6) AS residual FROM c WHERE r = 'BUILDING' AND k = '1-URGENT'""")
def k7_auto(spark, d):
    out = cross.auto_cross(_planted(spark, d), Metric("rate", "hit"), {"branch": "c_mktsegment", "course": "o_orderpriority"})
    return _rounded(out.where("residual > 0").drop("expected"))


@query(f"""WITH {_PLANTED}, g AS (SELECT c_mktsegment AS r, o_orderpriority AS k, count(*) AS n, sum(hit::INT) AS x FROM oc GROUP BY ALL), a AS (SELECT *, sum(n) OVER (PARTITION BY r) AS rn, sum(x) OVER (PARTITION BY r) AS rx, sum(n) OVER (PARTITION BY k) AS kn, sum(x) OVER (PARTITION BY k) AS kx FROM g),
z AS (SELECT r, k, n, x, (x/n - (rx-x)/(rn-n)) / sqrt(rx/rn*(1-rx/rn)*(1/n + 1/(rn-n))) AS row_z, (x/n - (kx-x)/(kn-n)) / sqrt(kx/kn*(1-kx/kn)*(1/n + 1/(kn-n))) AS col_z FROM a),
p AS (SELECT *, (SELECT {_TAIL} FROM (SELECT row_z AS z)) AS rp, (SELECT {_TAIL} FROM (SELECT col_z AS z)) AS cp FROM z), m AS (SELECT *, row_number() OVER (ORDER BY rp, r, k) AS ri, row_number() OVER (ORDER BY cp, r, k) AS ci, count(*) OVER () AS m FROM p),
q AS (SELECT *, least(1.0, min(rp*m/ri) OVER (ORDER BY ri DESC ROWS UNBOUNDED PRECEDING)) AS row_q, least(1.0, min(cp*m/ci) OVER (ORDER BY ci DESC ROWS UNBOUNDED PRECEDING)) AS col_q FROM m)
SELECT r AS "row", k AS col, n, round(row_z, 6) AS row_z, round(col_z, 6) AS col_z, row_q <= 0.05 AND col_q <= 0.05 AS interaction FROM q""")
def k4_interactions(spark, d):
    out = cross.crosstab(_planted(spark, d), Metric("rate", "hit"), "c_mktsegment", "o_orderpriority", min_cell=1).where("level = 'cell'")
    return _rounded(out.select("row", "col", "n", "row_z", "col_z", "interaction"))


def _notes_sql(flag: str, tag: str) -> str:
    """The notes on a rate over the grid: chi-square of cells against the flag (its tail in closed form, as 24 degrees of freedom are even), and the interactions."""
    return f"""(WITH {_PLANTED}, f AS (SELECT c_mktsegment AS r, o_orderpriority AS k, {flag} AS y FROM oc), g AS (SELECT r, k, count(*) AS n, sum(y::INT) AS x FROM f GROUP BY ALL),
t AS (SELECT sum(n) AS tn, sum(x) AS tx, count(*) AS cells FROM g), c AS (SELECT sum(power(x - n*tx/tn, 2)/(n*tx/tn) + power(x - n*tx/tn, 2)/(n*(tn-tx)/tn)) AS chi2, min(least(n*tx/tn, n*(tn-tx)/tn)) AS low, max(cells)::INT - 1 AS dof FROM g, t),
pv AS (SELECT low, exp(-chi2/2) * list_sum(list_transform(range(0, dof // 2), lambda i: exp(i*ln(chi2/2) - lgamma(i+1)))) AS p FROM c),
a AS (SELECT *, sum(n) OVER (PARTITION BY r) AS rn, sum(x) OVER (PARTITION BY r) AS rx, sum(n) OVER (PARTITION BY k) AS kn, sum(x) OVER (PARTITION BY k) AS kx FROM g),
z AS (SELECT r, k, n, (x/n - (rx-x)/(rn-n)) / sqrt(rx/rn*(1-rx/rn)*(1/n + 1/(rn-n))) AS row_z, (x/n - (kx-x)/(kn-n)) / sqrt(kx/kn*(1-kx/kn)*(1/n + 1/(kn-n))) AS col_z FROM a),
q0 AS (SELECT *, (SELECT {_TAIL} FROM (SELECT row_z AS z)) AS rp, (SELECT {_TAIL} FROM (SELECT col_z AS z)) AS cp FROM z), m AS (SELECT *, row_number() OVER (ORDER BY rp, r, k) AS ri, row_number() OVER (ORDER BY cp, r, k) AS ci, count(*) OVER () AS m FROM q0),
q AS (SELECT *, least(1.0, min(rp*m/ri) OVER (ORDER BY ri DESC ROWS UNBOUNDED PRECEDING)) AS row_q, least(1.0, min(cp*m/ci) OVER (ORDER BY ci DESC ROWS UNBOUNDED PRECEDING)) AS col_q FROM m)
SELECT '{tag}' AS flag, 'independence' AS topic, CASE WHEN low < 5 THEN 'The grid is too thin for a test.' WHEN p > 0.05 THEN 'The rate looks independent of the combination.' ELSE 'The rate depends on the combination: some cell differs from what its margins predict.' END AS note FROM pv
UNION ALL SELECT '{tag}', 'interactions', 'No cell beats both of its margins after correction.' FROM q HAVING count(*) FILTER (row_q <= 0.05 AND col_q <= 0.05) = 0)"""


@query(f"SELECT * FROM {_notes_sql('hit', 'planted')} UNION ALL SELECT * FROM {_notes_sql('hash_ % 10 = 3', 'even')}")
def k8_notes(spark, d):
    o, out = _planted(spark, d).withColumn("even", F.pmod(F.col("o_orderkey") * 7, F.lit(1000)) % 10 == 3), None
    for flag, tag in (("hit", "planted"), ("even", "even")):
        m = Metric("rate", flag)
        notes = cross.cross_notes(cross.crosstab(o, m, "c_mktsegment", "o_orderpriority", min_cell=1), cross.grid_independence(o, m, "c_mktsegment", "o_orderpriority"), "rate").select(F.lit(tag).alias("flag"), "topic", "note")
        out = notes if out is None else out.unionByName(notes)
    return out


@query("""WITH x AS (SELECT toxic, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::UINTEGER % 5 = 0 AS h FROM labels) SELECT 'train' AS part, count(*) AS n FROM x WHERE NOT h UNION ALL SELECT 'holdout', count(*) FROM x WHERE h UNION ALL SELECT 'train, one class', count(*) FROM x WHERE toxic = 1 UNION ALL SELECT 'holdout, one class', count(*) FROM x WHERE toxic = 1""")
def n4_split(spark, d):
    x = _t(spark, d, "labels")
    out = None
    for tag, df in (("", x), (", one class", x.where("toxic = 1"))):
        for part, rows in zip(("train", "holdout"), classify.split(df, "doc_id", "toxic"), strict=True):
            one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part + tag).alias("part"), "n")
            out = one if out is None else out.unionByName(one)
    return out


@query("""WITH t AS (SELECT 'always' AS model, quality AS y, 1 AS p FROM labels UNION ALL SELECT 'toxic', toxic, quality FROM labels UNION ALL SELECT 'few', toxic, toxic FROM labels WHERE doc_id < 300),
g AS (SELECT model, count(y) AS n, least(count(*) FILTER (y = 1), count(*) FILTER (y <> 1)) AS m, avg((p = y)::INT) - greatest(avg(y), 1 - avg(y)) AS lift FROM t GROUP BY 1)
SELECT model, 'small_training_set' AS caveat FROM g WHERE n < 80 UNION ALL SELECT model, 'no_gain_over_majority' FROM g WHERE lift <= 1e-9 UNION ALL SELECT model, 'thin_class' FROM g WHERE m < 20""")
def n8_caveats(spark, d):
    x, out = _t(spark, d, "labels"), None
    for name, df, label, predicted in (("always", x, "quality", F.lit(1)), ("toxic", x, "toxic", F.col("quality")), ("few", x.where("doc_id < 300"), "toxic", F.col("toxic"))):
        rows = classify.caveats(classify.evaluate(df.withColumn("predicted", predicted), label), df, label).select(F.lit(name).alias("model"), "caveat")
        out = rows if out is None else out.unionByName(rows)
    return out


# Decisions -------------------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS v FROM part GROUP BY 1), b AS (SELECT avg(p_retailprice) AS b FROM part), r AS (SELECT p_brand, n, v/b AS r FROM g, b)
SELECT p_brand, CASE WHEN abs(r-1) >= 0.5 THEN 'critical' WHEN abs(r-1) >= 0.3 THEN 'high' WHEN abs(r-1) >= 0.15 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN n >= 100 THEN 'high' WHEN n >= 30 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN r >= 1.5 THEN 'high' WHEN r >= 1.3 THEN 'medium' ELSE 'low' END AS gain FROM r""")
def o2_bands(spark, d):
    b = breakdown(_t(spark, d, "part"), Metric("mean", "p_retailprice"), ["p_brand"], top=100)
    r = F.col("value") / F.col("baseline")
    return b.select(F.col("segment").alias("p_brand"), decide.severity(F.abs(r - 1)).alias("severity"), decide.confidence(F.col("n")).alias("confidence"), decide.potential(r).alias("gain"))


@query(f"{_BREAK}, r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY p DESC, segment) AS k FROM g) SELECT dimension, segment, n, round(p, 6) AS value, CASE WHEN n >= 100 THEN 'high' WHEN n >= 30 THEN 'medium' ELSE 'low' END AS confidence FROM r WHERE k = 1")
def o3_segments(spark, d):
    return _rounded(decide.segment_insights(breakdown(_orders_customers(spark, d), Metric("rate", "done"), ["o_orderpriority", "c_mktsegment"])))


_PERIODS = """t AS (SELECT max(o_orderdate) AS t FROM orders), p AS (SELECT count(*) FILTER (o_orderdate > t - INTERVAL 12 MONTH)::DOUBLE AS c, count(*) FILTER (o_orderdate <= t - INTERVAL 12 MONTH AND o_orderdate > t - INTERVAL 24 MONTH)::DOUBLE AS p FROM orders, t),
k AS (SELECT c, p, c - p AS delta, (c - p)/p AS pct, abs((c - p)/sqrt(c + p)) >= 1.96 AS sig FROM p)"""


@query(f"WITH {_PERIODS} SELECT CASE WHEN pct > 0.02 THEN 'growing' WHEN pct < -0.02 THEN 'declining' ELSE 'stable' END AS trend, CASE WHEN sig THEN 'significant' ELSE 'weak' END AS strength, round(pct, 6) AS delta_pct FROM k")
def o3_trends(spark, d):
    return _rounded(decide.trend_insights(compare_periods(_orders(spark, d), Metric("count"), "o_orderdate", 12)))


@query(f"""{_BREAK}, c AS (SELECT dimension, segment, (p - baseline) * n / sum(n) OVER (PARTITION BY dimension) AS c FROM g, b) SELECT dimension || '=' || segment AS cause, 'driver' AS kind, round(c, 6) AS impact FROM c ORDER BY abs(c) DESC, dimension, segment LIMIT 2""")
def o3_causes(spark, d):
    oc = _orders_customers(spark, d)
    return _rounded(decide.root_causes(drivers(oc, Metric("rate", "done"), ["o_orderpriority", "c_mktsegment"]), explore.associations(oc, ["o_orderpriority", "c_mktsegment"])))


@query(f"""WITH {_PERIODS}, g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS v FROM part GROUP BY 1), b AS (SELECT avg(p_retailprice) AS b FROM part), f AS (SELECT v/b AS r FROM g, b WHERE n >= 30 AND abs(v/b - 1) >= 0.1),
s AS (SELECT 70 + coalesce((SELECT sum(CASE WHEN pct < 0 THEN -20 ELSE 15 END) FROM k WHERE sig), 0) - 10 * (SELECT count(*) FROM f WHERE r <= 0.7) + 5 * (SELECT count(*) FROM f WHERE r >= 1.5) AS score)
SELECT score::BIGINT AS score, CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'stable' WHEN score >= 30 THEN 'concerning' ELSE 'critical' END AS state FROM s""")
def o4_health(spark, d):
    found = decide.findings(breakdown(_t(spark, d, "part"), Metric("mean", "p_retailprice"), ["p_brand"], top=100), "mean")
    return decide.business_health(compare_periods(_orders(spark, d), Metric("count"), "o_orderdate", 12), found)


_TIES = """SELECT c_mktsegment AS a, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE o_orderpriority END AS b FROM oc"""


@query(f"""WITH {_PERIODS}, oc AS {_OC}, l AS (SELECT 'loose' AS pair, c_mktsegment AS a, o_orderpriority AS b FROM oc UNION ALL SELECT 'tied', * FROM ({_TIES})), c AS (SELECT pair, a, b, count(*) AS o FROM l GROUP BY ALL),
m AS (SELECT *, sum(o) OVER (PARTITION BY pair, a) AS r, sum(o) OVER (PARTITION BY pair, b) AS k, sum(o) OVER (PARTITION BY pair) AS n FROM c), v AS (SELECT pair, sqrt((sum(o*o*n/(r*k)) - max(n))/(max(n)*(least(count(DISTINCT a), count(DISTINCT b)) - 1))) AS v FROM m GROUP BY 1),
q AS (SELECT 100 * (0.6 * avg((o_orderstatus <> 'P')::INT) + 0.4 * (1 - avg((o_orderkey % 7 = 0)::INT))) AS q FROM orders)
SELECT pair, round(100*(0.4*q/100 + 0.4*CASE WHEN sig THEN 0.9 ELSE 0.4 END + 0.2*CASE WHEN v >= 0.1 THEN 0.9 ELSE 0.4 END))::INT AS confidence FROM k, v, q""")
def o4_confidence(spark, d):
    oc = _orders_customers(spark, d).withColumn("tie", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("o_orderpriority")))
    kept, gaps = _t(spark, d, "orders").agg(F.avg((F.col("o_orderstatus") != "P").cast("double")), F.avg((F.col("o_orderkey") % 7 == 0).cast("double"))).first()
    moved, out = compare_periods(_orders(spark, d), Metric("count"), "o_orderdate", 12), None
    for name, dims in (("loose", ["c_mktsegment", "o_orderpriority"]), ("tied", ["c_mktsegment", "tie"])):
        one = decide.confidence_score(moved, explore.associations(oc, dims), flags.quality_score(kept, gaps)).select(F.lit(name).alias("pair"), "confidence")
        out = one if out is None else out.unionByName(one)
    return out


#: Orders of which a third of the last year's is missing, and of which a third of the year before's is.
_FALLING = """t AS (SELECT max(o_orderdate) AS t FROM orders), o AS (SELECT 'orders' AS metric, o_orderdate AS d FROM orders, t WHERE o_orderdate <= t - INTERVAL 12 MONTH OR o_orderkey % 3 > 0 OR o_orderdate = t UNION ALL SELECT 'load', o_orderdate FROM orders, t WHERE o_orderdate > t - INTERVAL 12 MONTH OR o_orderkey % 3 > 0 UNION ALL SELECT 'even', o_orderdate FROM orders),
p AS (SELECT metric, count(*) FILTER (d > t - INTERVAL 12 MONTH)::DOUBLE AS c, count(*) FILTER (d <= t - INTERVAL 12 MONTH AND d > t - INTERVAL 24 MONTH)::DOUBLE AS p FROM o, t GROUP BY 1), k AS (SELECT *, c - p AS delta, (c - p)/p AS pct, abs((c - p)/sqrt(c + p)) >= 1.96 AS sig FROM p)"""


@query(f"WITH {_FALLING} SELECT metric, 'trend_alert' AS type, 'warning' AS severity, CASE WHEN delta < 0 THEN 'declining' ELSE 'rising' END AS trend, c AS observed, p AS threshold, round(pct, 6) AS delta_pct FROM k WHERE sig AND CASE WHEN metric = 'load' THEN delta > 0 ELSE delta < 0 END")
def o12_trend_alerts(spark, d):
    o = _orders(spark, d).join(F.broadcast(_orders(spark, d).agg(F.max("o_orderdate").alias("t"))))
    recent, kept = F.col("o_orderdate") > F.col("t") - F.make_interval(F.lit(0), F.lit(12)), F.col("o_orderkey") % 3 > 0
    sides = {"orders": o.where(~recent | kept | (F.col("o_orderdate") == F.col("t"))), "load": o.where(recent | kept), "even": o}
    out = None
    for name, df in sides.items():
        one = decide.trend_alerts(compare_periods(df.drop("t"), Metric("count"), "o_orderdate", 12), name, lower_is_better=name == "load")
        out = one if out is None else out.unionByName(one)
    return _rounded(out)


@query("SELECT count(*) FILTER (n_nationkey % 4 > 0) AS answered, count(*) FILTER (n_nationkey % 4 = 0) AS skipped, string_agg(n_name, ',' ORDER BY n_name) FILTER (n_nationkey % 4 > 0) AS metrics FROM nation")
def o13_summary(spark, d):
    a = _t(spark, d, "nation").select(F.col("n_name").alias("metric"), F.when(F.col("n_nationkey") % 4 == 0, "no rows").alias("blocked"), F.col("n_nationkey").alias("priority"))
    return decide.report_summary(a, a)[0]


@query(f"""WITH {_TOUCH} SELECT 'rows' AS kind, 'read' AS item, count(*) AS n FROM t UNION ALL SELECT 'dropped', 'undated', count(*) FILTER (admitted IS NULL) FROM t UNION ALL SELECT 'dropped', 'repeated o_custkey', count(o_custkey) - count(DISTINCT o_custkey) FROM t
UNION ALL SELECT 'blank', 'paid', count(*) FILTER (paid IS NULL) FROM t UNION ALL SELECT 'blank', 'issued', count(*) FILTER (issued IS NULL) FROM t""")
def o14_quality(spark, d):
    return decide.quality_report(_touches(spark, d), "admitted", ["o_custkey"], ["paid", "issued"])


# Roles -----------------------------------------------------------------------------------------------------------


_HOWS = """h AS (SELECT 'orders' AS sheet, CASE WHEN o_orderstatus = 'F' THEN 'Online' WHEN o_orderstatus = 'O' THEN 'offline ' ELSE 'Hybrid' END AS v FROM orders UNION ALL SELECT 'events', event_type FROM events UNION ALL SELECT 'lines', CASE WHEN l_returnflag = 'R' THEN 'online' ELSE l_returnflag END FROM lineitem),
m AS (SELECT sheet, bool_and(lower(trim(v)) IN ('online', 'offline', 'hybrid', 'both')) AS attends FROM h GROUP BY 1)"""


@query(f"""WITH {_HOWS} SELECT sheet, CASE WHEN attends THEN 'learning_mode' ELSE 'enquiry_mode' END AS role, 'how' AS "column" FROM m WHERE attends OR sheet = 'events' UNION ALL SELECT sheet, 'mode', 'how' FROM m UNION ALL SELECT 'orders', unnest(['status', 'fee_status']), 'o_orderstatus' UNION ALL SELECT 'orders', 'amount', 'o_totalprice'
UNION ALL SELECT 'events', unnest(['enquiry_date', 'record_timestamp']), 'Timestamp' UNION ALL SELECT 'lines', 'admission_date', 'came' UNION ALL SELECT 'lines', 'record_timestamp', 'Timestamp' UNION ALL SELECT 'lines', unnest(['status', 'churn_status']), 'l_linestatus' UNION ALL SELECT 'lines', 'status_reason', 'why'""")
def p3_context(spark, d):
    s = F.col("o_orderstatus")
    sheets = {
        "orders": (_t(spark, d, "orders").withColumn("how", F.when(s == "F", "Online").when(s == "O", "offline ").otherwise("Hybrid")), {"mode": "how", "status": "o_orderstatus", "amount": "o_totalprice"}),
        "events": (_t(spark, d, "events").select(F.col("event_type").alias("how"), F.col("ts").alias("Timestamp")), {"mode": "how", "enquiry_date": "Timestamp"}),
        "lines": (_t(spark, d, "lineitem").withColumn("how", F.when(F.col("l_returnflag") == "R", "online").otherwise(F.col("l_returnflag"))), {"mode": "how", "admission_date": "came", "enquiry_date": "Timestamp", "status": "l_linestatus", "status_reason": "why"}),
    }
    rows = [(n, r, c) for n, (df, found) in sheets.items() for r, c in roles.specialise(df, found).items()]
    return spark.createDataFrame(rows, "sheet string, role string, column string")


@query("""SELECT 'o_orderkey' AS "column", 'id' AS kind, count(DISTINCT o_orderkey) AS n_distinct FROM orders UNION ALL SELECT 'o_custkey', CASE WHEN count(DISTINCT o_custkey) >= greatest(20, 0.95*count(*)) THEN 'id' ELSE 'amount' END, count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'o_orderstatus', 'categorical', count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'o_totalprice', 'amount', count(DISTINCT o_totalprice) FROM orders UNION ALL SELECT 'o_orderdate', 'date', count(DISTINCT o_orderdate) FROM orders UNION ALL SELECT 'o_orderpriority', 'categorical', count(DISTINCT o_orderpriority) FROM orders""")
def p4_schema(spark, d):
    return roles.infer_schema(_t(spark, d, "orders"))


@query("""SELECT 'nation' AS source, 'rows' AS item, 'rows' AS kind, count(*)::DOUBLE AS value FROM nation UNION ALL SELECT 'nation', unnest(['n_nationkey', 'n_name', 'n_regionkey']), 'null_rate', 0.0 UNION ALL SELECT 'nation', 'n_regionkey', 'repeated_keys', (count(n_regionkey) - count(DISTINCT n_regionkey))::DOUBLE FROM nation
UNION ALL SELECT 'sold', 'rows', 'rows', count(*)::DOUBLE FROM orders UNION ALL SELECT 'sold', 'o_orderkey', 'null_rate', 0.0 UNION ALL SELECT 'sold', 'price', 'null_rate', round(avg((o_orderstatus <> 'F')::INT), 6) FROM orders UNION ALL SELECT 'sold', 'o_orderkey', 'repeated_keys', (count(o_orderkey) - count(DISTINCT o_orderkey))::DOUBLE FROM orders""")
def p5_validation(spark, d):
    sold = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("price"))
    return _rounded(roles.validate({"nation": _t(spark, d, "nation"), "sold": sold}, ["n_regionkey", "o_orderkey"]))


@query("""WITH g AS (SELECT n_name, count(*) AS n, sum(s_acctbal) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, n_name) AS k FROM g) SELECT 'n_name' AS dimension, n_name AS segment, n, round(v, 2) AS value FROM r WHERE k <= 25""")
def p15_generic(spark, d):
    s = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", "s_acctbal", "n_name")
    measure, dims = roles.generic_question(s)
    return _rounded(breakdown(s, Metric("sum", measure), dims).select("dimension", "segment", "n", "value"), 2)
