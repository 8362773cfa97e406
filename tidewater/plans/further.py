"""Registered queries of ranks, identity, capability, privacy and keys, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import tables as T
from tidewater.operators import capability, clean, cross, decide, explore, flags, identity, lifecycle, privacy, roles, stats
from tidewater.operators.metrics import Metric, breakdown, caveats, compare_periods, drivers, headline
from tidewater.operators.roles import detect
from tidewater.plans.catalogue import _TWO_SIDED, _WILSON, _orders, _orders_customers, _rounded, _t, query


# Ranks -----------------------------------------------------------------------------------------------------------


@query(f"""WITH g AS (SELECT l_partkey::VARCHAR AS segment, count(*) AS n, sum((l_returnflag = 'R')::INT)::BIGINT AS x FROM lineitem GROUP BY 1), a AS (SELECT *, x/n AS p, sum(n) OVER () AS an, sum(x) OVER () AS ax FROM g),
t AS (SELECT *, n >= 10 AND an - n >= 10 AS tested FROM a), z AS (SELECT *, CASE WHEN tested THEN x/n - (ax-x)/(an-n) END AS diff, CASE WHEN tested THEN (x/n - (ax-x)/(an-n)) / sqrt(ax/an*(1-ax/an)*(1/n + 1/(an-n))) END AS z FROM t),
q AS (SELECT *, {_TWO_SIDED} AS pv FROM z), r AS (SELECT *, row_number() OVER (PARTITION BY pv IS NULL ORDER BY pv) AS k, count(pv) OVER () AS m FROM q),
b AS (SELECT *, CASE WHEN pv IS NOT NULL THEN least(1.0, min(pv*m/k) OVER (PARTITION BY pv IS NULL ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM r)
SELECT segment, n, x, round(p, 6) AS rate, round({_WILSON[0]}, 6) AS ci_low, round({_WILSON[1]}, 6) AS ci_high, round(ax/an, 6) AS overall, round(diff, 6) AS diff, round(z, 6) AS z, tested, round(pv, 6) AS p, round(q, 6) AS q, coalesce(q <= 0.05, false) AS significant FROM b""")
def m6_partkeys(spark, d):
    lines = _t(spark, d, "lineitem").select("l_partkey", (F.col("l_returnflag") == "R").alias("back"))
    return _rounded(stats.segments_vs_rest(lines, "l_partkey", "back", min_side=10))


@query(f"""WITH s AS (SELECT o_orderkey AS i, o_totalprice AS y FROM orders), p AS (SELECT sum(sign(b.y - a.y))::DOUBLE AS s FROM s a JOIN s b ON a.i < b.i),
t AS (SELECT sum(c*(c-1)*(2*c+5)) AS t FROM (SELECT count(*) AS c FROM s GROUP BY y)), n AS (SELECT count(*) AS n FROM s), v AS (SELECT n, s, (n*(n-1)*(2*n+5)::DOUBLE - t)/18 AS var_s FROM p, t, n),
z AS (SELECT *, CASE WHEN s > 0 THEN (s-1)/sqrt(var_s) WHEN s < 0 THEN (s+1)/sqrt(var_s) ELSE 0.0 END AS z FROM v), q AS (SELECT *, {_TWO_SIDED} AS p FROM z)
SELECT n, s, round(sqrt(var_s), 2) AS sd, round(z, 6) AS z, round(p, 6) AS p, CASE WHEN n < 4 THEN 'insufficient' WHEN p <= 0.05 AND s > 0 THEN 'rising' WHEN p <= 0.05 AND s < 0 THEN 'falling' ELSE 'flat' END AS trend FROM q""")
def m10_orders(spark, d):
    out = stats.mann_kendall(_orders(spark, d), "o_orderkey", "o_totalprice")
    return _rounded(out.select("n", "s", F.round(F.sqrt("var_s"), 2).alias("sd"), "z", "p", "trend"))


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_acctbal AS y FROM customer), m AS (SELECT quantile_cont((b.y - a.y)/(b.i - a.i), 0.5) AS slope FROM s a JOIN s b ON a.i < b.i)
SELECT round(slope, 6) AS slope, round(quantile_cont(y - slope*i, 0.5), 4) AS intercept FROM s, m GROUP BY slope""")
def m11_customers(spark, d):
    out = stats.theil_sen(_t(spark, d, "customer"), "c_custkey", "c_acctbal")
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


# Identity and lifecycle ------------------------------------------------------------------------------------------

_PEOPLE = """p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 > 0 THEN c_name END AS name, CASE WHEN o_orderkey % 10 > 0 THEN '+91 98' || lpad(c_custkey::VARCHAR, 8, '0') END AS mobile,
CASE WHEN o_orderkey % 3 = 0 THEN 'c' || c_custkey::VARCHAR || '@mail.example' END AS email, CASE WHEN c_custkey % 2 = 0 THEN '2001-02-03' END AS dob FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _people(spark: SparkSession, d: str) -> DataFrame:
    o, key = _orders_customers(spark, d), F.col("c_custkey").cast("string")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 17 > 0, F.col("c_name")).alias("name"), F.when(F.col("o_orderkey") % 10 > 0, F.concat(F.lit("+91 98"), F.lpad(key, 8, "0"))).alias("mobile"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("c"), key, F.lit("@mail.example"))).alias("email"), F.when(F.col("c_custkey") % 2 == 0, "2001-02-03").alias("dob"))


_PEOPLE_ROLES = {"name": "name", "student_mobile": "mobile", "email": "email", "dob": "dob"}


@query(f"""WITH {_PEOPLE}, k AS (SELECT *, (SELECT avg((mobile IS NOT NULL)::INT) >= 0.8 FROM p) AS m, (SELECT avg((dob IS NOT NULL)::INT) >= 0.8 FROM p) AS b, (SELECT avg((email IS NOT NULL)::INT) >= 0.8 FROM p) AS e FROM p),
i AS (SELECT o_orderkey, CASE WHEN name IS NOT NULL THEN substr(sha256('s:' || trim(regexp_replace(lower(name), '[^a-z0-9 ]+', ' ', 'g')) || CASE WHEN m THEN '|' || coalesce(right(regexp_replace(mobile, '\\D', '', 'g'), 10), '') ELSE '' END
|| CASE WHEN b THEN '|' || coalesce(regexp_replace(dob, '\\D', '', 'g'), '') ELSE '' END || CASE WHEN e THEN '|' || coalesce(email, '') ELSE '' END), 1, 16) END AS person_id, m OR b OR e AS told FROM k)
SELECT o_orderkey, person_id, CASE WHEN person_id IS NOT NULL THEN count(*) OVER (PARTITION BY person_id) END AS person_enrollment_count, CASE WHEN told THEN person_id IS NOT NULL AND count(*) OVER (PARTITION BY person_id) > 1 END AS is_repeat_enrollment FROM i""")
def d11_people(spark, d):
    p = _people(spark, d)
    out = identity.identify(p, identity.plan_identity(p, _PEOPLE_ROLES), "s")
    return out.select("o_orderkey", "person_id", "person_enrollment_count", "is_repeat_enrollment")


@query(f"""WITH {_PEOPLE}, n AS (SELECT count(*) AS k FROM p WHERE name IS NOT NULL GROUP BY trim(regexp_replace(lower(name), '[^a-z0-9 ]+', ' ', 'g'))), c AS (SELECT count(*) AS all_rows, count(mobile) AS m, count(dob) AS b, count(email) AS e FROM p)
SELECT count(*) AS n_names, coalesce(sum(CASE WHEN k > 1 THEN k END), 0)::BIGINT AS n_rows_merged, (SELECT b < 0.8*all_rows AND e < 0.8*all_rows FROM c) AS withheld FROM n""")
def d11_namesakes(spark, d):
    p = _people(spark, d)
    return identity.namesakes(p, identity.plan_identity(p, {r: c for r, c in _PEOPLE_ROLES.items() if r != "student_mobile"}))


_LEFT = """e AS (SELECT o_orderkey, o_orderdate, o_custkey % 9 = 0 AS staff, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'not_to_entertain' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'not_coming' WHEN o_orderkey % 5 > 0 THEN 'active' END AS status,
o_orderpriority AS course, c_mktsegment AS category, CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') AND o_orderkey % 3 > 0 THEN o_orderkey % 200 END AS days FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT course, median(days) FILTER (days > 0) AS med FROM e GROUP BY 1), t AS (SELECT * FROM (VALUES ('BUILDING', 120.0), ('MACHINERY', 45.0)) v(k, v)), u AS (SELECT * FROM (VALUES ('5-LOW', 400.0)) v(k, v)),
r AS (SELECT e.*, coalesce(CASE WHEN days > 0 THEN days::DOUBLE END, med, t.v, u.v) AS dur, CASE WHEN days > 0 THEN 'own' WHEN med IS NOT NULL THEN 'course_median' WHEN t.v IS NOT NULL THEN 'category_default:category' WHEN u.v IS NOT NULL THEN 'category_default:course' END AS basis,
(SELECT max(o_orderdate) FROM orders) AS as_of FROM e JOIN m USING (course) LEFT JOIN t ON category = t.k LEFT JOIN u ON course = u.k)"""


def _left(spark: SparkSession, d: str) -> DataFrame:
    o, s = _orders_customers(spark, d), F.col("o_orderstatus")
    status = F.when((s == "F") & (F.col("o_orderkey") % 2 == 0), "not_to_entertain").when(s == "F", "completed").when(s == "O", "not_coming").when(F.col("o_orderkey") % 5 > 0, "active")
    days = F.when(F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM") & (F.col("o_orderkey") % 3 > 0), F.col("o_orderkey") % 200)
    e = o.select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 9 == 0).alias("staff"), status.alias("status"), F.col("o_orderpriority").alias("course"), F.col("c_mktsegment").alias("category"), days.alias("days"))
    e = lifecycle.resolve_duration(e, "days", "course")
    e = lifecycle.default_durations(e, {" Building ": 120, "machinery": 45, "5-LOW": 400}, ["category", "course"])
    return e.join(F.broadcast(lifecycle.as_of(e, ["o_orderdate"])))


@query(f"WITH {_LEFT} SELECT o_orderkey, dur AS duration_days, basis AS duration_basis FROM r")
def l3_defaults(spark, d):
    return _left(spark, d).select("o_orderkey", "duration_days", "duration_basis")


@query(f"""WITH {_LEFT}, s AS (SELECT *, o_orderdate + to_days(floor(dur)::INT) + INTERVAL 6 MONTH AS dl FROM r),
c AS (SELECT *, CASE WHEN status = 'not_to_entertain' THEN 'churned' WHEN status IS NULL THEN 'no_membership' WHEN status IN ('completed', 'active') THEN status WHEN dl IS NULL THEN 'unlabelled' WHEN as_of >= dl THEN 'churned' ELSE 'paused' END AS label FROM s),
f AS (SELECT *, CASE WHEN staff AND label IN ('churned', 'paused', 'unlabelled') THEN 'staff_alumni' ELSE label END AS churn_status FROM c)
SELECT o_orderkey, churn_status, CASE WHEN churn_status = 'churned' THEN true WHEN churn_status NOT IN ('unlabelled', 'no_membership') THEN false END AS is_churn FROM f""")
def l4_staff(spark, d):
    return lifecycle.churn(_left(spark, d), "status", "o_orderdate", F.col("as_of"), staff="staff", unconditional=True).select("o_orderkey", "churn_status", "is_churn")


# Capability ------------------------------------------------------------------------------------------------------


def _sheets(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    o, key = _orders_customers(spark, d), F.col("c_custkey").cast("string")
    name = F.when(F.col("o_orderkey") % 1000 == 7, F.concat("c_name", F.lit(" (cancelled)"))).otherwise(F.col("c_name"))
    return {
        "admission form": o.select(F.col("o_orderdate").alias("Date of Admission"), name.alias("Student Name"), F.concat(F.lit("98"), F.lpad(key, 8, "0")).alias("Mobile No (Student)"), F.col("o_totalprice").alias("Total Fees")),
        "enquiries": _t(spark, d, "events").select(F.col("ts").alias("Timestamp"), F.col("event_type").alias("Stage")),
        "ledger": _t(spark, d, "lineitem").select(F.col("l_shipdate").alias("Date of Receipt"), F.col("l_extendedprice").alias("Paid Amt")),
    }


def _present(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, list[str]]]:
    sheets = _sheets(spark, d)
    roles = {n: detect(df.columns) for n, df in sheets.items()}
    probed = {n: capability.probes(df, roles[n]) for n, df in sheets.items()}
    return capability.roles_present(spark, roles, probed), probed


_NEEDS = ", ".join(f"('{m}', {k}, '{r}')" for m, sets in T.REQUIREMENTS.items() for k, s in enumerate(sets) for r in s)
_PROBED = """o AS (SELECT c_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey), pr AS (SELECT DISTINCT 'admission form' AS source, 'cancel_marker' AS probe FROM o WHERE o_orderkey % 1000 = 7
UNION ALL SELECT 'admission form', 'repeat_person' WHERE EXISTS (SELECT 1 FROM (SELECT c_custkey, o_orderkey % 1000 = 7 AS marked FROM o) GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'enquiries', 'stale_enquiry' FROM events HAVING datediff('day', min(ts), max(ts)) > 30)"""
_CAPABLE = f"""{_PROBED}, here AS (SELECT probe AS role FROM pr UNION SELECT * FROM (VALUES ('admission_date'), ('name'), ('student_mobile'), ('amount'), ('enquiry_date'), ('status'), ('receipt_date'), ('paid'), ('date_any'), ('completion_source')) v(role)),
n AS (SELECT * FROM (VALUES {_NEEDS}) v(metric, choice, role)), st AS (SELECT metric, choice, list(role ORDER BY role) AS al, coalesce(list(role ORDER BY role) FILTER (role NOT IN (SELECT role FROM here)), []) AS mi FROM n GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY len(mi), choice) AS k FROM st), cap AS (SELECT metric, len(mi) = 0 AS available, CASE WHEN len(mi) = 0 THEN array_to_string(al, ',') END AS "using", CASE WHEN len(mi) > 0 THEN array_to_string(mi, ',') END AS missing FROM b WHERE k = 1)"""


@query(f"WITH {_PROBED} SELECT source, probe FROM pr")
def p10_probes(spark, d):
    rows = [(n, f) for n, found in _present(spark, d)[1].items() for f in found]
    return spark.createDataFrame(rows, "source string, probe string")


def _capabilities(spark: SparkSession, d: str) -> DataFrame:
    return capability.metric_capability(capability.requirements(spark), _present(spark, d)[0])


@query(f"WITH {_CAPABLE} SELECT * FROM cap")
def p9_metrics(spark, d):
    c = _capabilities(spark, d)
    return c.select("metric", "available", F.concat_ws(",", "using").alias("using"), F.concat_ws(",", "missing").alias("missing")).select("metric", "available", F.when(F.col("available"), F.col("using")).alias("using"), F.when(~F.col("available"), F.col("missing")).alias("missing"))


_ASKED = [("BQ1", 0, "churn_rate"), ("BQ1", 1, "completion_rate"), ("BQ2", 0, "collection_efficiency"), ("BQ3", 0, "default_rate"), ("BQ3", 1, "pending_fee"), ("BQ4", 0, "repeat_enrollment_rate"), ("BQ5", 0, "certificate_issue_lag_days"), ("BQ5", 1, "churn_rate"), ("BQ6", 0, "some_new_metric")]
_QUESTIONS = f"""{_CAPABLE}, q AS (SELECT * FROM (VALUES {", ".join(map(str, _ASKED))}) v(question, rank, metric)), anyd AS (SELECT available AS ok, missing AS lack FROM cap WHERE metric = 'total_leads'),
j AS (SELECT question, rank, q.metric, coalesce(available, anyd.ok) AS ok, CASE WHEN available IS NULL THEN anyd.lack ELSE missing END AS lack FROM q LEFT JOIN cap USING (metric), anyd),
g AS (SELECT question, arg_min(metric, rank) AS asked_for, arg_min(metric, rank) FILTER (ok) AS answer_with FROM j GROUP BY 1)"""


def _questions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked, able = spark.createDataFrame(_ASKED, "question string, rank int, metric string"), _capabilities(spark, d)
    return asked, able, capability.question_capability(asked, able)


@query(f"""WITH {_QUESTIONS}, x AS (SELECT question, r, min(rank * 100 + i) AS o FROM (SELECT question, rank, unnest(string_split(lack, ',')) AS r, generate_subscripts(string_split(lack, ','), 1) AS i FROM j WHERE lack IS NOT NULL) GROUP BY ALL)
SELECT question, answer_with IS NOT NULL AS answerable, asked_for, answer_with, CASE WHEN answer_with IS NOT NULL THEN answer_with <> asked_for END AS substituted, CASE WHEN answer_with IS NULL THEN (SELECT string_agg(r, ',' ORDER BY o) FROM x WHERE x.question = g.question) END AS needs FROM g""")
def p12_questions(spark, d):
    q = _questions(spark, d)[2]
    return q.withColumn("needs", F.when(~F.col("answerable"), F.concat_ws(",", "needs")))


@query(f"""WITH {_QUESTIONS}, w AS (SELECT DISTINCT unnest(string_split(missing, ',')) AS role, CASE WHEN answer_with IS NOT NULL THEN question || ':' || q.metric ELSE question END AS u FROM q JOIN cap USING (metric) JOIN g USING (question) WHERE NOT available)
SELECT role, count(*)::INT AS n_unlocks, string_agg(u, ',' ORDER BY u) AS unlocks FROM w GROUP BY 1""")
def p12_shopping(spark, d):
    return capability.shopping_list(*_questions(spark, d)).withColumn("unlocks", F.concat_ws(",", "unlocks"))


@query("""SELECT 'finance' AS domain, 'total_fees' AS measure, round((SELECT sum(o_totalprice) FROM orders) + (SELECT sum(l_extendedprice) FROM lineitem), 2) AS value, 2 AS n_sources UNION ALL SELECT 'finance', 'pending_fees', round((SELECT sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice / 2 END) FROM orders), 2), 1
UNION ALL SELECT 'finance', 'full_paid', (SELECT count(*) FILTER (o_orderstatus = 'F') FROM orders) + (SELECT count(*) FILTER (l_returnflag = 'R') FROM lineitem), 2 UNION ALL SELECT 'certificate', 'certificates_pending', count(*) FILTER (p_size > 25), 1 FROM part UNION ALL SELECT 'certificate', 'certificates_issued', count(*) FILTER (p_size <= 25), 1 FROM part
UNION ALL SELECT 'student', 'enrollments', count(*), 1 FROM customer UNION ALL SELECT 'marketing', 'leads', count(*), 1 FROM events""")
def x16_domains(spark, d):
    o = _t(spark, d, "orders").select("o_totalprice", F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.col("o_totalprice") / 2).alias("open"))
    lines = _t(spark, d, "lineitem").select("l_extendedprice", F.when(F.col("l_returnflag") == "R", "Full Paid").otherwise("part").alias("state"))
    sources = {
        "fees": ("finance", o, {"amount": "o_totalprice", "pending": "open"}),
        "receipts": ("finance", lines, {"amount": "l_extendedprice", "status": "state"}),
        "papers": ("certificate", _t(spark, d, "part").select((F.col("p_size") > 25).alias("is_certificate_pending")), {}),
        "people": ("student", _t(spark, d, "customer"), {}),
        "leads": ("marketing", _t(spark, d, "events"), {}),
    }
    return capability.domain_totals(sources).select("domain", "measure", F.round("value", 2).alias("value"), F.col("n_sources").cast("int").alias("n_sources"))


@query("""WITH l AS (SELECT 'p_name' AS "column", p_name AS v FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_retailprice', p_retailprice::VARCHAR FROM part UNION ALL SELECT 'phone', '98' || lpad(p_partkey::VARCHAR, 8, '0') FROM part UNION ALL SELECT 'day', strftime(DATE '2020-01-01' + (p_partkey % 900)::INT, '%Y-%m-%d') FROM part UNION ALL SELECT 'serial', '1' || lpad(p_partkey::VARCHAR, 7, '0') FROM part),
g AS (SELECT "column", count(*) AS n, count(DISTINCT v) AS k, avg((length(v) BETWEEN 10 AND 12 AND regexp_matches(v, '^[0-9]+$'))::INT) AS pii, avg((TRY_CAST(v AS DOUBLE) IS NOT NULL)::INT) AS num, avg(regexp_matches(v, '^\\d{1,4}-\\d{1,2}-\\d{1,4}')::INT) AS day, avg(regexp_matches(v, '^[0-9]+$')::INT) AS ints, median(length(v)) AS len FROM l GROUP BY 1)
SELECT "column", n, pii AS pii_share, num AS numeric_share, day AS date_share, CASE WHEN pii >= 0.6 THEN 'pii' WHEN num >= 0.8 AND NOT (n >= 20 AND ints >= 0.95 AND len >= 6 AND k/n >= 0.95) THEN 'numeric' WHEN day >= 0.6 THEN 'date' WHEN k <= 50 AND k/n < 0.5 THEN 'dimension' ELSE 'none' END AS kind FROM g""")
def p2_kinds(spark, d):
    key = F.col("p_partkey").cast("string")
    p = _t(spark, d, "part").select("p_name", "p_brand", F.col("p_retailprice").cast("string").alias("p_retailprice"), F.concat(F.lit("98"), F.lpad(key, 8, "0")).alias("phone"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 900).cast("int")), "yyyy-MM-dd").alias("day"), F.concat(F.lit("1"), F.lpad(key, 7, "0")).alias("serial"))
    return roles.column_kinds(p, p.columns)


@query("""SELECT 'o_orderkey' AS "column", CASE WHEN count(DISTINCT o_orderkey) >= greatest(20, 0.95*count(*)) THEN 'id' ELSE 'amount' END AS kind, NULL::BIGINT AS n_values FROM orders UNION ALL SELECT 'o_custkey', CASE WHEN count(DISTINCT o_custkey) >= greatest(20, 0.95*count(*)) THEN 'id' ELSE 'amount' END, NULL FROM orders UNION ALL SELECT 'o_orderstatus', 'categorical', count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'o_totalprice', 'amount', NULL UNION ALL SELECT 'o_orderdate', 'date', NULL UNION ALL SELECT 'o_orderpriority', CASE WHEN count(DISTINCT o_orderpriority) <= 50 THEN 'categorical' ELSE 'text' END, count(DISTINCT o_orderpriority) FROM orders""")
def p4_kinds(spark, d):
    return roles.schema_kinds(_t(spark, d, "orders"))


@query("SELECT o_orderpriority, c_mktsegment, count(*) AS n, round(quantile_cont(o_totalprice, 0.9), 6) AS q FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def f10_group_quantiles(spark, d):
    return _rounded(explore.group_quantile(_orders_customers(spark, d), ["o_orderpriority", "c_mktsegment"], "o_totalprice", 0.9, rows=4000))


# Privacy and keys ------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, substr(sha256('s:' || c_name), 1, 16) AS "Student Name", substr(sha256('s:' || c_mktsegment), 1, 16) AS "Home Address", substr(sha256('s:' || '98' || lpad(c_custkey::VARCHAR, 8, '0')), 1, 16) AS second, c_acctbal FROM customer""")
def i1_masks(spark, d):
    key = F.col("c_custkey").cast("string")
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("Student Name"), F.col("c_mktsegment").alias("Home Address"), F.concat(F.lit("98"), F.lpad(key, 8, "0")).alias("second"), "c_acctbal")
    return privacy.mask_personal(c, privacy.personal_columns(c, detect(c.columns), discover=True), "s")


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(^|[^\d.])[-+]?\d+\.\d+($|[^\d.])', '\1 # \2', 'g'), '(^|[^\d.])[-+]?\d+\.\d+($|[^\d.])', '\1 # \2', 'g') AS v, text FROM documents)
SELECT 'text' AS "column", doc_id::VARCHAR AS row_id, 'phone' AS kind FROM t WHERE regexp_matches(v, '\b\d{10}\b') OR len(list_filter(regexp_extract_all(v, '\+?\d[\d\s().\-]{8,14}\d'), lambda x: len(regexp_replace(x, '\D', '', 'g')) BETWEEN 10 AND 13 AND regexp_matches(x, '[ +().\-]'))) > 0
UNION ALL SELECT 'text', doc_id::VARCHAR, 'email' FROM t WHERE regexp_matches(text, '[\w.\-+]+@[\w\-]+\.[\w.\-]+')""")
def i3_report(spark, d):
    return privacy.leak_report(_t(spark, d, "documents").select("doc_id", "text"), "doc_id")


@query("""SELECT 'c_name' AS "column", c_name AS value, count(*) AS n FROM customer WHERE c_custkey % 50 = 0 GROUP BY ALL UNION ALL SELECT 'c_mail', 'c' || c_custkey || '@real.example', count(*) FROM customer WHERE c_custkey % 70 = 1 GROUP BY ALL""")
def i5_audit(spark, d):
    key, pool = F.col("c_custkey"), [f"person {k}" for k in range(40)]
    names = F.when(key % 50 == 0, F.col("c_name")).otherwise(flags.pseudonym(F.col("c_name"), pool, "s"))
    mails = F.when(key % 70 == 1, F.concat(F.lit("c"), key.cast("string"), F.lit("@real.example"))).otherwise(F.concat(F.lit("c"), key.cast("string"), F.lit("@safe.example")))
    safe = spark.createDataFrame([("c_name", p) for p in pool], "column string, value string").unionByName(_t(spark, d, "customer").select(F.lit("c_mail").alias("column"), F.concat(F.lit("c"), key.cast("string"), F.lit("@safe.example")).alias("value")))
    return privacy.outside_safe_space(_t(spark, d, "customer").select(names.alias("c_name"), mails.alias("c_mail")), ["c_name", "c_mail"], safe)


_KEYED = "t AS (SELECT l_orderkey, l_shipdate, l_extendedprice, l_returnflag, l_partkey, l_orderkey * 10 + l_linenumber AS line FROM lineitem UNION ALL SELECT l_orderkey, l_shipdate, l_extendedprice, l_returnflag, l_partkey, -(l_orderkey * 10 + l_linenumber) FROM lineitem WHERE l_partkey % 100 = 0)"


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice", "l_returnflag", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return lines.unionByName(lines.where("l_partkey % 100 = 0").withColumn("line", -F.col("line")))


_KEY_ROLES = {"receipt_id": "l_orderkey", "receipt_date": "l_shipdate", "amount": "l_extendedprice", "payment_mode": "l_returnflag", "student_id": "l_partkey"}


@query(f"""WITH {_KEYED}, n AS (SELECT count(*) AS n FROM t) SELECT 0 AS level, 'l_orderkey' AS columns, count(DISTINCT l_orderkey) AS n_groups, round((max(n) - count(DISTINCT l_orderkey))/max(n), 6) AS collapsed FROM t, n
UNION ALL SELECT 1, 'l_orderkey,l_shipdate,l_extendedprice,l_returnflag,l_partkey', count(DISTINCT (l_orderkey, l_shipdate, l_extendedprice, l_returnflag, l_partkey)), round((max(n) - count(DISTINCT (l_orderkey, l_shipdate, l_extendedprice, l_returnflag, l_partkey)))/max(n), 6) FROM t, n""")
def c16_levels(spark, d):
    return _rounded(clean.natural_key(_keyed(spark, d), _KEY_ROLES)[1])


@query(f"WITH {_KEYED} SELECT min(line) AS line, l_orderkey, l_shipdate, l_extendedprice, l_returnflag, l_partkey FROM t GROUP BY ALL")
def c16_widened(spark, d):
    t = _keyed(spark, d)
    return clean.drop_repeats(t, clean.natural_key(t, _KEY_ROLES)[0], "line")


# Decisions -------------------------------------------------------------------------------------------------------

_ODD = f"oc AS (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN hash_ < 450 WHEN o_orderpriority = '1-URGENT' THEN hash_ < 150 ELSE hash_ < 300 END AS hit FROM (SELECT *, o_orderkey * 7 % 1000 AS hash_ FROM (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)))"
_FOUND = f"""{_ODD}, b AS (SELECT avg(hit::INT) AS base FROM oc), g AS (SELECT 'c_mktsegment' AS dimension, 'branch' AS role, c_mktsegment AS segment, count(*) AS n, avg(hit::INT) AS v FROM oc GROUP BY ALL UNION ALL SELECT 'o_orderpriority', 'course', o_orderpriority, count(*), avg(hit::INT) FROM oc GROUP BY ALL),
f AS (SELECT *, v - base AS gap FROM g, b WHERE n >= 30 AND abs(v - base) >= 0.05)"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    h = F.pmod(F.col("o_orderkey") * 7, F.lit(1000))
    hit = F.when(F.col("c_mktsegment") == "BUILDING", h < 450).when(F.col("o_orderpriority") == "1-URGENT", h < 150).otherwise(h < 300)
    return decide.findings(breakdown(_orders_customers(spark, d).withColumn("hit", hit), Metric("rate", "hit"), ["c_mktsegment", "o_orderpriority"]), "rate")


@query(f"""WITH {_FOUND}, a AS (SELECT CASE WHEN gap > 0 THEN 'scale_lever' ELSE 'close_gap' END AS action, dimension, segment, CASE role WHEN 'branch' THEN 'branch_manager' ELSE 'academics' END AS owner, CASE role WHEN 'branch' THEN 'Branch Management' ELSE 'Courses' END AS category, abs(gap) AS gap, n, v AS current, base AS target FROM f WHERE gap < 0 OR v/base >= 1.3
UNION ALL SELECT 'reduce_backlog', NULL, NULL, 'operations', 'Certificates', NULL, NULL, NULL, NULL UNION ALL SELECT 'investigate', NULL, 'why?', 'analytics_team', 'Operations', NULL, NULL, NULL, NULL),
s AS (SELECT *, CASE action WHEN 'close_gap' THEN 'medium' WHEN 'reduce_backlog' THEN 'medium' ELSE 'low' END AS effort, CASE action WHEN 'reduce_backlog' THEN 'medium' ELSE 'low' END AS risk, gap * n AS estimate FROM a)
SELECT row_number() OVER (ORDER BY CASE WHEN action = 'investigate' THEN -1 ELSE coalesce(estimate, 0) END DESC, action, dimension, segment)::INT AS priority, action, dimension, segment, owner, category, effort, risk, CASE effort WHEN 'low' THEN 'Short-Term (8-30 Days)' ELSE 'Medium-Term (1-3 Months)' END AS timeline,
CASE WHEN estimate IS NULL THEN 'P4' WHEN effort = 'low' AND risk = 'low' THEN 'P1' ELSE 'P2' END AS bucket, estimate IS NOT NULL AND effort = 'low' AND risk = 'low' AS quick_win, round(gap, 6) AS gap, n, round(estimate, 4) AS estimate, round(current, 6) AS current, round(target, 6) AS target FROM s""")
def o5_plan(spark, d):
    out = decide.action_plan(_found(spark, d), "rate", {"c_mktsegment": "branch", "o_orderpriority": "course"}, ["why?"], backlog=True)
    return _rounded(out.withColumn("estimate", F.round("estimate", 4)))


@query(f"""WITH oc AS (SELECT *, (o_orderstatus = 'F') AS done FROM orders JOIN customer ON o_custkey = c_custkey), h AS (SELECT count(*) AS n, avg(done::INT) AS p FROM oc), g AS (SELECT c_mktsegment AS s, count(*) AS n, avg(done::INT) AS p FROM oc GROUP BY 1),
t AS (SELECT max(o_orderdate) AS t FROM oc), p AS (SELECT count(*) FILTER (o_orderdate > t - INTERVAL 12 MONTH) AS cn, count(*) FILTER (o_orderdate > t - INTERVAL 12 MONTH AND done) AS c, count(*) FILTER (o_orderdate <= t - INTERVAL 12 MONTH AND o_orderdate > t - INTERVAL 24 MONTH) AS pn, count(*) FILTER (o_orderdate <= t - INTERVAL 12 MONTH AND o_orderdate > t - INTERVAL 24 MONTH AND done) AS p FROM oc, t),
k AS (SELECT c/cn AS cv, p/pn AS pv, abs((c/cn - p/pn)/sqrt((c+p)/(cn+pn)*(1-(c+p)/(cn+pn))*(1/cn + 1/pn))) >= 1.96 AS sig FROM p), f AS (SELECT count(*) AS a, count(*) FILTER (done) AS b FROM oc),
m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*)::DOUBLE AS v FROM oc GROUP BY 1), w AS (SELECT s, n, (p - (SELECT p FROM h))*n/sum(n) OVER () AS c FROM g)
SELECT 'headline' AS chart, 1 AS place, 'value' AS label, round(p, 6) AS value, round({_WILSON[0]}, 6) AS low, round({_WILSON[1]}, 6) AS high, n::VARCHAR AS note FROM h UNION ALL SELECT 'by c_mktsegment', row_number() OVER (ORDER BY p DESC, s), s, round(p, 6), round({_WILSON[0]}, 6), round({_WILSON[1]}, 6), n::VARCHAR FROM g
UNION ALL SELECT 'comparison', 1, 'prior', round(pv, 6), NULL, NULL, CASE WHEN sig THEN 'significant' ELSE 'not significant' END FROM k UNION ALL SELECT 'comparison', 2, 'current', round(cv, 6), NULL, NULL, CASE WHEN sig THEN 'significant' ELSE 'not significant' END FROM k
UNION ALL SELECT 'months', row_number() OVER (ORDER BY month), month, v, NULL, NULL, NULL FROM m UNION ALL SELECT 'funnel', 1, 'all', a, NULL, NULL, NULL FROM f UNION ALL SELECT 'funnel', 2, 'done', b, round(1 - b/a, 6), NULL, NULL FROM f
UNION ALL SELECT 'drivers', row_number() OVER (ORDER BY abs(c) DESC, s), 'c_mktsegment=' || s, round(c, 6), NULL, NULL, n::VARCHAR FROM w""")
def o6_charts(spark, d):
    oc, m = _orders_customers(spark, d).withColumn("all", F.lit(True)), Metric("rate", "done")
    parts = breakdown(oc, m, ["c_mktsegment"])
    return _rounded(decide.chart_tables(headline(oc, m), parts, compare_periods(oc, m, "o_orderdate", 12), stats.monthly_series(oc, "o_orderdate"), decide.funnel(oc, [("all", "all"), ("done", "done")]), drivers(oc, m, ["c_mktsegment"], top=99)))


@query("""WITH a AS (SELECT count(*) AS n, avg(o_totalprice) AS v, stddev_samp(o_totalprice) AS sd FROM orders), t AS (SELECT max(o_orderdate) AS t FROM orders), p AS (SELECT avg(o_totalprice) FILTER (o_orderdate > t - INTERVAL 12 MONTH) AS c, avg(o_totalprice) FILTER (o_orderdate <= t - INTERVAL 12 MONTH AND o_orderdate > t - INTERVAL 24 MONTH) AS p FROM orders, t)
SELECT round(v, 4) AS value, round((c - p)/abs(p), 6) AS delta_pct, CASE WHEN c = p THEN 'neutral' WHEN c < p THEN 'good' ELSE 'bad' END AS status, CASE WHEN 2*1.959963984540054*sd/sqrt(n)/v <= 0.2 THEN 'high' WHEN 2*1.959963984540054*sd/sqrt(n)/v <= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM a, p""")
def o6_card(spark, d):
    o, m = _orders(spark, d), Metric("mean", "o_totalprice")
    return _rounded(decide.kpi_card(headline(o, m), compare_periods(o, m, "o_orderdate", 12), lower_is_better=True).withColumn("value", F.round("value", 4)))


@query("""WITH oc AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey), g AS (SELECT CASE WHEN grouping(c_mktsegment, o_orderpriority) = 0 THEN 'cell' WHEN grouping(c_mktsegment, o_orderpriority) = 1 THEN 'row' WHEN grouping(c_mktsegment, o_orderpriority) = 2 THEN 'column' ELSE 'overall' END AS level, c_mktsegment AS "row", o_orderpriority AS col, count(*) AS n, avg(o_totalprice) AS v, stddev_samp(o_totalprice) AS sd
FROM oc GROUP BY GROUPING SETS ((), (c_mktsegment), (o_orderpriority), (c_mktsegment, o_orderpriority))) SELECT level, "row", col, n, round(v, 2) AS value, round(sd, 2) AS sd, round(v - 1.959963984540054*sd/sqrt(n), 2) AS ci_low, round(v + 1.959963984540054*sd/sqrt(n), 2) AS ci_high FROM g""")
def k2_means(spark, d):
    out = cross.crosstab(_orders_customers(spark, d), Metric("mean", "o_totalprice"), "c_mktsegment", "o_orderpriority")
    return _rounded(out.select("level", "row", "col", "n", "value", "sd", "ci_low", "ci_high"), 2)


@query("""WITH o AS (SELECT *, (o_orderstatus = 'F') AS done FROM orders), i AS (SELECT * FROM o WHERE o_orderdate >= DATE '1996-01-01'), t AS (SELECT max(o_orderdate) AS t FROM i), p AS (SELECT count(*) FILTER (o_orderdate > t - INTERVAL 1 MONTH) AS cn, count(*) FILTER (o_orderdate > t - INTERVAL 1 MONTH AND done) AS c, count(*) FILTER (o_orderdate <= t - INTERVAL 1 MONTH AND o_orderdate > t - INTERVAL 2 MONTH) AS pn, count(*) FILTER (o_orderdate <= t - INTERVAL 1 MONTH AND o_orderdate > t - INTERVAL 2 MONTH AND done) AS p FROM i, t),
k AS (SELECT *, coalesce(abs((c/cn - p/pn)/sqrt((c+p)/(cn+pn)*(1-(c+p)/(cn+pn))*(1/cn + 1/pn))) >= 1.96, false) AS sig FROM p)
SELECT 'few_rows' AS topic, count(*) AS n FROM i HAVING count(*) < 30 UNION ALL SELECT 'thin_segments', count(*) FROM (SELECT o_custkey FROM i GROUP BY 1 HAVING count(*) < 30 ORDER BY count(*) DESC, o_custkey::VARCHAR LIMIT 25) UNION ALL SELECT 'change_not_significant', cn FROM k WHERE NOT sig UNION ALL SELECT 'thin_prior_period', pn FROM k WHERE pn < 30
UNION ALL SELECT 'outside_window', (SELECT count(*) FROM o) - (SELECT count(*) FROM i) WHERE (SELECT count(*) FROM o) > (SELECT count(*) FROM i)""")
def j8_window(spark, d):
    inside, report = clean.time_window(_orders(spark, d), "o_orderdate", "1996-01-01")
    m = Metric("rate", "done")
    return caveats(headline(inside, m), breakdown(inside, m, ["o_custkey"]), compare_periods(inside, m, "o_orderdate", 1), window=report)
