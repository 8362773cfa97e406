import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.functions import canon
from tidewater.operators import classify, clean, decide, flags, lifecycle, link, roles
from tidewater.operators.metrics import Blocked
from tidewater.sources import readers
from tidewater.streaming import alerts


def values(spark, fn, items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[0] for r in df.select("i", fn(F.col("x")).alias("v")).orderBy("i").select("v").collect()]


def test_money_and_dates(spark):
    assert values(spark, lambda c: clean.money(c, floor=False), ["-7200", "0", "1,500"]) == [-7200, 0, 1500]
    assert values(spark, clean.money, ["-100", "₹ 12,000", "8000", "x"]) == [0, 12000, 8000, None]
    day = lambda first: lambda c: F.to_date(clean.parse_date(c, first)).cast("string")
    assert values(spark, day(True), ["3/4/2024", "13/04/24", "4/13/2024", "2024-05-06", "rubbish", None]) == ["2024-04-03", "2024-04-13", "2024-04-13", "2024-05-06", None, None]
    assert values(spark, day(False), ["3/4/2024"]) == ["2024-03-04"]
    df = spark.createDataFrame([("13/1/2024", "1/13/2024"), ("2/3/2024", "2/3/2024")], "a string, b string")
    assert clean.date_votes(df, ["a", "b"]) == {"a": True, "b": False}


def test_channels_and_refunds(spark):
    text = ["paid to ICICI", "razorpay emi", "2400 refunded", "cheque no 1", "other", "cash", "gpay"]
    assert values(spark, canon.payment_channel, text) == ["bank_transfer", "emi", None, "cheque", None, "cash", "upi"]
    assert values(spark, canon.is_refund, text) == [False, False, True, False, False, False, False]


def test_name_markers(spark):
    got = values(spark, canon.name_markers, ["A (admission cancelled all refunded)", "B (not coming)", "C (ft) 30/6", "D"])
    assert [(r["name"], r["enrollment_status"], r["is_fast_track"]) for r in got] == [("A", "refunded", False), ("B", "not_coming", False), ("C", "active", True), ("D", "active", False)]


def test_taxonomies(spark):
    names = ["Adv Excel (1 & 2)", "C++ & C", "Graohic design", "Kids course", "Basic python (m-1)", "knitting"]
    assert values(spark, canon.course_family, names) == ["advanced excel", "c & c++ programming", "graphic designing", "computer basics", "python programming", "knitting"]
    assert values(spark, canon.course_module, names)[0] == "1 & 2"
    assert values(spark, lambda c: canon.course_category(c, canon.course_family(c)), names) == ["Office & Productivity", "Programming & Development", "Design & Creative", "Foundational/School", "Programming & Development", "Other"]
    assert [tuple(r) for r in values(spark, canon.lead_source, [None, "Google", "Other", "old student", "Ramesh bhai", "banner"])] == [("Walk-in", "blank"), ("Online/Google/Social", "rule"), (None, "other"), ("Referral", "rule"), ("Referral", "named-referrer"), ("Walk-in", "rule")]
    assert values(spark, canon.occupation, ["Freelance", "freelancing as designer", "11 th", "teacher", None, "retired"]) == ["Other", "Business / Job", "Student", "Business / Job", None, "Other"]
    assert values(spark, canon.branch, ["City Light", "n/a", "Adajan"]) == ["citylight", None, "adajan"]
    assert values(spark, canon.phone, ["9998877665", "+91 99988 77665", "9998877665.0", "123"]) == ["9998877665"] * 3 + [""]


def test_cleaning_tables(spark):
    df = spark.createDataFrame([("zzzzz (Don't Delete)", None, "1"), ("a", None, "2")], "name string, blank string, `Cleaned fee` string").withColumn("fee", F.lit("x"))
    out = clean.purge_placeholders(clean.drop_broken_columns(df))
    assert set(out.columns) == {"name", "fee"} and [r["fee"] for r in out.collect()] == ["2"]
    keys = spark.createDataFrame([(i, i % 50, i % 2) for i in range(100)], "row int, a int, b int")
    assert clean.choose_key(keys, [["a"], ["a", "b"]]) is None
    assert clean.dedupe(keys.unionByName(keys.limit(1)), [["row"]], "a").count() == 100
    with pytest.raises(Blocked):
        clean.drop_undated(spark.createDataFrame([(None,), ("2024-01-01",)], "d string"), "d")


def test_flags(spark):
    df = spark.createDataFrame([(0, "A1"), (1, ""), (2, "A1"), (3, None), (4, "B")], "i int, s string")
    assert [r[0] for r in flags.duplicate_serials(df, "s").orderBy("i").select("is_duplicate_certificate").collect()] == [True, False, True, False, False]
    p = spark.createDataFrame([("1", dt.date(2022, 4, 2), 1), ("1", dt.date(2023, 10, 28), 2), ("1", dt.date(2023, 11, 8), 3), ("2", dt.date(2020, 1, 1), 4)], "p string, d date, r int")
    assert [r[0] for r in flags.person_rows(p, "p", "d", "r").orderBy("r").select("person_admission_seq").collect()] == [3, 2, 1, 1]
    assert values(spark, flags.scrub, ["call +91 99988 77665 or a.b@c.de", "paid 12000 on 1/2/2024"]) == ["call [mobile] or [email]", "paid 12000 on 1/2/2024"]
    leak = spark.createDataFrame([("1", "9998877665"), ("2", "12345")], "id string, t string")
    assert [tuple(r) for r in flags.leaks(leak, "id").collect()] == [("t", "1", "phone")]


def test_churn_boundary(spark):
    df = spark.createDataFrame([("not_coming", dt.datetime(2025, 1, 1), 360.0)], "s string, d timestamp, duration_days double")
    for day, want in (("2025-07-02", "paused"), ("2026-07-02", "churned")):
        assert lifecycle.churn(df, "s", "d", F.lit(day).cast("timestamp")).first()["churn_status"] == want


def test_reconciliation(spark):
    ledger = spark.createDataFrame([(500, 5000.0, "2025-01-01"), (500, 5000.0, "2025-03-01"), (501, 10000.0, "2025-01-05"), (502, 5000.0, "2025-02-01"), (503, 2400.0, "2025-01-01"), (503, -2400.0, "2025-01-09")], "id long, paid double, d string").withColumns({"d": F.to_date("d"), "ch": F.lit("cash")})
    rollup = spark.createDataFrame([(500, 12000.0, 2000.0), (501, 10000.0, -7200.0), (502, 8000.0, 0.0), (504, 10.0, 0.0)], "id long, total double, pending double")
    r = {x["id"]: x for x in link.reconcile(ledger, rollup, "id", "paid", "d", "ch", "total", "pending").collect()}
    assert (r[500]["span_days"], r[500]["mismatch"], r[502]["gap"], r[501]["negative_pending_flag"]) == (59, False, 3000.0, True)
    assert (r[503]["refund_total"], r[503]["net"], r[504]["net"]) == (2400.0, 0.0, None)


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (3, "y")], "k int, w string")
    out, report = link.guarded_join(left, right, ["k"], "r")
    assert out.count() == 3 and tuple(report.select("left_unmatched", "right_unmatched", "cardinality").first()) == (2, 1, "many-to-one")
    with pytest.raises(Blocked):
        link.guarded_join(right, left, ["k"], "r")
    tabs = {"t__Course_Completed": [("p1",), ("p2",)], "t__Not_Coming": [("p1",), ("p3",), ("p4",)], "t__NOT TO ENTERTRAIN": [("p5",)]}
    u = link.union_partitions({k: spark.createDataFrame(v, "p string") for k, v in tabs.items()}, ["p"])
    assert u.count() == 5 and u.where("lifecycle_conflict").count() == 1
    master = spark.createDataFrame([("p1", "a"), ("p2", "b")], "p string, c string")
    roster = spark.createDataFrame([("p1", "a", "active", 1), ("p1", "a", "completed", 2), ("p2", "z", "not_coming", 3)], "p string, c string, s string, r int")
    got = {x["p"]: (x["roster_status"], x["match_basis"]) for x in link.roster_join(master, roster, "p", "c", "s", "r").collect()}
    assert got == {"p1": ("completed", "person_course"), "p2": ("not_coming", "person")}
    touch = spark.createDataFrame([("A", "e1", "enquiry", 1), ("B", "e1", "enquiry", 2), ("C", "e2", "enquiry", 3), ("A", "s", "admission", 4), ("C", "s", "admission", 5), ("D", "s", "admission", 6)], "p string, s string, k string, o int")
    c = link.conversion(touch, "p", "s", "k", "o")
    assert (c.count(), c.where("converted").count(), c.where("cross_source").count()) == (3, 2, 2)


def test_roles(spark):
    r = roles.detect(["Timestamp", "Student Name", "Mobile No (Student)", "Mobile No (Father / Guardian)", "Mobile No (Mother / Guardian)", "Date of Birth", "Counsellor Name", "Which Course do you want", "unnamed: 3"])
    assert r["name"] == "Student Name" and r["counsellor"] == "Counsellor Name" and r["parent_mobile_2"] == "Mobile No (Mother / Guardian)" and r["enquiry_date"] == "Timestamp"
    df = spark.createDataFrame([("Course completed",), ("learning",), ("not coming",), ("Unknown",)], "st string").withColumn("x", F.lit("q"))
    assert [x["column"] for x in roles.lifecycle_column(df).collect()] == ["st"]
    assert roles.drift(["A", "old"], ["a", "b"], deprecated=["OLD"]) == {"missing": ["b"], "extra": [], "deprecated": ["OLD"]}
    cap = roles.capability(spark, ["is_default", "pending"])
    assert cap.where("available and metric = 'default_rate'").count() == 1


def test_classifier_and_decisions(spark):
    rows = [(i, "P" if i % 2 else "A", int(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, site string, y int")
    classify.gate(df, "y")
    with pytest.raises(Blocked):
        classify.gate(df.limit(20), "y")
    m = classify.fit(df, "id", ["site"], "y")
    e = classify.evaluate(classify.score(df, m, classify.priors(df, "y"), "id", ["site"], "y"), "y").first()
    assert e["accuracy"] == 1.0 and e["lift"] == 0.5
    assert classify.risk_factors(m).first()["value"] == "P"
    assert decide.parse_threshold("below 31%") == ("<", 0.31) and decide.parse_threshold("soon") is None
    b = spark.createDataFrame([("d", "one", 1, 900.0, 100.0), ("d", "big", 500, 60000.0, 100.0), ("d", "low", 500, 30000.0, 100.0)], "dimension string, segment string, n long, value double, baseline double")
    assert {r["segment"]: r["kind"] for r in decide.findings(b, "sum").collect()} == {"big": "opportunity", "low": "risk"}


def test_readers(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("a,b\n1,2\n3,4,5\n6,7\n")
    df, wide = readers.read_csv(spark, str(f))
    assert wide == 1 and [tuple(r) for r in df.collect()] == [("1", "2"), ("3", "4"), ("6", "7")]
    j = tmp_path / "a.json"
    j.write_text('{"a": 1}')
    got, issues = readers.read_sources(spark, [{"name": "c", "path": str(f)}, {"name": "j", "type": "json", "path": str(j)}, {"name": "gone", "path": str(tmp_path / "no.csv")}])
    assert set(got) == {"c", "j"} and issues[0][0] == "gone"


def test_stream_alerts(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i // 10, 12), "purchase" if i % 10 < i // 10 else "view") for i in range(50)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(src)
    q = alerts.watch(alerts.daily_rates(stream, "ts", "kind", "purchase"), 0.1, 0.9, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    batch = alerts.alerts(alerts.daily_rates(spark.read.parquet(src), "ts", "kind", "purchase"), 0.1, 0.9)
    assert [r["alert"] for r in batch.collect()] == ["below"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
