"""Identity, capability, privacy, keys, lifecycle and readers on small tables."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import tables as T
from tidewater.operators import capability, clean, identity, lifecycle, privacy
from tidewater.sources import readers


def test_a_sparse_discriminator_is_not_used(spark):
    rows = [(k, "Asha Rao", "98765 43210" if k < 9 else None, "a@b.co" if k < 3 else None) for k in range(10)] + [(10, None, "98765 43210", None)]
    df = spark.createDataFrame(rows, "n int, name string, mobile string, mail string")
    plan = identity.plan_identity(df, {"name": "name", "student_mobile": "mobile", "email": "mail", "dob": "gone"})
    assert plan.basis == ("name", "student_mobile") and plan.ignored == ["email"] and plan.coverage["email"] == pytest.approx(3 / 11)
    got = {r.n: r for r in identity.identify(df, plan).collect()}
    assert got[10].person_id is None and got[10].person_enrollment_count is None and not got[10].is_repeat_enrollment
    assert got[0].person_enrollment_count == 9 and got[0].is_repeat_enrollment and not got[9].is_repeat_enrollment


def test_names_alone_withhold_person_results(spark):
    df = spark.createDataFrame([("Asha",), ("asha ",), ("Bo",), (None,)], "name string")
    plan = identity.plan_identity(df, {"name": "name"})
    got = identity.identify(df, plan)
    assert "is_repeat_enrollment" not in got.columns and sorted(r.person_enrollment_count or 0 for r in got.collect()) == [0, 1, 2, 2]
    assert tuple(identity.namesakes(df, plan).first()) == (2, 2, True)
    with pytest.raises(identity.Blocked):
        identity.plan_identity(df, {})


def test_capability_takes_the_least_missing_set(spark):
    present = capability.roles_present(spark, {"Course_Completed": {"joining_date": "d", "name": "n"}, "fees": {"amount": "a", "pending": "p"}}, {"fees": ["cancel_marker"]})
    cap = {r.metric: r for r in capability.metric_capability(capability.requirements(spark), present).collect()}
    assert set(cap) == set(T.REQUIREMENTS)
    assert cap["collection_efficiency"].available and cap["collection_efficiency"].using == ["amount", "pending"]
    assert cap["churn_rate"].missing == ["course_duration"]
    assert cap["dropout_rate"].using == ["completion_source"]
    assert cap["lead_to_admission_days"].missing == ["enquiry_date"]


def test_substitutes_stay_on_the_shopping_list(spark):
    present = capability.roles_present(spark, {"Course_Completed": {"joining_date": "d"}})
    able = capability.metric_capability(capability.requirements(spark), present)
    asked = spark.createDataFrame([("a", 0, "churn_rate"), ("a", 1, "completion_rate"), ("b", 0, "pending_fee"), ("c", 0, "default_rate"), ("d", 0, "never heard of")], "question string, rank int, metric string")
    q = capability.question_capability(asked, able)
    got = {r.question: r for r in q.collect()}
    assert got["a"].answer_with == "completion_rate" and got["a"].substituted and got["a"].needs is None
    assert not got["b"].answerable and got["b"].needs == ["pending"]
    assert got["d"].answerable and not got["d"].substituted
    wanted = [tuple(r) for r in capability.shopping_list(asked, able, q).collect()]
    assert wanted == [("pending", 2, ["b", "c"]), ("course_duration", 1, ["a:churn_rate"])]


def test_probes_tell_flags_by_values(spark):
    df = spark.createDataFrame([("Asha (cancelled)", "9876543210", "2024-01-01", None), ("Bo", "9876543211", "2024-03-01", "2024-03-02"), ("bo ", "98765-43211", "2024-03-01", None)], "name string, phone string, asked string, came string")
    roles = {"name": "name", "student_mobile": "phone", "enquiry_date": "asked", "admission_date": "came"}
    assert capability.probes(df, roles) == ["cancel_marker", "stale_enquiry", "repeat_person"]
    assert capability.probes(df.where("name = 'Bo'"), roles) == []
    assert capability.probes(df.limit(0), roles) == []
    state = spark.createDataFrame([("Course Completed",), ("Not Coming",), ("Course Completed",)], "state string")
    assert capability.probes(state, {}) == ["lifecycle_column"]


def test_roles_of_joined_sources(spark):
    sources = {"Fees Data": {"name": "Name", "amount": "Total"}, "people": {"name": "Name", "email": "Mail", "dob": "gone"}}
    assert capability.merged_roles(sources, ["Name", "fees_data__Total", "people__Mail"]) == {"name": "Name", "amount": "fees_data__Total", "email": "people__Mail"}
    df = spark.range(3)
    assert [tuple(r) for r in capability.source_summary({"a": ("finance", df)}, []).collect()] == [("a", "finance", 3, 1, False)]


@pytest.mark.parametrize(("text", "phone"), [("9876543210", True), ("x98765432100", False), ("+91 98765-43210", True), ("-279345.8333", False), ("ratio 279345.83331 of", False), ("12.5 98765 43210", True), ("(0261) 234 5678", True), ("1234567890123", False), ("2024-01-01", False), ("1.5 2.5 3.5", False), (None, False), ("", False)])
def test_phones_and_numbers(spark, text, phone):
    assert spark.createDataFrame([(text,)], "t string").select(privacy.shows_phone(F.col("t"))).first()[0] == phone


def test_leaks_withhold(spark):
    clean_ = spark.createDataFrame([(1, "fine", 2.5)], "id int, note string, v double")
    assert privacy.withheld_if_leaking(clean_, "id").count() == 1
    bad = spark.createDataFrame([(1, "call 98765 43210", "x"), (2, None, "a@b.co")], "id int, note string, `odd name` string")
    assert sorted(tuple(r) for r in privacy.leak_report(bad, "id").collect()) == [("note", "1", "phone"), ("odd name", "2", "email")]
    with pytest.raises(privacy.Leak):
        privacy.withheld_if_leaking(bad, "id")


def test_audit_finds_what_is_not_in_the_safe_space(spark, monkeypatch):
    safe = spark.range(20_000).select(F.lit("who").alias("column"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("value"))
    df = spark.range(5000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("who"), F.lit(None).cast("string").alias("n"))
    privacy.audit(df, ["who"], safe)
    for bits in (1 << 18, 64):  # a filter that is full tells nothing, and the space itself decides
        monkeypatch.setattr(privacy, "FILTER_BITS", bits)
        planted = df.unionByName(spark.createDataFrame([("Asha Rao", None)] * 3, "who string, n string"))
        assert [tuple(r) for r in privacy.outside_safe_space(planted, ["who", "n"], safe).collect()] == [("who", "Asha Rao", 3)]
        with pytest.raises(privacy.Leak):
            privacy.audit(planted, ["who"], safe)


def test_personal_columns_by_role_header_and_values(spark):
    df = spark.createDataFrame([("Asha", "x", f"98765432{k:02d}", "b") for k in range(30)], "`Student Name` string, `WhatsApp (Mother)` string, other string, branch string")
    got = privacy.personal_columns(df, {"name": "Student Name"}, discover=True)
    assert got == {"Student Name": "name", "WhatsApp (Mother)": "header", "other": "values"}
    assert privacy.mask_personal(df, got, "s").first().branch == "b"


def test_keys_are_widened_only_where_they_must(spark):
    rows = [(k // 2, f"d{k}", k) for k in range(100)] + [(0, "d0", 200), (None, None, 300), (None, None, 301)]
    df = spark.createDataFrame(rows, "receipt int, day string, line int")
    key, levels = clean.natural_key(df, {"receipt_id": "receipt", "receipt_date": "day"})
    assert key == ["receipt", "day"] and [r.n_groups for r in levels.orderBy("level").collect()] == [51, 101]
    assert clean.drop_repeats(df, key, "line").count() == 101 and clean.drop_repeats(df, [], "line").count() == len(rows)
    assert sorted(r.line for r in clean.drop_repeats(df, key, "line").where("receipt = 0 or receipt is null").collect()) == [0, 1, 300]
    assert clean.natural_key(df, {"receipt_id": "receipt", "student_id": "line"}, "finance")[0] == []
    same = spark.createDataFrame([(1, "a")] * 10, "receipt int, day string")
    assert clean.natural_key(same, {"receipt_id": "receipt", "receipt_date": "day"})[0] == []


def test_staff_and_the_unconditional(spark):
    df = spark.createDataFrame([(1, "not_coming", True), (2, "completed", True), (3, "not_to_entertain", False), (4, "not_to_entertain", None), (5, None, True)], "k int, s string, staff boolean").withColumns({"start": F.lit("2024-01-01").cast("date"), "duration_days": F.lit(30.0)})
    got = lambda **o: [r.churn_status for r in lifecycle.churn(df, "s", "start", F.lit("2024-03-01").cast("date"), **o).orderBy("k").collect()]
    assert got() == ["paused", "completed", "paused", "paused", "no_membership"]
    assert got(staff="staff", unconditional=True) == ["staff_alumni", "completed", "churned", "churned", "no_membership"]


def test_over_wide_records_with_quoted_newlines(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('a,b\n1,"two, with\nnewline and ""quotes"", too"\n2,x,over,wide\n"3,""q"",\n,",y,z\n4\n5,ok\n')
    rows, wide = readers.read_csv(spark, str(f))
    assert wide == 2 and rows.columns == ["a", "b"]
    assert sorted((r.a, r.b) for r in rows.na.fill("-").collect()) == [("1", 'two, with\nnewline and "quotes", too'), ("2", "x"), ('3,"q",\n,', "y"), ("4", "-"), ("5", "ok")]


def test_only_rates_are_quantified(spark):
    from tidewater.operators import decide

    found = spark.createDataFrame([("branch", "north", 100, 0.1, 0.3, -0.2, "risk"), ("branch", "south", 50, 0.6, 0.3, 0.3, "opportunity"), ("course", "art", 40, 0.34, 0.3, 0.04, "opportunity"), ("nobody", "x", 99, 0.1, 0.3, -0.2, "risk")], "dimension string, segment string, n long, scaled double, baseline double, gap double, kind string")
    plan = [(r.priority, r.action, r.segment, r.bucket, r.estimate) for r in decide.action_plan(found, "rate", questions=["why?", "why?"]).collect()]
    assert plan == [(1, "close_gap", "north", "P2", 20.0), (2, "scale_lever", "south", "P1", 15.0), (3, "investigate", "why?", "P4", None)]
    plain = decide.action_plan(found, "sum", backlog=True).collect()
    assert [(r.action, r.estimate, r.target, r.quick_win) for r in plain] == [("reduce_backlog", None, None, False), ("scale_lever", None, None, False)]
    assert decide.action_plan(found.limit(0), "rate").count() == 0


def test_cards_and_charts_of_parts(spark):
    from tidewater.operators import decide
    from tidewater.operators.metrics import METHODS, Metric, methodology

    head = spark.createDataFrame([(9, 1.0, 0.8, 1.2)], "n long, value double, ci_low double, ci_high double")
    assert tuple(decide.kpi_card(head).first()) == (1.0, None, "neutral", "medium")
    moved = spark.createDataFrame([(-0.1,)], "delta_pct double")
    assert decide.kpi_card(head, moved).first().status == "bad" and decide.kpi_card(head, moved, True).first().status == "good"
    one = spark.createDataFrame([("2024-01", 3.0)], "month string, value double")
    assert decide.chart_tables(head=head, monthly=one).select("chart").distinct().collect()[0][0] == "headline"
    assert all(methodology("x", Metric(k, "a", "b"), ["c"], 3).startswith("x computed as") for k in METHODS)


def test_group_quantiles_equal_percentiles(spark):
    from tidewater.operators import explore

    df = spark.range(3000).select((F.col("id") % 4).alias("k"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(500)) / 7).alias("v"), F.lit("x").alias("n")).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    for q in (0.0, 0.3, 0.5, 1.0):
        want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", q).alias("q")).collect()}
        for rows in (None, 100):
            got = {r.k: r.q for r in explore.group_quantile(df, ["k"], "v", q, rows).collect()}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert explore.group_quantile(df.where("v is null"), ["k"], "v").count() == 0


def test_kinds_from_sketches_are_the_exact_ones(spark):
    from tidewater.operators import roles

    df = spark.range(4000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), (F.col("id") % 50).cast("string").alias("fifty"), (F.col("id") % 51).cast("string").alias("more"), F.when(F.col("id") % 2 == 0, "").alias("blank"), F.concat(F.lit("9"), F.lpad((F.col("id") % 3810).cast("string"), 6, "0")).alias("serial"), (F.col("id") % 3810).alias("number"), F.lit(None).cast("string").alias("none"))
    text = [c for c in df.columns if c != "number"]
    want = {r["column"]: r.kind for r in roles.profile(df, text).collect()}
    got = {r["column"]: r.kind for r in roles.column_kinds(df, text).collect()}
    assert got == want and got["fifty"] == "numeric" and got["serial"] == "none"
    exact, sketched = ({r["column"]: r.kind for r in f(df).collect()} for f in (roles.infer_schema, roles.schema_kinds))
    assert exact == sketched and exact["number"] == "id"
    assert roles.column_kinds(df.limit(0), text).count() == 0
