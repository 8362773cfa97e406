import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import classify, clean, cross, decide, explore, flags, link, roles, stats
from tidewater.operators.metrics import Blocked, Metric, resolve_dimensions
from tidewater.plans import catalogue, derived


def test_exact_quantiles_equal_numpy(spark):
    r = np.random.default_rng(3)
    for n, hi in ((1, 5), (2, 5), (7, 3), (500, 20), (5000, 10**9)):
        v = r.integers(0, hi, n).astype(float)
        df = spark.createDataFrame([(float(x), None) for x in v], "x double, gone double")
        got = explore.exact_quantiles(df, ["x", "gone"], [0.0, 0.25, 0.5, 0.75, 1.0]).collect()
        assert [g["column"] for g in got] == ["x"]
        assert got[0]["q"] == pytest.approx(list(np.quantile(v, [0, 0.25, 0.5, 0.75, 1])), rel=1e-12)
    assert explore.exact_quantiles(df.limit(0), ["x"], [0.5]).count() == 0


def test_refusals(spark):
    df = spark.createDataFrame([("a", 1, None)], "k string, n int, d string")
    with pytest.raises(Blocked):
        clean.event_date(df, {"admission_date": "nowhere", "dob": "d"})
    with pytest.raises(Blocked):
        stats.survival_input(df, "k")
    with pytest.raises(Blocked):
        stats.survival_input(df, "n")
    with pytest.raises(Blocked):
        classify.terminal_labels(df)
    with pytest.raises(Blocked):
        cross.auto_cross(df, Metric("sum", "n"), {})
    with pytest.raises(Blocked):
        cross.auto_cross(df, Metric("rate", "n"), {"branch": "k", "course": "d"})
    with pytest.raises(Blocked):
        roles.generic_question(df)
    with pytest.raises(KeyError):
        flags.materialise(df, {}, ["unknown"])


def test_role_planning(spark):
    plan = {x["source"]: x.asDict() for x in roles.join_plan(spark, {"fees": ["student_id", "paid"], "students": ["student_id", "name"], "enquiries": ["name"], "weather": ["rain"]}).collect()}
    assert plan["students"]["role"] == "master" and (plan["fees"]["on"], plan["fees"]["confidence"]) == ("student_id", "high")
    assert (plan["enquiries"]["on"], plan["enquiries"]["confidence"]) == ("name", "medium") and plan["weather"]["role"] == "none"
    have = roles.role_sources({"x__Not_Coming": {"name": "n"}, "fees": {"receipt_date": "d", "paid": "p"}})
    assert have["date_any"] == ["fees"] and have["completion_source"] == ["x__Not_Coming"]
    asked = [("default_rate", ["branch", "tutor"]), ("churn_rate", ["branch"]), ("total_leads", [])]
    assert roles.adapt(asked, ["is_default", "branch"]) == [("default_rate", ["branch"], "partial"), ("total_leads", [], "full")]
    q = [("BQ-001", "churn_rate", ["branch"]), ("BQ-002", "default_rate", ["branch"]), ("BQ-003", "default_rate", ["branch"])]
    assert [x[0] for x in roles.prune_questions(q, ["is_default"])] == ["BQ-002", "BQ-001"]
    assert roles.reporting_column("course", {"course": "c"}, ["c", "course_category_derived"]) == "course_category_derived"
    assert roles.reporting_column("course", {"course": "c"}, ["c", "course", "course_category_derived"]) == "course"
    assert resolve_dimensions(["a", "b", "c"], {"a": "x", "b": "x"}, ["x", "c"]) == ["x", "c"]


def test_samples_are_masked(spark):
    df = spark.createDataFrame([("Asha", "call 98765 43210 or a@b.co", None)], "`Student Name` string, Notes string, Email string")
    r = flags.sanitise(df).first()
    assert r[0] == "[masked]" and r[2] is None and "98765" not in r[1] and "@" not in r[1]


def test_coverage_and_master(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "a"), (1, "a")], "p int, c string")
    right = spark.createDataFrame([(1, "a"), (2, "x"), (2, "y")], "p int, c string")
    assert {x["coverage"]: x["n"] for x in link.coverage(left, right, "p", "c").collect()} == {"matched": 2, "other_course": 1, "absent": 1, "no_person": 1}
    a = spark.createDataFrame([(1, None, "active"), (1, "n", "completed")], "id int, name string, completion_status string")
    b = spark.createDataFrame([(1, "late"), (2, "only")], "key int, name string")
    got = {x["id"]: (x["found_in"], x["name"], x["completion_status"]) for x in link.master({"a": (a, "id"), "b": (b, "key")}, ["name"]).collect()}
    assert got == {1: ("a,b", "n", "completed"), 2: ("b", "only", "Unknown")}


def test_health(spark):
    c = spark.createDataFrame([(-0.2, True, -5.0, 20.0, 25.0)], "delta_pct double, significant boolean, delta_abs double, current double, prior double")
    found = spark.createDataFrame([("risk", "high", 1.0, 2.0), ("opportunity", "low", 3.0, 2.0)], "kind string, severity string, scaled double, baseline double")
    assert tuple(decide.business_health(c, found).first()) == (45, "concerning")
    assert tuple(decide.business_health(c, found, lower_is_better=True).first()) == (80, "good")
    assert tuple(decide.business_health(c, found, lower_is_better=True, quality=40.0).first()) == (80, "stable")
    assert decide.trend_alerts(c, "m").count() == 1 and decide.trend_alerts(c, "m", lower_is_better=True).count() == 0
    none = spark.createDataFrame([], "cramers_v double")
    assert decide.confidence_score(c, none).first()[0] == 70


def test_window_bounds(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-31 23:59:59",), ("2024-02-01 00:00:00",), (None,)], "d string").select(F.col("d").cast("timestamp").alias("d"))
    rows, told = clean.time_window(df, "d", "2024-01-01", "2024-01-31")
    assert rows.count() == 2 and tuple(told.first()) == (4, 2)


def test_queries_are_listed_without_a_session():
    import pathlib
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_tail_at_any_z():
    zs = [k / 4 for k in range(-150, 151)]
    got = duckdb.sql(f"SELECT {derived._TAIL} FROM (SELECT unnest({zs}::DOUBLE[]) AS z)").fetchall()
    assert [p for (p,) in got] == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], rel=1e-9, abs=0)
    assert duckdb.sql(f"SELECT {derived._TAIL} FROM (SELECT NULL::DOUBLE AS z)").fetchall() == [(None,)]


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    """Orders of which one cell nearly always has the planted flag: a z over 20 from few rows."""
    d = str(tmp_path_factory.mktemp("planted"))
    con = duckdb.connect()
    segments, priorities = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    con.execute(f"CREATE TABLE customer AS SELECT i AS c_custkey, 'c' || i AS c_name, ({segments})[i % 5 + 1] AS c_mktsegment FROM range(25) r(i)")
    con.execute(f"CREATE TABLE orders AS SELECT CASE WHEN i % 25 = 1 AND i % 100 > 1 THEN 10 * i + 3 ELSE 10 * i + i // 25 % 10 END AS o_orderkey, i % 25 AS o_custkey, ({priorities})[i % 25 // 5 + 1] AS o_orderpriority, 'F' AS o_orderstatus FROM range(5000) r(i)")
    for t in ("customer", "orders"):
        con.execute(f"COPY {t} TO '{d}/{t}.parquet'")
    return d, con


def test_interactions_equal_their_sql_where_z_is_large(spark, planted):
    d, con = planted
    got = sorted(tuple(r) for r in derived.k4_interactions(spark, d).collect())
    assert max(r[3] for r in got) > 20 and [r[:2] for r in got if r[5]] == [("BUILDING", "1-URGENT")]
    assert got == sorted(con.execute(catalogue.ORACLE["k4_interactions"]).fetchall())


def test_notes_equal_their_sql_where_z_is_large(spark, planted):
    d, con = planted
    got = sorted(tuple(r) for r in derived.k8_notes(spark, d).collect())
    assert ("planted", "interactions") not in [r[:2] for r in got]
    assert got == sorted(con.execute(catalogue.ORACLE["k8_notes"]).fetchall())
