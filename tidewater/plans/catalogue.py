"""Registered queries of the analytics operators over the given tables, each with the SQL that must agree with it.

Doubles are rounded in both, as sums in another order differ in their last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import canon
from tidewater.operators import classify, clean, cross, decide, explore, flags, lifecycle, link, roles, stats
from tidewater.operators.metrics import Metric, breakdown, compare_periods, domain_metrics, drivers, headline
from tidewater.streaming import alerts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").withColumn("done", F.col("o_orderstatus") == "F")


def _orders_customers(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))


_Z = "1.959963984540054"
_WILSON = f"greatest(0.0, (p + {_Z}*{_Z}/(2*n))/(1 + {_Z}*{_Z}/n) - {_Z}*sqrt(p*(1-p)/n + {_Z}*{_Z}/(4*n*n))/(1 + {_Z}*{_Z}/n))", f"least(1.0, (p + {_Z}*{_Z}/(2*n))/(1 + {_Z}*{_Z}/n) + {_Z}*sqrt(p*(1-p)/n + {_Z}*{_Z}/(4*n*n))/(1 + {_Z}*{_Z}/n))"
#: P(|Z| > |z|) as a series of positive terms.
_TWO_SIDED = "CASE WHEN z IS NULL THEN NULL WHEN z = 0 THEN 1.0 ELSE greatest(0.0, 1 - 2/sqrt(pi()) * exp(-z*z/2) * list_sum(list_transform(range(0, 160), lambda k: exp(2*k*ln(2) + (2*k+1)*ln(abs(z)/sqrt(2)) + lgamma(k+1) - lgamma(2*k+2))))) END"
_OC = "(SELECT *, (o_orderstatus = 'F') AS done FROM orders JOIN customer ON o_custkey = c_custkey)"


# Metrics ---------------------------------------------------------------------------------------------------------


@query(f"""WITH a AS (SELECT count(*) AS n, avg((o_orderstatus = 'F')::INT) AS p FROM orders)
SELECT n, round(p, 6) AS value, round({_WILSON[0]}, 6) AS ci_low, round({_WILSON[1]}, 6) AS ci_high FROM a""")
def j2_rate(spark, d):
    return _rounded(headline(_orders(spark, d), Metric("rate", "done")))


@query(f"""WITH a AS (SELECT count(*) AS n, sum(o_totalprice) AS s, var_samp(o_totalprice) AS v FROM orders)
SELECT n, round(s, 2) AS value, round(s - {_Z}*sqrt(v*n), 2) AS ci_low, round(s + {_Z}*sqrt(v*n), 2) AS ci_high FROM a""")
def j2_sum(spark, d):
    return _rounded(headline(_orders(spark, d), Metric("sum", "o_totalprice")), 2)


@query(f"""WITH a AS (SELECT count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem)
SELECT n, round(m, 6) AS value, round(m - {_Z}*sqrt(v/n), 6) AS ci_low, round(m + {_Z}*sqrt(v/n), 6) AS ci_high FROM a""")
def j2_mean(spark, d):
    return _rounded(headline(_t(spark, d, "lineitem"), Metric("mean", "l_quantity")))


@query(f"""WITH a AS (SELECT l_extendedprice*(1-l_discount) AS y, l_extendedprice AS x FROM lineitem), b AS (SELECT sum(y)/sum(x) AS r, count(*) AS n, sum(x) AS sx FROM a),
c AS (SELECT r, n, sx, sqrt(n::DOUBLE/(n-1) * sum((y - r*x)*(y - r*x)))/abs(sx) AS se FROM a, b GROUP BY r, n, sx)
SELECT n, round(r, 6) AS value, round(greatest(0.0, r - {_Z}*se), 6) AS ci_low, round(r + {_Z}*se, 6) AS ci_high FROM c""")
def j2_ratio(spark, d):
    df = _t(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return _rounded(headline(df, Metric("ratio", "net", "l_extendedprice")))


@query(f"SELECT count(*) AS n, count(*)::DOUBLE AS value, round(greatest(0.0, count(*) - {_Z}*sqrt(count(*))), 6) AS ci_low, round(count(*) + {_Z}*sqrt(count(*)), 6) AS ci_high FROM events")
def j2_count(spark, d):
    return _rounded(headline(_t(spark, d, "events"), Metric("count")))


_BREAK = f"""WITH oc AS {_OC}, l AS (SELECT 'o_orderpriority' AS dimension, o_orderpriority AS segment, done FROM oc UNION ALL SELECT 'c_mktsegment', c_mktsegment, done FROM oc),
b AS (SELECT avg(done::INT) AS baseline FROM oc), g AS (SELECT dimension, segment, count(*) AS n, avg(done::INT) AS p FROM l GROUP BY ALL)"""


@query(f"""{_BREAK} SELECT dimension, segment, n, round(p, 6) AS value, round({_WILSON[0]}, 6) AS ci_low, round({_WILSON[1]}, 6) AS ci_high, round(baseline, 6) AS baseline, round(p - baseline, 6) AS delta, n < 30 AS low_confidence FROM g, b""")
def j3_breakdown(spark, d):
    return _rounded(breakdown(_orders_customers(spark, d), Metric("rate", "done"), ["o_orderpriority", "c_mktsegment"]))


@query("""WITH t AS (SELECT max(o_orderdate) AS t FROM orders), p AS (SELECT CASE WHEN o_orderdate > t - INTERVAL 3 MONTH THEN 'c' WHEN o_orderdate > t - INTERVAL 6 MONTH THEN 'p' END AS k, o_totalprice AS y FROM orders, t),
g AS (SELECT count(*) FILTER (k = 'c') AS cn, count(*) FILTER (k = 'p') AS pn, avg(y) FILTER (k = 'c') AS c, avg(y) FILTER (k = 'p') AS p, var_samp(y) FILTER (k = 'c') AS cv, var_samp(y) FILTER (k = 'p') AS pv FROM p)
SELECT cn AS current_n, pn AS prior_n, round(c, 4) AS current, round(p, 4) AS prior, round(c - p, 4) AS delta_abs, round((c - p)/abs(p), 4) AS delta_pct, round((c - p)/sqrt(cv/cn + pv/pn), 4) AS z, abs((c - p)/sqrt(cv/cn + pv/pn)) >= 1.96 AS significant FROM g""")
def j5_compare(spark, d):
    return _rounded(compare_periods(_orders(spark, d), Metric("mean", "o_totalprice"), "o_orderdate", 3), 4)


@query(f"""{_BREAK} SELECT dimension, segment, n, round(p, 6) AS value, round((p - baseline) * n / sum(n) OVER (PARTITION BY dimension), 6) AS contribution FROM g, b
ORDER BY abs((p - baseline) * n / sum(n) OVER (PARTITION BY dimension)) DESC, dimension, segment LIMIT 5""")
def j7_drivers(spark, d):
    return _rounded(drivers(_orders_customers(spark, d), Metric("rate", "done"), ["o_orderpriority", "c_mktsegment"]))


@query("SELECT l_returnflag, count(*) AS n_rows, round(sum(l_extendedprice), 2) AS total_fees, round(sum(l_tax), 2) AS total_pending, count(*) FILTER (l_tax <= 0) AS fully_paid FROM lineitem GROUP BY 1")
def j9_domains(spark, d):
    return _rounded(domain_metrics(_t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "l_tax"), 2)


# Statistics ------------------------------------------------------------------------------------------------------

_SEG = f"""WITH g AS (SELECT c_mktsegment AS segment, count(*) AS n, sum(done::INT)::BIGINT AS x FROM {_OC} GROUP BY 1), a AS (SELECT *, x/n AS p, sum(n) OVER () AS an, sum(x) OVER () AS ax FROM g),
z AS (SELECT *, x/n - (ax-x)/(an-n) AS diff, (x/n - (ax-x)/(an-n)) / sqrt(ax/an*(1-ax/an)*(1/n + 1/(an-n))) AS z FROM a),
q AS (SELECT *, {_TWO_SIDED} AS pv FROM z), r AS (SELECT *, row_number() OVER (ORDER BY pv) AS k, count(*) OVER () AS m FROM q)"""


@query(f"""{_SEG} SELECT segment, n, x, round(p, 6) AS rate, round({_WILSON[0]}, 6) AS ci_low, round({_WILSON[1]}, 6) AS ci_high, round(ax/an, 6) AS overall, round(diff, 6) AS diff, round(z, 6) AS z, true AS tested, round(pv, 6) AS p,
round(least(1.0, min(pv*m/k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q, least(1.0, min(pv*m/k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) <= 0.05 AS significant FROM r""")
def m7_segments(spark, d):
    return _rounded(stats.segments_vs_rest(_orders_customers(spark, d), "c_mktsegment", "done"))


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY ALL), m AS (SELECT *, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS k, sum(o) OVER () AS n FROM c),
s AS (SELECT sum(o*o*n/(r*k)) - max(n) AS chi2, max(n)::BIGINT AS n, count(DISTINCT a) AS nr, count(DISTINCT b) AS nc, count(*) FILTER (r*k < 5*n) AS low FROM m)
SELECT round(chi2, 4) AS chi2, ((nr-1)*(nc-1))::BIGINT AS dof, n, low AS low_expected, low = 0 AS valid, round(sqrt(chi2/(n*least(nr-1, nc-1))), 6) AS cramers_v, round(CASE WHEN low = 0 THEN exp(-chi2/2) * list_sum(list_transform(range(0, (nr-1)*(nc-1) // 2), lambda i: exp(i*ln(chi2/2) - lgamma(i+1)))) END, 6) AS p FROM s""")
def m5_independence(spark, d):
    counts = _orders(spark, d).groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("k"))
    out = stats.chi2_independence(counts, "o_orderstatus", "o_orderpriority", "k")
    return out.select(F.round("chi2", 4).alias("chi2"), "dof", "n", "low_expected", "valid", F.round("cramers_v", 6).alias("cramers_v"), F.round("p", 6).alias("p"))


@query("""WITH l AS (SELECT datediff('day', o_orderdate, l_shipdate) AS t, (l_linestatus = 'F')::INT AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate),
g AS (SELECT t, count(*) AS n, sum(e)::BIGINT AS deaths FROM l GROUP BY 1), r AS (SELECT *, (sum(n) OVER () - sum(n) OVER (ORDER BY t) + n)::BIGINT AS at_risk FROM g),
s AS (SELECT t, at_risk, deaths, CASE WHEN deaths = at_risk THEN 0.0 ELSE exp(sum(CASE WHEN deaths < at_risk THEN ln(1 - deaths/at_risk) ELSE 0 END) OVER (ORDER BY t)) END AS s FROM r WHERE deaths > 0)
SELECT t::BIGINT AS time, at_risk, deaths, round(s, 6) AS survival FROM s""")
def m8_survival(spark, d):
    j = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate").withColumn("days", F.datediff("l_shipdate", "o_orderdate").cast("long"))
    return _rounded(stats.kaplan_meier(j, "days", F.col("l_linestatus") == "F"))


_MONTHS = "(SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*)::DOUBLE AS y FROM orders GROUP BY 1)"


@query(f"""WITH s AS (SELECT row_number() OVER (ORDER BY month) - 1 AS i, y FROM {_MONTHS}), p AS (SELECT sum(sign(b.y - a.y))::DOUBLE AS s FROM s a JOIN s b ON a.i < b.i),
t AS (SELECT sum(c*(c-1)*(2*c+5)) AS t FROM (SELECT count(*) AS c FROM s GROUP BY y)), n AS (SELECT count(*) AS n FROM s), v AS (SELECT n, s, (n*(n-1)*(2*n+5) - t)/18 AS var_s FROM p, t, n),
z AS (SELECT *, CASE WHEN s > 0 THEN (s-1)/sqrt(var_s) WHEN s < 0 THEN (s+1)/sqrt(var_s) ELSE 0.0 END AS z FROM v), q AS (SELECT *, {_TWO_SIDED} AS p FROM z)
SELECT n, s, round(var_s, 4) AS var_s, round(z, 6) AS z, round(p, 6) AS p, CASE WHEN n < 4 THEN 'insufficient' WHEN p <= 0.05 AND s > 0 THEN 'rising' WHEN p <= 0.05 AND s < 0 THEN 'falling' ELSE 'flat' END AS trend FROM q""")
def m10_mann_kendall(spark, d):
    out = stats.mann_kendall(stats.monthly_series(_orders(spark, d), "o_orderdate"), "month", "value")
    return _rounded(out.withColumn("var_s", F.round("var_s", 4)))


@query(f"""WITH s AS (SELECT row_number() OVER (ORDER BY month) - 1 AS i, y FROM {_MONTHS}), m AS (SELECT quantile_cont((b.y - a.y)/(b.i - a.i), 0.5) AS slope FROM s a JOIN s b ON a.i < b.i)
SELECT round(slope, 6) AS slope, round(quantile_cont(y - slope*i, 0.5), 6) AS intercept FROM s, m GROUP BY slope""")
def m11_theil_sen(spark, d):
    return _rounded(stats.theil_sen(stats.monthly_series(_orders(spark, d), "o_orderdate"), "month", "value"))


@query(f"""WITH g AS (SELECT strftime(o_orderdate, '%Y-%m') AS cohort, count(*) AS n, sum((o_orderstatus = 'F')::INT)::BIGINT AS x FROM orders GROUP BY 1), h AS (SELECT *, x/n AS p FROM g)
SELECT cohort, n, x, round(p, 6) AS rate, round({_WILSON[0]}, 6) AS ci_low, round({_WILSON[1]}, 6) AS ci_high, n < 30 AS underpowered FROM h""")
def m12_cohorts(spark, d):
    return _rounded(stats.cohort_rates(_orders(spark, d).withColumn("cohort", F.date_format("o_orderdate", "yyyy-MM")), "cohort", "done"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1")
def m13_series(spark, d):
    return _rounded(stats.monthly_series(_orders(spark, d), "o_orderdate", "o_totalprice"), 4)


@query(f"""WITH oc AS {_OC}, g AS (SELECT c_mktsegment AS r, o_orderpriority AS k, count(*) AS n, avg(done::INT) AS p, grouping(c_mktsegment, o_orderpriority) AS g FROM oc GROUP BY GROUPING SETS ((), (c_mktsegment), (o_orderpriority), (c_mktsegment, o_orderpriority))),
c AS (SELECT *, {_WILSON[0]} AS lo, {_WILSON[1]} AS hi, g = 0 AND n < 30 AS hidden, CASE WHEN g = 0 THEN (SELECT p FROM g x WHERE g = 1 AND x.r = g.r) + (SELECT p FROM g x WHERE g = 2 AND x.k = g.k) - (SELECT p FROM g WHERE g = 3) END AS e FROM g)
SELECT CASE g WHEN 0 THEN 'cell' WHEN 1 THEN 'row' WHEN 2 THEN 'column' ELSE 'overall' END AS level, r AS "row", k AS col, n, round(CASE WHEN NOT hidden THEN p END, 6) AS value, round(CASE WHEN NOT hidden THEN lo END, 6) AS ci_low, round(CASE WHEN NOT hidden THEN hi END, 6) AS ci_high,
round(CASE WHEN NOT hidden THEN e END, 6) AS expected, round(CASE WHEN NOT hidden THEN p - e END, 6) AS residual, hidden AS suppressed FROM c""")
def k1_cross(spark, d):
    out = cross.crosstab(_orders_customers(spark, d), Metric("rate", "done"), "c_mktsegment", "o_orderpriority")
    return _rounded(out.select("level", "row", "col", "n", "value", "ci_low", "ci_high", "expected", "residual", "suppressed"))


@query("""WITH f AS (SELECT *, o_orderpriority = '1-URGENT' AS a, o_totalprice > 100000 AS b, o_orderstatus NOT IN ('P') AS c FROM orders)
SELECT 'o_orderpriority = 1-urgent' AS filter, true AS known, count(*) AS rows_before, count(*) FILTER (a) AS rows_after FROM f UNION ALL
SELECT 'o_totalprice > 100000', true, count(*) FILTER (a), count(*) FILTER (a AND b) FROM f UNION ALL
SELECT 'o_orderstatus not in P', true, count(*) FILTER (a AND b), count(*) FILTER (a AND b AND c) FROM f UNION ALL SELECT 'nowhere = 1', false, count(*) FILTER (a AND b AND c), count(*) FILTER (a AND b AND c) FROM f""")
def c18_filters(spark, d):
    return cross.apply_filters(_orders(spark, d), ["o_orderpriority = 1-urgent", "o_totalprice > 100000", "o_orderstatus not in P", "nowhere = 1"])[1]


# Exploration -----------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT 'o_orderstatus' AS dimension, o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders), g AS (SELECT dimension, v, count(*) AS n FROM l GROUP BY ALL),
p AS (SELECT *, n/sum(n) OVER (PARTITION BY dimension) AS p FROM g)
SELECT dimension, count(*) AS n_distinct, arg_max(v, (n, -row)) AS mode, round(-sum(p*log2(p)), 6) AS entropy, 0.0 AS null_rate FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY v) AS row FROM p) GROUP BY 1""")
def e1_categories(spark, d):
    return _rounded(explore.categorical_profile(_orders(spark, d), ["o_orderstatus", "o_orderpriority"]))


@query("""WITH g AS (SELECT 'p_brand' AS dimension, p_brand AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL), r AS (SELECT *, n/sum(n) OVER (PARTITION BY dimension) AS pct, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS r FROM g)
SELECT dimension, value, n, round(pct, 6) AS pct FROM r WHERE r <= 10""")
def e1_top_values(spark, d):
    return _rounded(explore.top_values(_t(spark, d, "part"), ["p_brand", "p_type"]))


@query("""SELECT 'l_extendedprice' AS "column", count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(stddev_samp(l_extendedprice), 4) AS sd, round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr, round(skewness(l_extendedprice), 4) AS skew, round(kurtosis(l_extendedprice), 4) AS kurtosis FROM lineitem
UNION ALL SELECT 'l_quantity', count(*), round(avg(l_quantity), 4), round(median(l_quantity), 4), round(stddev_samp(l_quantity), 4), round(min(l_quantity), 4), round(max(l_quantity), 4), round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 4), round(skewness(l_quantity), 4), round(kurtosis(l_quantity), 4) FROM lineitem""")
def e2_numbers(spark, d):
    return _rounded(explore.numeric_profile(_t(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"]), 4)


@query("""SELECT 'month' AS grain, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'quarter', year(o_orderdate)::VARCHAR || '-Q' || quarter(o_orderdate)::VARCHAR, count(*) FROM orders GROUP BY ALL
UNION ALL SELECT 'weekday', (isodow(o_orderdate) - 1)::VARCHAR, count(*) FROM orders GROUP BY ALL""")
def e3_periods(spark, d):
    return explore.time_profile(_orders(spark, d), "o_orderdate")


@query(f"""WITH s AS (SELECT y, row_number() OVER (ORDER BY month) AS i, count(*) OVER () AS n FROM {_MONTHS}), h AS (SELECT max(n) AS n, avg(y) FILTER (i <= floor(n/2)) AS f, avg(y) FILTER (i > floor(n/2)) AS s FROM s)
SELECT n, round(f, 6) AS "first", round(s, 6) AS second, CASE WHEN n < 4 THEN 'insufficient' WHEN (s-f)/abs(f) > 0.1 THEN 'rising' WHEN (s-f)/abs(f) < -0.1 THEN 'falling' ELSE 'stable' END AS direction FROM h""")
def e4_direction(spark, d):
    return _rounded(explore.trend_direction(stats.monthly_series(_orders(spark, d), "o_orderdate"), "month", "value"))


@query(f"""WITH s AS (SELECT month, y AS value, CASE WHEN count(*) OVER w = 3 THEN avg(y) OVER w END AS baseline FROM {_MONTHS} WINDOW w AS (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT month, value, round(baseline, 6) AS baseline, round((value - baseline)/baseline, 6) AS change, CASE WHEN value > baseline THEN 'spike' ELSE 'dip' END AS kind FROM s WHERE abs((value - baseline)/baseline) >= 0.1""")
def e6_spikes(spark, d):
    return _rounded(explore.spikes(stats.monthly_series(_orders(spark, d), "o_orderdate"), "month", "value", least=0.1))


@query("""WITH b AS (SELECT count(*) AS n, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders), c AS (SELECT n, q1 - 1.5*(q3-q1) AS low, q3 + 1.5*(q3-q1) AS high FROM b)
SELECT n, round(low, 4) AS low, round(high, 4) AS high, count(*) FILTER (o_totalprice < low OR o_totalprice > high) AS outliers, round(count(*) FILTER (o_totalprice < low OR o_totalprice > high)/n, 4) AS pct FROM orders, c GROUP BY n, low, high""")
def e7_outliers(spark, d):
    return _rounded(explore.iqr_outliers(_orders(spark, d), "o_totalprice"), 4)


@query("""WITH l AS (SELECT 'o_orderstatus' AS dim_a, 'o_orderpriority' AS dim_b, o_orderstatus AS a, o_orderpriority AS b FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'o_orderstatus', 'c_mktsegment', o_orderstatus, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'o_orderpriority', 'c_mktsegment', o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey), c AS (SELECT dim_a, dim_b, a, b, count(*) AS o FROM l GROUP BY ALL),
m AS (SELECT *, sum(o) OVER (PARTITION BY dim_a, dim_b, a) * sum(o) OVER (PARTITION BY dim_a, dim_b, b) / sum(o) OVER (PARTITION BY dim_a, dim_b) AS e, sum(o) OVER (PARTITION BY dim_a, dim_b) AS n FROM c),
g AS (SELECT dim_a, dim_b, max(n)::BIGINT AS n, sum(o*o/e) - max(n) AS chi2, count(DISTINCT a) AS nr, count(DISTINCT b) AS nc, arg_min({'a': a, 'b': b, 'r': (o-e)/sqrt(e)}, (-abs((o-e)/sqrt(e)), a, b)) AS t FROM m GROUP BY ALL)
SELECT dim_a, dim_b, n, round(chi2, 4) AS chi2, ((nr-1)*(nc-1))::BIGINT AS dof, round(sqrt(chi2/(n*least(nr-1, nc-1))), 4) AS cramers_v, CASE WHEN sqrt(chi2/(n*least(nr-1, nc-1))) < 0.1 THEN 'weak' WHEN sqrt(chi2/(n*least(nr-1, nc-1))) < 0.3 THEN 'moderate' ELSE 'strong' END AS strength, t.a AS cell_a, t.b AS cell_b, round(t.r, 4) AS residual FROM g""")
def e5_associations(spark, d):
    out = explore.associations(_orders_customers(spark, d), ["o_orderstatus", "o_orderpriority", "c_mktsegment"])
    return _rounded(out.select("dim_a", "dim_b", "n", "chi2", "dof", "cramers_v", "strength", "cell_a", "cell_b", "residual"), 4)


# Cleaning and canonical values -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d1, strftime(o_orderdate, '%Y-%m-%d') AS d2 FROM orders WHERE day(o_orderdate) <> 0")
def c5_dates(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "d/M/yyyy").alias("dmy"), F.date_format("o_orderdate", "M-d-yyyy").alias("mdy"))
    day_first = clean.date_votes(o, ["dmy", "mdy"])
    return o.select("o_orderkey", *[F.date_format(clean.parse_date(F.col(c), day_first[c]), "yyyy-MM-dd").alias(a) for a, c in (("d1", "dmy"), ("d2", "mdy"))])


@query("SELECT c_custkey, greatest(round(c_acctbal, 2), 0.0) AS amount, round(c_acctbal, 2) AS pending FROM customer")
def c7_money(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.concat(F.lit("₹ "), F.format_number("c_acctbal", 2)).alias("m"))
    return c.select("c_custkey", clean.money(F.col("m")).alias("amount"), clean.money(F.col("m"), floor=False).alias("pending"))


@query("SELECT p_partkey, regexp_split_to_array(trim(regexp_replace(p_name, ' +', ' ', 'g')), ' ')[1] AS first_word, len(regexp_split_to_array(trim(regexp_replace(p_name, ' +', ' ', 'g')), ' '))::INT AS n FROM part")
def c11_values(spark, d):
    v = clean.multi_values(F.col("p_name"), " +")
    return _t(spark, d, "part").select("p_partkey", F.get(v, F.lit(0)).alias("first_word"), F.size(v).alias("n"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS \"year\", month(o_orderdate)::INT AS \"month\", strftime(o_orderdate, '%b') AS month_name, 'Q' || quarter(o_orderdate)::VARCHAR || '-' || year(o_orderdate)::VARCHAR AS quarter, week(o_orderdate)::INT AS iso_week, dayname(o_orderdate) AS day_name, isodow(o_orderdate) >= 6 AS is_weekend FROM orders")
def c13_time(spark, d):
    return clean.time_dimensions(_t(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL")
def c16_dedupe(spark, d):
    out = clean.dedupe(_t(spark, d, "lineitem"), [["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]], "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 12) GROUP BY 1")
def c19_levels(spark, d):
    return cross.trim_levels(_t(spark, d, "part"), "p_brand").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, nullif(lower(trim(p_type)), '') AS kind, CASE WHEN p_type IS NULL THEN NULL ELSE lower(trim(p_type)) || '|' || lower(trim(p_brand)) END AS key FROM part")
def t13_keys(spark, d):
    return _t(spark, d, "part").select("p_partkey", canon.categorical(F.col("p_type")).alias("kind"), canon.composite_key(F.col("p_type"), F.col("p_brand")).alias("key"))


@query("SELECT conv_id, turn, regexp_matches(lower(text), 'refund') AS refund, CASE WHEN regexp_matches(lower(text), 'razorpay|\\bemi\\b|bajaj') THEN 'emi' WHEN regexp_matches(lower(text), 'cheque|\\bchq\\b|check\\s*no') THEN 'cheque' WHEN regexp_matches(lower(text), '\\bupi\\b|gpay|google\\s*pay|phonepe|paytm') THEN 'upi' WHEN regexp_matches(lower(text), 'icici|hdfc|\\bsbi\\b|axis|kotak|neft|imps|rtgs|\\bbank\\b') THEN 'bank_transfer' WHEN regexp_matches(lower(text), '\\bcash\\b') THEN 'cash' END AS channel FROM conversations".replace("\\\\", "\\"))
def t10_channels(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", canon.is_refund(F.col("text")).alias("refund"), canon.payment_channel(F.col("text")).alias("channel"))


# Flags, privacy, lifecycle ---------------------------------------------------------------------------------------


@query("SELECT c_custkey, round(greatest(10000 - coalesce(c_acctbal, 0), 0), 2) AS collected, coalesce(c_acctbal, 0) > 0 AS is_default FROM customer")
def d1_amounts(spark, d):
    return _t(spark, d, "customer").select("c_custkey", F.round(flags.amount_collected(F.lit(10000.0), F.col("c_acctbal")), 2).alias("collected"), flags.is_default(F.col("c_acctbal")).alias("is_default"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) > 1 AS is_duplicate_certificate FROM orders")
def d5_serials(spark, d):
    return flags.duplicate_serials(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "is_duplicate_certificate")


@query("SELECT o_orderkey, datediff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) > 30 AND o_orderstatus <> 'F' AS backlog FROM orders")
def d6_backlog(spark, d):
    o = _t(spark, d, "orders").withColumn("admitted", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    return flags.enquiry_backlog(o, "o_orderdate", "admitted").select("o_orderkey", F.col("is_enquiry_backlog").alias("backlog"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS person_enrollment_count, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS person_admission_seq FROM orders")
def d13_persons(spark, d):
    return flags.person_rows(_t(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "person_enrollment_count", "person_admission_seq")


@query("SELECT c_custkey, substr(sha256('s:' || c_name), 1, 16) AS masked, substr(sha256('s:' || trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) || '|||'), 1, 16) AS person FROM customer")
def d11_identity(spark, d):
    none = F.lit(None).cast("string")
    return _t(spark, d, "customer").select("c_custkey", flags.mask(F.col("c_name"), "s").alias("masked"), flags.person_id(F.col("c_name"), none, none, none, "s").alias("person"))


@query(r"""SELECT 'text' AS "column", doc_id::VARCHAR AS row_id, 'phone' AS kind FROM documents WHERE regexp_matches(text, '\+?\d(?:[\s().\-]{0,3}\d){9,14}') UNION ALL SELECT 'text', doc_id::VARCHAR, 'email' FROM documents WHERE regexp_matches(text, '[\w.\-+]+@[\w\-]+\.[\w.\-]+')""")
def i3_leaks(spark, d):
    return flags.leaks(_t(spark, d, "documents").select("doc_id", "text"), "doc_id")


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[\w.\-+]+@[\w\-]+\.[\w.\-]+', '[email]', 'g'), '\+?\d(?:[\s().\-]{0,3}\d){9,14}', '[mobile]', 'g')) AS scrubbed FROM documents")
def i2_scrub(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(flags.scrub(F.col("text")), 256).alias("scrubbed"))


def _enrolments(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "active").otherwise("not_coming")
    days = F.when(F.pmod("o_orderkey", F.lit(3)) > 0, F.pmod("o_orderkey", F.lit(360)) + 1)
    return o.select("o_orderkey", "o_orderdate", "o_orderpriority", status.alias("status"), days.alias("days"))


_ENROL = """e AS (SELECT o_orderkey, o_orderdate, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'not_coming' END AS status, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 360 + 1 END AS days FROM orders),
m AS (SELECT o_orderpriority, median(days) AS med FROM e GROUP BY 1), r AS (SELECT e.*, coalesce(days::DOUBLE, med) AS dur, CASE WHEN days IS NOT NULL THEN 'own' ELSE 'course_median' END AS basis, (SELECT max(o_orderdate) FROM orders) AS t FROM e JOIN m USING (o_orderpriority)),
s AS (SELECT *, o_orderdate + to_days(floor(dur)::INT) + INTERVAL 6 MONTH AS dl FROM r), c AS (SELECT *, CASE WHEN status IN ('completed', 'active') THEN status WHEN t >= dl THEN 'churned' ELSE 'paused' END AS churn_status FROM s)"""


def _churn(spark: SparkSession, d: str) -> DataFrame:
    e = lifecycle.resolve_duration(_enrolments(spark, d), "days", "o_orderpriority")
    e = e.join(F.broadcast(lifecycle.as_of(e, ["o_orderdate"])))
    return lifecycle.churn(e, "status", "o_orderdate", F.col("as_of"))


@query(f"WITH {_ENROL} SELECT o_orderkey, dur AS duration_days, basis AS duration_basis, churn_status, CASE churn_status WHEN 'churned' THEN true ELSE false END AS is_churn, datediff('day', o_orderdate, CASE churn_status WHEN 'churned' THEN dl ELSE t END)::BIGINT AS tenure_days FROM c")
def l4_churn(spark, d):
    return _churn(spark, d).select("o_orderkey", "duration_days", "duration_basis", "churn_status", "is_churn", "tenure_days")


@query(f"WITH {_ENROL} SELECT churn_status, count(*) AS n, round((SELECT count(*) FILTER (churn_status = 'churned') / count(*) FILTER (churn_status IN ('churned', 'paused')) FROM c), 6) AS churn_rate FROM c GROUP BY 1")
def l7_summary(spark, d):
    return _rounded(lifecycle.churn_summary(_churn(spark, d)))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'Overpaid' WHEN c_acctbal <= 0 THEN 'Nil' WHEN c_acctbal BETWEEN 0.01 AND 5000 THEN '1-5000' WHEN c_acctbal BETWEEN 5000.01 AND 15000 THEN '5001-15000' WHEN c_acctbal > 15000 THEN '15001+' END AS outstanding FROM customer")
def f4_bands(spark, d):
    return _t(spark, d, "customer").select("c_custkey", flags.band(F.round("c_acctbal", 2), flags.OUTSTANDING, "Overpaid").alias("outstanding"))


# Linkage ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_mktsegment AS customer__c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def x1_guarded(spark, d):
    c = _t(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return link.guarded_join(_t(spark, d, "orders"), c, ["o_custkey"], "customer")[0].select("o_orderkey", "customer__c_mktsegment")


@query("SELECT l_orderkey, round(sum(l_quantity), 4) AS l_quantity, strftime(max(l_shipdate), '%Y-%m-%d') AS shipped, arg_min(l_returnflag, l_extendedprice) AS l_returnflag FROM lineitem GROUP BY 1")
def x2_collapse(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate", "l_returnflag", "l_extendedprice")
    out = link.collapse(li, ["l_orderkey"], "l_extendedprice")
    return _rounded(out.select("l_orderkey", "l_quantity", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"), "l_returnflag"), 4)


@query("""WITH u AS (SELECT o_custkey, 'completed' AS s, 0 AS r FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 'not_coming', 2 FROM orders WHERE o_orderstatus = 'P'), w AS (SELECT *, min(r) OVER (PARTITION BY o_custkey) AS b, max(r) OVER (PARTITION BY o_custkey) AS m FROM u)
SELECT o_custkey, s AS completion_status, b < m AS lifecycle_conflict, count(*) AS n FROM w WHERE r = b GROUP BY ALL""")
def x9_union(spark, d):
    o = _t(spark, d, "orders")
    u = link.union_partitions({"sheet__Course_Completed": o.where("o_orderstatus = 'F'"), "sheet__Not_Coming": o.where("o_orderstatus = 'P'")}, ["o_custkey"])
    return u.groupBy("o_custkey", "completion_status", "lifecycle_conflict").agg(F.count(F.lit(1)).alias("n"))


def _recon(spark: SparkSession, d: str) -> DataFrame:
    ledger = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"), "l_shipdate", "l_returnflag")
    rollup = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"), F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") / 10).otherwise(0.0).alias("pending"))
    return link.reconcile(ledger, rollup, "id", "paid", "l_shipdate", "l_returnflag", "total", "pending")


_RECON = """l AS (SELECT l_orderkey AS id, sum(l_extendedprice*(1-l_discount)) AS net, count(*) AS installments, min(l_shipdate) AS f, max(l_shipdate) AS last_paid FROM lineitem GROUP BY 1),
ch AS (SELECT id, arg_min(v, (-k, v)) AS channel FROM (SELECT l_orderkey AS id, l_returnflag AS v, count(*) AS k FROM lineitem GROUP BY ALL) GROUP BY 1), o AS (SELECT o_orderkey AS id, o_totalprice AS total, CASE WHEN o_orderstatus = 'O' THEN o_totalprice/10 ELSE 0.0 END AS pending FROM orders),
r AS (SELECT coalesce(l.id, o.id) AS id, net, installments, f, last_paid, channel, total, pending, total - coalesce(net, 0) - coalesce(pending, 0) AS gap FROM l LEFT JOIN ch USING (id) FULL JOIN o ON l.id = o.id)"""


@query(f"WITH {_RECON} SELECT id, round(net, 4) AS net, coalesce(installments, 0) AS installments, coalesce(datediff('day', f, last_paid), -1)::INT AS span_days, channel, round(gap, 4) AS gap, coalesce(abs(gap) > 1, false) AS mismatch FROM r")
def x11_reconcile(spark, d):
    return _rounded(_recon(spark, d).select("id", "net", F.coalesce("installments", F.lit(0)).alias("installments"), F.coalesce("span_days", F.lit(-1)).alias("span_days"), "channel", "gap", "mismatch"), 4)


@query(f"WITH {_RECON} SELECT count(*) AS n, count(*) FILTER (abs(gap) > 1) AS mismatches, round(sum(total), 2) AS total, round(sum(CASE WHEN total IS NOT NULL THEN greatest(coalesce(net, 0), 0) END)/sum(total), 4) AS collection_efficiency FROM r")
def x11_summary(spark, d):
    s = link.reconciliation_summary(_recon(spark, d))
    return s.select("n", "mismatches", F.round("total", 2).alias("total"), F.round("collection_efficiency", 4).alias("collection_efficiency"))


@query(f"WITH {_RECON}, a AS (SELECT CASE WHEN pending > 0 THEN CASE WHEN d <= 30 THEN '0-30' WHEN d <= 60 THEN '31-60' WHEN d <= 90 THEN '61-90' ELSE '90+' END END AS aging FROM (SELECT pending, datediff('day', last_paid, (SELECT max(last_paid) FROM r)) AS d FROM r)) SELECT aging, count(*) AS n FROM a GROUP BY 1")
def x12_aging(spark, d):
    return link.default_aging(_recon(spark, d)).groupBy("aging").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT user_id, 's' || (event_id % 3)::VARCHAR AS src, event_id, event_type FROM events WHERE event_type IN ('view', 'purchase')), g AS (SELECT user_id, arg_min(src, event_id) FILTER (event_type = 'view') AS s, list(DISTINCT src) FILTER (event_type = 'purchase') AS a FROM t GROUP BY 1)
SELECT user_id, s AS enquiry_source, coalesce(len(a), 0) > 0 AS converted, coalesce(len(list_filter(a, lambda x: x <> s)), 0) > 0 AS cross_source FROM g WHERE s IS NOT NULL""")
def x13_conversion(spark, d):
    e = _t(spark, d, "events").where(F.col("event_type").isin("view", "purchase")).withColumns({"src": F.concat(F.lit("s"), F.pmod("event_id", F.lit(3)).cast("string")), "kind": F.when(F.col("event_type") == "view", "enquiry").otherwise("admission")})
    return link.conversion(e, "user_id", "src", "kind", "event_id")


@query("SELECT id, string_agg(src, ',' ORDER BY src) AS found_in FROM (SELECT DISTINCT c_custkey AS id, 'customer' AS src FROM customer UNION ALL SELECT DISTINCT o_custkey, 'orders' FROM orders UNION ALL SELECT DISTINCT user_id, 'events' FROM events) WHERE id IS NOT NULL GROUP BY 1")
def x14_master(spark, d):
    return link.master_ids({"customer": (_t(spark, d, "customer"), "c_custkey"), "orders": (_t(spark, d, "orders"), "o_custkey"), "events": (_t(spark, d, "events"), "user_id")})


# Prediction, decisions, profiles, streams ------------------------------------------------------------------------


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    return docs.select("doc_id", "lang", "source", F.when(n < 1000, "s").when(n < 3000, "m").otherwise("l").alias("band"), F.col("quality").alias("y"))


_NB = """x AS (SELECT doc_id, lang, source, CASE WHEN n_chars < 1000 THEN 's' WHEN n_chars < 3000 THEN 'm' ELSE 'l' END AS band, quality AS y, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::UINTEGER % 5 = 0 AS h FROM documents JOIN labels USING (doc_id)),
l AS (SELECT doc_id, y, h, 'lang' AS feature, lang AS value FROM x UNION ALL SELECT doc_id, y, h, 'source', source FROM x UNION ALL SELECT doc_id, y, h, 'band', band FROM x), t AS (SELECT count(*) FILTER (y = 1) AS t1, count(*) FILTER (y = 0) AS t0 FROM x WHERE NOT h),
c AS (SELECT feature, value, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM l WHERE NOT h GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY feature) AS k FROM c), m AS (SELECT feature, value, n1, n0, ln((n1 + 1)/(t1 + k)) - ln((n0 + 1)/(t0 + k)) AS llr, ln(1/(t1 + k)) - ln(1/(t0 + k)) AS u FROM k, t)"""


@query(f"WITH {_NB} SELECT feature, value, n1, n0, round(llr, 6) AS llr FROM m")
def n5_model(spark, d):
    x = _labelled(spark, d)
    m = classify.fit(x.where(~classify.in_holdout(F.col("doc_id"))), "doc_id", ["lang", "source", "band"], "y")
    return _rounded(m.select("feature", "value", "n1", "n0", (F.col("l1") - F.col("l0")).alias("llr")))


@query(f"""WITH {_NB}, u AS (SELECT feature, first(u) AS u FROM m GROUP BY 1), s AS (SELECT doc_id, y, sum(coalesce(llr, u.u)) + (SELECT ln(t1/t0) FROM t) AS o FROM l LEFT JOIN m USING (feature, value) JOIN u ON u.feature = l.feature WHERE h GROUP BY ALL)
SELECT doc_id AS id, y, round(o, 6) AS log_odds, (o >= 0)::INT AS predicted FROM s""")
def n6_scores(spark, d):
    x, f = _labelled(spark, d), ["lang", "source", "band"]
    hold = classify.in_holdout(F.col("doc_id"))
    train = x.where(~hold)
    return _rounded(classify.score(x.where(hold), classify.fit(train, "doc_id", f, "y"), classify.priors(train, "y"), "doc_id", f, "y"))


@query(f"""WITH oc AS {_OC}, g AS (SELECT c_mktsegment AS segment, count(*) AS n, sum(o_totalprice) AS v FROM oc GROUP BY 1), s AS (SELECT *, v/n AS scaled, sum(v) OVER () / sum(n) OVER () AS base FROM g)
SELECT 'c_mktsegment' AS dimension, segment, n, round(scaled, 4) AS scaled, round(base, 4) AS baseline, round(scaled - base, 4) AS gap, CASE WHEN scaled > base THEN 'opportunity' ELSE 'risk' END AS kind, 'low' AS severity, CASE WHEN n >= 100 THEN 'high' ELSE 'medium' END AS confidence FROM s WHERE n >= 30 AND abs((scaled - base)/base) >= 0.005 AND abs((scaled - base)/base) < 0.15""")
def o1_findings(spark, d):
    b = breakdown(_orders_customers(spark, d), Metric("sum", "o_totalprice"), ["c_mktsegment"])
    return _rounded(decide.findings(b, "sum", share=0.005), 4)


@query("""WITH c AS (SELECT count(*) AS a, count(*) FILTER (event_type IN ('click', 'purchase')) AS b, count(*) FILTER (event_type = 'purchase') AS c FROM events)
SELECT 0 AS step_no, 'seen' AS step, a AS n, NULL::DOUBLE AS drop_off FROM c UNION ALL SELECT 1, 'clicked', b, round(1 - b/a, 6) FROM c UNION ALL SELECT 2, 'bought', c, round(1 - c/b, 6) FROM c""")
def o6_funnel(spark, d):
    e = _t(spark, d, "events").select(F.lit(True).alias("a"), F.col("event_type").isin("click", "purchase").alias("b"), (F.col("event_type") == "purchase").alias("c"))
    return _rounded(decide.funnel(e, [("seen", "a"), ("clicked", "b"), ("bought", "c")]))


@query("""WITH v AS (SELECT o_orderpriority AS scope, avg((o_orderstatus = 'F')::INT) AS value FROM orders GROUP BY 1)
SELECT CASE WHEN value < 0.49 THEN 'low' ELSE 'high' END AS id, 'done_rate' AS metric, scope, round(value, 6) AS value, CASE WHEN value < 0.49 THEN '<' ELSE '>' END AS op, CASE WHEN value < 0.49 THEN 0.49 ELSE 0.489 END::DOUBLE AS threshold, 'high' AS severity FROM v WHERE value < 0.49
UNION ALL SELECT 'high', 'done_rate', scope, round(value, 6), '>', 0.489::DOUBLE, 'high' FROM v WHERE value > 0.489""")
def o8_hooks(spark, d):
    b = breakdown(_orders(spark, d), Metric("rate", "done"), ["o_orderpriority"])
    values = b.select(F.lit("done_rate").alias("metric"), F.col("segment").alias("scope"), "value")
    low, high = decide.parse_threshold("below 49%"), decide.parse_threshold("above 48.9%")
    hooks = values.select("metric", "scope", F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t[0]).alias("op"), F.lit(t[1]).alias("threshold")) for i, t in (("low", low), ("high", high))])).alias("h")).select("metric", "scope", "h.*", F.lit("high").alias("severity"))
    return _rounded(decide.evaluate_hooks(hooks, values))


@query("""SELECT 'c_name' AS "column", round(avg((c_name IS NULL)::INT), 4) AS null_rate FROM customer UNION ALL SELECT 'c_acctbal', round(avg((c_acctbal IS NULL)::INT), 4) FROM customer""")
def p16_nulls(spark, d):
    return roles.null_rates(_t(spark, d, "customer").select("c_name", "c_acctbal"))


@query("""WITH l AS (SELECT 'c_mktsegment' AS "column", c_mktsegment AS v FROM customer UNION ALL SELECT 'c_name', c_name FROM customer UNION ALL SELECT 'c_acctbal', c_acctbal::VARCHAR FROM customer)
SELECT "column", count(*) AS n, count(DISTINCT v) AS n_distinct, 0.0 AS pii_share, round(avg((TRY_CAST(v AS DOUBLE) IS NOT NULL)::INT), 6) AS numeric_share, round(avg(regexp_matches(v, '^\\s*\\d{1,4}[/.-]\\d{1,2}[/.-]\\d{1,4}')::INT), 6) AS date_share, CASE "column" WHEN 'c_mktsegment' THEN 'dimension' WHEN 'c_acctbal' THEN 'numeric' ELSE 'none' END AS kind FROM l WHERE v IS NOT NULL GROUP BY 1""")
def p2_profile(spark, d):
    out = roles.profile(_t(spark, d, "customer"), ["c_mktsegment", "c_name", "c_acctbal"])
    return _rounded(out)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS hits, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS value FROM events GROUP BY 1")
def r1_daily(spark, d):
    out = alerts.daily_rates(_t(spark, d, "events"), "ts", "event_type", "purchase")
    return _rounded(out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "hits", "value"))


@query("""WITH r AS (SELECT o_custkey AS p, CASE WHEN o_orderkey % 4 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 2 ELSE 3 END AS k FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT p, c, min(k) AS k FROM r GROUP BY ALL), l AS (SELECT c_custkey AS p, c_mktsegment AS c FROM customer), fl AS (SELECT * FROM l ANTI JOIN b USING (p, c)), fr AS (SELECT * FROM b ANTI JOIN l USING (p, c)),
t AS (SELECT p, c, k, 'person_course' AS basis FROM b UNION ALL SELECT fl.p, fl.c, fr.k, 'person' FROM fl JOIN fr USING (p) WHERE (SELECT count(*) FROM fr x WHERE x.p = fl.p) = 1)
SELECT l.p AS c_custkey, CASE t.k WHEN 0 THEN 'completed' WHEN 2 THEN 'not_coming' WHEN 3 THEN 'active' END AS roster_status, t.basis AS match_basis FROM l LEFT JOIN t ON l.p = t.p AND l.c = t.c""")
def x3_roster(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "not_coming").otherwise("active")
    roster = _orders_customers(spark, d).select(F.col("o_custkey").alias("c_custkey"), F.when(F.pmod("o_orderkey", F.lit(4)) == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), status.alias("status"), "o_orderkey")
    master = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return link.roster_join(master, roster, "c_custkey", "c_mktsegment", "status", "o_orderkey").select("c_custkey", "roster_status", "match_basis")


@query("""WITH v AS (SELECT n_name AS metric, avg(c_acctbal) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT metric, round(value, 4) AS value, 4500.0::DOUBLE AS target, CASE WHEN value < 0.85*4500 THEN 'critical' ELSE 'high' END AS severity FROM v WHERE value < 4500""")
def o10_targets(spark, d):
    j = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    values = j.groupBy(F.col("n_name").alias("metric")).agg(F.avg("c_acctbal").alias("value"))
    return _rounded(decide.target_deviation(values, values.select("metric", F.lit(4500.0).alias("target"))), 4)


@query("""WITH v AS (SELECT n_name AS metric, avg(c_acctbal) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT metric, CASE WHEN value < 4000 THEN 'critical' ELSE 'medium' END AS severity, round(value, 4) AS value FROM v WHERE value < 4500""")
def o9_rules(spark, d):
    j = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    values = j.groupBy(F.col("n_name").alias("metric")).agg(F.avg("c_acctbal").alias("value")).withColumn("scope", F.lit("overall"))
    each = F.array(F.struct(F.lit("r1").alias("id"), F.lit("<").alias("op"), F.lit(4500.0).alias("threshold"), F.lit("medium").alias("severity")), F.struct(F.lit("r2").alias("id"), F.lit("<").alias("op"), F.lit(4000.0).alias("threshold"), F.lit("critical").alias("severity")))
    rules = values.select("metric", "scope", F.explode(each).alias("r")).select("metric", "scope", "r.*")
    return _rounded(decide.business_rules(values, rules).select("metric", "severity", "value"), 4)


@query("""WITH g AS (SELECT c_mktsegment AS segment, count(*) AS n, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), s AS (SELECT *, v/n AS scaled, sum(v) OVER () / sum(n) OVER () AS base FROM g),
f AS (SELECT *, scaled - base AS gap, abs((scaled - base)/base) AS rel FROM s WHERE n >= 30 AND abs((scaled - base)/base) >= 0.0001)
SELECT 'review pricing' AS action, 'sales' AS owner, segment, round(gap*n, 2) AS effect FROM f ORDER BY CASE WHEN rel >= 0.5 THEN 0 WHEN rel >= 0.3 THEN 1 WHEN rel >= 0.15 THEN 2 ELSE 3 END, abs(gap*n) DESC, segment LIMIT 1""")
def o5_actions(spark, d):
    b = breakdown(_orders_customers(spark, d), Metric("sum", "o_totalprice"), ["c_mktsegment"])
    found = decide.findings(b, "sum", share=0.0001)
    owners = spark.createDataFrame([("c_mktsegment", "sales", "review pricing")], "dimension string, owner string, action string")
    return _rounded(decide.actions(found, owners).select("action", "owner", "segment", "effect"), 2)
