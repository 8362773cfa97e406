"""A categorical naive Bayes classifier as joins: counts by (feature, value, label), logs, and a sum per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.metrics import Blocked

LEAST_ROWS, LEAST_CLASS = 40, 10
MISSING = "<NA>"


def in_holdout(id_col: Column, folds: int = 5) -> Column:
    """Rows whose hashed id falls in fold 0; the same for ever."""
    return F.pmod(F.conv(F.substring(F.sha2(id_col.cast("string"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(folds)) == 0


def gate(df: DataFrame, label: str) -> None:
    """Blocked below 40 labelled rows or 10 of a class."""
    r = df.agg(F.count(label).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    if r["n"] < LEAST_ROWS or min(r["p"], r["n"] - r["p"]) < LEAST_CLASS:
        raise Blocked(f"{r['n']} labelled rows, {r['p']} positive: too few to learn from")


def select_features(df: DataFrame, features: list[str], low: int = 2, high: int = 30) -> list[str]:
    r = df.agg(*[F.count_distinct(c).alias(c) for c in features]).first()
    return [c for c in features if low <= r[c] <= high]


def _long(df: DataFrame, id_col: str, features: list[str], *keep: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value")) for c in features])
    return df.select(F.col(id_col).alias("id"), *keep, F.explode(cells).alias("x")).select("id", *keep, "x.*")


def fit(train: DataFrame, id_col: str, features: list[str], label: str, alpha: float = 1.0) -> DataFrame:
    """Likelihoods: rows (feature, value, n1, n0, l1, l0, u1, u0), u for unseen values."""
    n = train.groupBy(F.lit(1)).agg(F.count_if(F.col(label) == 1).alias("t1"), F.count_if(F.col(label) == 0).alias("t0")).drop("1")
    counts = _long(train, id_col, features, label).groupBy("feature", "value").agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"))
    k = F.count(F.lit(1)).over(Window.partitionBy("feature"))
    c = counts.withColumn("k", k).join(F.broadcast(n))
    log = lambda a, t: F.log((a + alpha) / (F.col(t) + alpha * F.col("k")))
    return c.select("feature", "value", "n1", "n0", log(F.col("n1"), "t1").alias("l1"), log(F.col("n0"), "t0").alias("l0"), log(F.lit(0.0), "t1").alias("u1"), log(F.lit(0.0), "t0").alias("u0"))


def score(df: DataFrame, model: DataFrame, priors: DataFrame, id_col: str, features: list[str], *keep: str) -> DataFrame:
    """Rows (id, keep, log_odds, predicted); ties read 1. How the model is joined is left to the optimizer: features of many values make it large."""
    unseen = model.groupBy("feature").agg(F.first("u1").alias("u1"), F.first("u0").alias("u0"))
    long = _long(df, id_col, features, *keep).join(model.select("feature", "value", "l1", "l0"), ["feature", "value"], "left").join(unseen, "feature")
    odds = long.groupBy("id", *keep).agg(F.sum(F.coalesce("l1", "u1") - F.coalesce("l0", "u0")).alias("s"))
    out = odds.join(F.broadcast(priors)).withColumn("log_odds", F.col("s") + F.col("prior"))
    return out.select("id", *keep, "log_odds", (F.col("log_odds") >= 0).cast("int").alias("predicted"))


def priors(train: DataFrame, label: str) -> DataFrame:
    return train.agg(F.log(F.count_if(F.col(label) == 1) / F.count_if(F.col(label) == 0)).alias("prior"))


def evaluate(scored: DataFrame, label: str) -> DataFrame:
    """One row (n, accuracy, majority, lift)."""
    r = scored.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"), F.avg(F.col(label).cast("double")).alias("p"))
    majority = F.greatest(F.col("p"), 1 - F.col("p"))
    return r.select("n", "accuracy", majority.alias("majority"), (F.col("accuracy") - majority).alias("lift"))


def risk_factors(model: DataFrame, top: int = 8) -> DataFrame:
    return model.select("feature", "value", "n1", "n0", (F.col("l1") - F.col("l0")).alias("llr")).orderBy(F.desc("llr"), "feature", "value").limit(top)


def terminal_labels(df: DataFrame, status: str = "completion_status", flags: tuple[str, str] = ("is_not_coming", "is_completed")) -> DataFrame:
    """The rows whose outcome is known, with label 1 for not coming and 0 for completed. Rows still active are censored: left out.
    Without the status the two flags are used; without either, or without any known outcome, Blocked.
    """
    if status in df.columns:
        known = df.where(F.col(status).isin("completed", "not_coming")).withColumn("label", (F.col(status) == "not_coming").cast("int"))
    elif all(f in df.columns for f in flags):
        gone, done = (F.coalesce(F.col(f).cast("boolean"), F.lit(False)) for f in flags)
        known = df.where(gone | done).withColumn("label", gone.cast("int"))
    else:
        raise Blocked("no column tells how a course ended")
    if known.limit(1).count() == 0:
        raise Blocked("no row has a known outcome")
    return known


def select_flags(df: DataFrame, flags: list[str]) -> list[str]:
    """Flags that are there and hold more than one value."""
    have = [c for c in flags if c in df.columns]
    r = df.agg(*[(F.min(F.col(c).cast("int")) < F.max(F.col(c).cast("int"))).alias(c) for c in have]).first() if have else {}
    return [c for c in have if r[c]]


def split(df: DataFrame, id_col: str, label: str) -> tuple[DataFrame, DataFrame]:
    """``(train, holdout)`` by hashed id; all rows are both where the holdout is empty or the rest holds one class only."""
    hold = in_holdout(F.col(id_col))
    r = df.agg(F.count_if(hold).alias("h"), F.count_distinct(F.when(~hold, F.col(label))).alias("k")).first()
    return (df.where(~hold), df.where(hold)) if r["h"] and r["k"] > 1 else (df, df)


def caveats(evaluation: DataFrame, train: DataFrame, label: str) -> DataFrame:
    """Rows (caveat) on a model: few rows, no gain over the majority, a thin class."""
    n = train.agg(F.count(label).alias("rows"), F.count_if(F.col(label) == 1).alias("pos")).withColumn("minority", F.least("pos", F.col("rows") - F.col("pos")))
    all_ = n.join(evaluation.select("lift")).select(F.filter(F.array(F.when(F.col("rows") < 2 * LEAST_ROWS, "small_training_set"), F.when(F.col("lift") <= 1e-9, "no_gain_over_majority"), F.when(F.col("minority") < 2 * LEAST_CLASS, "thin_class")), lambda x: x.isNotNull()).alias("c"))
    return all_.select(F.explode("c").alias("caveat"))
