"""Order statistics that no single task sees whole: positions, running sums, inversions and the pairs that are inverted.

Values are dealt into buckets between bounds taken from a small sample, so any bounds give exact results and bad ones only cost balance. A value that is a
bound itself has a bucket of its own (odd), in which nothing is left to compare; the buckets between bounds (even) hold about ``ROWS`` rows each.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a bucket, bounds at most, and values of the sample for each bound.
ROWS, MOST, SAMPLED = 1_000_000, 1000, 100
#: Rows of a bucket that a Python task counts inversions in: it holds several arrays of that length.
HELD = 125_000
_FINE = 32


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session on one machine that names none (as in tests) gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: for what is read several times, or must not be computed anew when an executor is lost."""
    path = os.path.join(shared_dir(df.sparkSession), f"ranking-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, case aside."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bounds(df: DataFrame, column: str, n: int, rows: int | None = None) -> list:
    """Distinct values, ascending, that part ``n`` rows into buckets of about ``rows``; the driver sees ``SAMPLED`` values a bound."""
    parts = min(MOST, math.ceil(n / (rows or ROWS)))
    if parts <= 1:
        return []
    some = df.where(F.col(column).isNotNull()).select(column).sample(min(1.0, SAMPLED * parts / n), seed=29)
    values = sorted(r[0] for r in some.collect())
    return sorted({values[k * len(values) // parts] for k in range(1, parts)}) if values else []


def bucket(c: Column, at: list) -> Column:
    """Twice the number of bounds below the value, and one more if it is a bound; found in two steps of at most ``_FINE`` comparisons for 1000 bounds."""
    if not at:
        return F.lit(0)
    groups = [at[k : k + _FINE] for k in range(0, len(at), _FINE)]
    array = lambda xs: F.array(*map(F.lit, xs))
    below = lambda xs: F.size(F.filter(xs, lambda b: b < c))
    group = F.greatest(below(array([g[0] for g in groups])) - 1, F.lit(0))
    own = F.element_at(F.array(*map(array, groups)), group + 1)
    place = group * _FINE + below(own)
    whole = array([*at, at[-1]])
    return 2 * place + (F.element_at(whole, place + 1) == c).cast("int")


def running(df: DataFrame, by: str, amount: str, out: str, at: list, keys: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows of the same ``keys`` up to this one in the order of ``by``, whose values differ."""
    keys = keys or []
    if not at:
        return df.withColumn(out, F.sum(amount).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))
    b, before = free(df, "bucket", "before")
    t = df.withColumn(b, bucket(F.col(by), at))
    per = t.groupBy(*keys, b).agg(F.sum(amount).alias(before))
    per = per.withColumn(before, F.coalesce(F.sum(before).over(Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = joined(t, per, [*keys, b])
    own = F.sum(amount).over(Window.partitionBy(*keys, b).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn(out, own + F.col(before)).drop(b, before)


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys of which nulls match too; the columns of ``left`` and those of ``right`` beyond the keys."""
    alike = {k: f"{k}_r" for k in free(left, *keys)}
    names = dict(zip(keys, alike.values(), strict=True))
    right = right.withColumnsRenamed(names)
    cond = None
    for k, r in names.items():
        one = left[f"`{k}`"].eqNullSafe(right[f"`{r}`"])
        cond = one if cond is None else cond & one
    return left.join(right, cond, "left").drop(*names.values())


def places(df: DataFrame, by: str, out: str, at: list) -> DataFrame:
    """Adds ``out``: each row's place, from 0, in the order of ``by``, whose values differ."""
    (one,) = free(df, "one")
    return running(df.withColumn(one, F.lit(1)), by, one, out, at).withColumn(out, F.col(out) - 1).drop(one)


# Inversions ------------------------------------------------------------------------------------------------------


def _levels(values: np.ndarray):
    """For each bit, from the highest: the members in their order, those whose bit is 0, how many of the same upper bits with bit 1 stand before each, and where its group begins."""
    rank = np.unique(values, return_inverse=True)[1]
    order = np.arange(len(rank))
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        r = rank[order]
        upper, one = r >> (bit + 1), (r >> bit) & 1
        ones = np.cumsum(one) - one
        start = np.searchsorted(upper, upper)
        yield order, np.flatnonzero(one == 0), ones, ones[start], one
        order = order[np.argsort(r >> bit, kind="stable")]


def count_inverted(values: np.ndarray) -> int:
    """Pairs of which the earlier value is the greater, by a merge over the bits of ranks."""
    return sum(int((ones[zero] - base[zero]).sum()) for _, zero, ones, base, _ in _levels(values))


def list_inverted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs, as places (earlier, later)."""
    first, second = [], []
    for order, zero, ones, base, one in _levels(values):
        n = ones[zero] - base[zero]
        at = np.flatnonzero(one == 1)
        ends = np.cumsum(n)
        which = np.repeat(base[zero] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        first.append(order[at[which]])
        second.append(order[np.repeat(zero, n)])
    return (np.concatenate(first), np.concatenate(second)) if first else (np.empty(0, np.int64),) * 2


def _dealt(points: DataFrame, x: str, y: str, n: int, rows: int | None) -> tuple[DataFrame, bool]:
    t = points.withColumnsRenamed({x: "x", y: "y"})
    ax, ay = bounds(t, "x", n, rows), bounds(t, "y", n, rows)
    return t.withColumns({"a": bucket(F.col("x"), ax), "v": bucket(F.col("y"), ay)}), bool(ax or ay)


def _sorted(table: pa.Table, second: str) -> pa.Table:
    return table.sort_by([("x", "ascending"), (second, "ascending")])


def inversions(points: DataFrame, x: str, y: str, n: int, rows: int | None = None) -> int:
    """Pairs of rows with x less and y greater, strictly; ``n`` is about the number of rows, none of which holds a null.

    Pairs of one y bucket and pairs of one x bucket but different y buckets are counted in tasks; all others from the numbers of rows in each pair of buckets.
    """
    t, many = _dealt(points.select(x, y), x, y, n, rows or HELD)

    def own(table: pa.Table) -> pa.Table:
        return pa.table({"q": pa.array([count_inverted(_sorted(table, "y")["y"].to_numpy())], pa.int64())})

    def across(table: pa.Table) -> pa.Table:
        return pa.table({"q": pa.array([count_inverted(_sorted(table, "v")["v"].to_numpy())], pa.int64())})

    parts = t.where("v % 2 = 0").select("v", "x", "y").groupBy("v").applyInArrow(own, "q long")
    total = F.coalesce(F.sum(F.col("q").cast("decimal(38,0)")), F.lit(0))
    if not many:
        return int(parts.agg(total).first()[0])
    parts = parts.unionByName(t.where("a % 2 = 0").select("a", "x", "v").groupBy("a").applyInArrow(across, "q long"))
    inside = int(parts.agg(total).first()[0])
    cells = t.groupBy("a", "v").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("c"))
    most_a, most_v = t.agg(F.max("a"), F.max("v")).first()
    grid = points.sparkSession.range(most_a + 1).select(F.col("id").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(most_v))).alias("v")).join(cells, ["a", "v"], "left").na.fill(0)
    earlier = F.sum("c").over(Window.partitionBy("v").orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    grid = grid.withColumn("c", F.coalesce("c", F.lit(0).cast("decimal(38,0)"))).withColumn("d", F.coalesce(earlier, F.lit(0)))
    higher = F.sum("d").over(Window.partitionBy("a").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1))
    apart = grid.withColumn("e", F.coalesce(higher, F.lit(0))).agg(F.sum((F.col("c").cast("decimal(19,0)") * F.col("e").cast("decimal(19,0)")).cast("decimal(38,0)")).alias("q")).first()
    return inside + int(apart["q"] or 0)


def inverted_pairs(points: DataFrame, x: str, y: str, keep: str, value: str, n: int, rows: int | None = None) -> DataFrame:
    """Rows (k1, v1, k2, v2): ``keep`` and ``value`` of both members of each inverted pair. For callers that know the pairs to be few."""
    t, many = _dealt(points.select(x, y, F.col(keep).alias("k"), F.col(value).alias("w")), x, y, n, rows)
    out = "k1 long, v1 double, k2 long, v2 double"

    def pairs(table: pa.Table, by: str) -> pa.Table:
        s = _sorted(table, by)
        i, j = list_inverted(s[by].to_numpy())
        k, w = s["k"].to_numpy(), s["w"].to_numpy()
        return pa.table({"k1": k[i].astype(np.int64), "v1": w[i], "k2": k[j].astype(np.int64), "v2": w[j]})

    def own(table: pa.Table) -> pa.Table:
        return pairs(table, "y")

    def across(table: pa.Table) -> pa.Table:
        return pairs(table, "v")

    found = t.where("v % 2 = 0").groupBy("v").applyInArrow(own, out)
    if not many:
        return found
    found = found.unionByName(t.where("a % 2 = 0").groupBy("a").applyInArrow(across, out))
    cells = t.select("a", "v").distinct()
    apart = cells.join(F.broadcast(cells.select(F.col("a").alias("a2"), F.col("v").alias("v2"))), (F.col("a") < F.col("a2")) & (F.col("v") > F.col("v2")))  # bucket numbers only
    left = t.select("a", "v", F.col("k").alias("k1"), F.col("w").alias("v1"))
    right = t.select(F.col("a").alias("a2"), F.col("v").alias("v2"), F.col("k").alias("k2"), F.col("w").alias("w2"))
    far = apart.join(left, ["a", "v"]).join(right, ["a2", "v2"]).select("k1", "v1", "k2", F.col("w2").alias("v2"))
    return found.unionByName(far)
