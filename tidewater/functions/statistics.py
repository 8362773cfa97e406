"""Statistical column functions: plain arithmetic on aggregated rows.

Only the two tail probabilities need Python (Spark has no error function): they run as Arrow UDFs on tables that are
already aggregated.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054


def _chi2_tail(x: float, dof: float) -> float:
    """Upper tail: the regularised incomplete gamma function Q(dof / 2, x / 2)."""
    if x <= 0 or dof <= 0:
        return 1.0
    a, t = dof / 2, x / 2
    scale = math.exp(a * math.log(t) - t - math.lgamma(a))
    if t < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= t / n
            total += term
        return max(0.0, 1 - total * scale)
    # Continued fraction, evaluated from its tail.
    frac = 0.0
    for i in range(400, 0, -1):
        frac = i * (i - a) / (t + 2 * i + 1 - a - frac)
    return min(1.0, scale / (t + 1 - a - frac))


def normal_sf(z: Column) -> Column:
    """P(Z > z)."""

    @F.arrow_udf("double")
    def run(zs: pa.Array) -> pa.Array:
        return pa.array([None if z is None else 0.5 * math.erfc(z / math.sqrt(2)) for z in zs.to_pylist()], pa.float64())

    return run(z.cast("double"))


def two_sided(z: Column) -> Column:
    """P(|Z| > |z|)."""
    return 2 * normal_sf(F.abs(z))


def chi2_sf(x: Column, dof: Column) -> Column:
    """P(X > x) of a chi-squared variable."""

    @F.arrow_udf("double")
    def run(xs: pa.Array, ds: pa.Array) -> pa.Array:
        pairs = zip(xs.to_pylist(), ds.to_pylist(), strict=True)
        return pa.array([None if x is None or d is None else _chi2_tail(x, d) for x, d in pairs], pa.float64())

    return run(x.cast("double"), dof.cast("double"))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of a proportion, within 0 to 1; null for no trials."""
    p = F.try_divide(successes.cast("double"), n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z / 2), n)) / scale
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)) / scale
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def two_proportions(x1: Column, n1: Column, x2: Column, n2: Column) -> dict[str, Column]:
    """Difference of proportions: pooled z, unpooled 95 % interval."""
    p1, p2 = F.try_divide(x1.cast("double"), n1), F.try_divide(x2.cast("double"), n2)
    pool = F.try_divide((x1 + x2).cast("double"), n1 + n2)
    pooled = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    spread = F.sqrt(F.try_divide(p1 * (1 - p1), n1) + F.try_divide(p2 * (1 - p2), n2))
    diff = p1 - p2
    return {"diff": diff, "z": F.coalesce(F.try_divide(diff, pooled), F.lit(0.0)), "low": diff - Z95 * spread, "high": diff + Z95 * spread}


def two_means(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> dict[str, Column]:
    """Difference of means by Welch's z; null unless both sides have two rows."""
    se = F.sqrt(F.try_divide(v1, n1) + F.try_divide(v2, n2))
    diff = m1 - m2
    ok = (n1 >= 2) & (n2 >= 2)
    return {"diff": F.when(ok, diff), "z": F.when(ok, F.try_divide(diff, se)), "low": F.when(ok, diff - Z95 * se), "high": F.when(ok, diff + Z95 * se)}


def corrected_skew(x: Column) -> Column:
    """Sample skewness with the small-sample correction; null below three rows."""
    n = F.count(x)
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(x: Column) -> Column:
    """Sample excess kurtosis with the small-sample correction; null below four rows."""
    n = F.count(x)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))
