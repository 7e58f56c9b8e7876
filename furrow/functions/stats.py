"""Moment formulas, p-values and long forms shared by profiles, tests and drift."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def melt(df: DataFrame, keep: Sequence[str], cols: Sequence[str], drop_null: bool = True) -> DataFrame:
    """One row per (keep..., variable, value)."""
    items = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols])
    long = df.select(*keep, F.explode(items).alias("_m")).select(*keep, "_m.*")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")) if drop_null else long


def skew_corrected(x: str | Column) -> Column:
    """Bias-corrected skewness."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_corrected(x: str | Column) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))



def _gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma Q(a, x)."""
    if not (x > 0) or math.isnan(a):
        return 1.0
    if math.isinf(x):
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b, c = x + 1 - a, 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return min(1.0, scale * h)


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    """P(chi-square(dof) > x); used on aggregated rows only."""
    return pd.Series([
        None if pd.isna(v) or pd.isna(k) or k <= 0 else _gamma_tail(k / 2.0, v / 2.0) for v, k in zip(x, dof)
    ], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)) for v in z], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """Standard normal distribution function, accurate in both tails."""
    v = z.to_numpy(dtype=float)
    return pd.Series([0.5 * math.erfc(-a / math.sqrt(2)) if a == a else np.nan for a in v])


@F.pandas_udf(DoubleType())
def ks_tail(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    out = []
    for stat, a, b in zip(d, n, m):
        if pd.isna(stat) or not a or not b:
            out.append(None)
            continue
        lam = stat * math.sqrt(a * b / (a + b))
        if lam < 1e-3:
            out.append(1.0)
            continue
        if lam < 1.18:
            t = math.exp(-(math.pi**2) / (8 * lam**2))
            cdf = math.sqrt(2 * math.pi) / lam * (t + t**9 + t**25 + t**49)
            out.append(min(1.0, max(0.0, 1 - cdf)))
        else:
            t = math.exp(-2 * lam**2)
            out.append(min(1.0, max(0.0, 2 * (t - t**4 + t**9 - t**16))))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(Binomial(n, p) >= k)."""
    out = []
    for kk, nn, pp in zip(k, n, p):
        if pd.isna(kk) or pd.isna(nn) or pd.isna(pp):
            out.append(None)
            continue
        kk, nn = int(kk), int(nn)
        if kk <= 0 or pp >= 1:
            out.append(1.0)
            continue
        logs = [
            math.lgamma(nn + 1) - math.lgamma(i + 1) - math.lgamma(nn - i + 1) + i * math.log(pp) + (nn - i) * math.log1p(-pp)
            for i in range(kk, nn + 1)
        ]
        out.append(min(1.0, sum(math.exp(v) for v in logs)))
    return pd.Series(out, dtype="float64")
