"""Statistical tests as grouped jobs: aggregates in Spark, p-values on the final rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from furrow.functions.scalar import hash_order
from furrow.functions.stats import chi2_tail, normal_cdf
from furrow.operators.groups import attach, measured, safe
from furrow.operators.ordered import row_frames, running
from furrow.operators.ranks import value_counts

ALPHA = 0.05
# Anderson-Darling significance levels and critical values for a fitted normal.
AD_LEVELS = [0.15, 0.10, 0.05, 0.025, 0.01]
AD_CRITICAL = [0.561, 0.631, 0.752, 0.873, 1.035]
# KPSS level-stationarity table.
KPSS_LEVELS = [0.10, 0.05, 0.025, 0.01]
KPSS_CRITICAL = [0.347, 0.463, 0.574, 0.739]
# Dickey-Fuller critical surface with a constant, 1, 5 and 10 percent.
DF_SURFACE = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}


def interpolate(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise-linear table lookup, clipped at both ends."""
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 1, 0, -1):
        line = ys[i - 1] + (x - xs[i - 1]) / (xs[i] - xs[i - 1]) * (ys[i] - ys[i - 1])
        out = F.when(x < xs[i], line).otherwise(out)
    return F.when(x.isNotNull(), F.when(x <= xs[0], F.lit(float(ys[0]))).otherwise(out))


def jarque_bera(df: DataFrame, col: str, by: Sequence[str] = (), least: int = 20) -> DataFrame:
    out = df.groupBy(*by).agg(F.count(col).alias("n"), F.skewness(col).alias("_s"), F.kurtosis(col).alias("_k"))
    out = out.withColumn("statistic", F.when(F.col("n") >= least, safe(F.col("n") / 6.0 * (F.pow("_s", 2) + F.pow("_k", 2) / 4.0))))
    p = F.exp(-F.col("statistic") / 2.0)
    return out.select(*by, "n", "statistic", p.alias("p_value"), (p < ALPHA).alias("rejects"))


def anderson_darling(df: DataFrame, col: str, by: Sequence[str] = (), least: int = 8) -> DataFrame:
    """Normality with fitted mean and deviation, from value counts and their running sums."""
    by = list(by)
    stats = df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("_m"), F.stddev_samp(col).alias("_sd"))
    cum = attach(value_counts(df.withColumn("_v", F.col(col).cast("double")), by, "_v"), measured(stats, by), by)
    cum = cum.withColumn("_z", F.try_divide(F.col("value") - F.col("_m"), F.col("_sd")))
    cum = cum.withColumn("_lo", normal_cdf("_z")).withColumn("_hi", normal_cdf(-F.col("_z")))
    n, after = F.col("n").cast("double"), F.col("cum_c").cast("double")
    before = after - F.col("c")
    left = (after * after - before * before) * F.log(F.greatest("_lo", F.lit(1e-300)))
    right = (F.pow(n - before, 2) - F.pow(n - after, 2)) * F.log(F.greatest("_hi", F.lit(1e-300)))
    out = cum.groupBy(*by).agg(F.max("n").alias("n"), F.sum(left + right).alias("_s"))
    a2 = -n - F.col("_s") / n
    out = out.withColumn("statistic", F.when(F.col("n") >= least, a2))
    adjusted = F.col("statistic") * (1 + 0.75 / n + 2.25 / (n * n))
    p = interpolate(adjusted, AD_CRITICAL, AD_LEVELS)
    return out.select(*by, "n", "statistic", p.alias("p_value"), (adjusted > AD_CRITICAL[2]).alias("rejects"))


@F.pandas_udf(ArrayType(DoubleType()))
def _solve(moments: pd.Series, size: pd.Series) -> pd.Series:
    """Least squares of an aggregated moment matrix: coefficients, then the last row's variance factors."""
    out = []
    for flat, p in zip(moments, size):
        p = int(p)
        m = np.asarray(flat, dtype=float).reshape(p + 1, p + 1)
        xx, xy = m[:p, :p], m[:p, p]
        inv = np.linalg.pinv(xx, hermitian=True)
        beta = inv @ xy
        sse = float(m[p, p] - 2 * beta @ xy + beta @ xx @ beta)
        out.append([*beta.tolist(), sse, *np.diag(inv).tolist()])
    return pd.Series(out)


def ols(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with standardised regressors, per-group fit); a moment aggregate and a small solve.

    The fit has ``coef`` (intercept first), ``sse``, ``inv`` (diagonal of the inverse) and ``n``.
    """
    by, p = list(by), len(xs) + 1
    rows = df.dropna(subset=[y, *xs])
    means = rows.groupBy(*by).agg(*[a for i, x in enumerate(xs) for a in (F.avg(x).alias(f"_m{i}"), F.stddev_pop(x).alias(f"_d{i}"))])
    rows = attach(rows, measured(means, by), by)
    scaled = {f"_x{i}": (F.col(x) - F.col(f"_m{i}")) / F.when(F.col(f"_d{i}") > 0, F.col(f"_d{i}")).otherwise(1.0) for i, x in enumerate(xs)}
    rows = rows.withColumns(scaled).drop(*means.drop(*by).columns)
    terms = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(len(xs))], F.col(y).cast("double")]
    cells = [F.sum(a * b).alias(f"_c{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if j >= i]
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.var_pop(y).alias("_vy"), *cells)
    flat = F.array(*[F.col(f"_c{min(i, j)}_{max(i, j)}") for i in range(p + 1) for j in range(p + 1)])
    fit = sums.withColumn("_f", _solve(flat, F.lit(p)))
    fit = fit.select(*by, "n", "_vy", F.slice("_f", 1, p).alias("coef"), F.get("_f", F.lit(p)).alias("sse"), F.slice("_f", p + 2, p).alias("inv"))
    return rows, fit


def _residual(rows: DataFrame, fit: DataFrame, y: str, n_x: int, by: Sequence[str]) -> DataFrame:
    out = attach(rows, measured(fit.select(*by, "coef"), by), by)
    pred = F.get("coef", F.lit(0))
    for i in range(n_x):
        pred = pred + F.get("coef", F.lit(i + 1)) * F.col(f"_x{i}")
    return out.withColumn("_e2", F.pow(F.col(y) - pred, 2)).drop("coef", *[f"_x{i}" for i in range(n_x)])


def _lm(df: DataFrame, y: str, xs: Sequence[str], aux: dict[str, Column], by: Sequence[str], least: int) -> DataFrame:
    rows, fit = ols(df, y, xs, by)
    rows = _residual(rows, fit, y, len(xs), by).withColumns({k: c for k, c in aux.items() if k not in xs})
    _, second = ols(rows, "_e2", list(aux), by)
    r2 = 1 - F.try_divide(F.col("sse"), F.col("_vy") * F.col("n"))
    stat = F.when(F.col("n") >= least, F.col("n") * r2)
    out = second.withColumn("statistic", stat)
    p = chi2_tail("statistic", F.lit(float(len(aux))))
    return out.withColumn("p_value", p).select(*by, "n", "statistic", "p_value", (F.col("p_value") < ALPHA).alias("rejects"))


def breusch_pagan(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Residual variance against the regressors of an OLS fit."""
    return _lm(df, y, xs, {x: F.col(x) for x in xs}, list(by), 30)


def white_test(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """As Breusch-Pagan with squares and cross products."""
    aux = {x: F.col(x) for x in xs}
    for i, a in enumerate(xs):
        for b in xs[i:]:
            aux[f"_{a}_{b}"] = F.col(a) * F.col(b)
    return _lm(df, y, xs, aux, list(by), 50)


def breusch_pagan_residuals(df: DataFrame, resid: str, pred: str, by: Sequence[str] = (), least: int = 10) -> DataFrame:
    """Variance of given residuals against the prediction: two regression aggregates."""
    by = list(by)
    rows = df.dropna(subset=[resid, pred])
    line = rows.groupBy(*by).agg(F.regr_slope(resid, pred).alias("_b"), F.regr_intercept(resid, pred).alias("_a"))
    e2 = F.pow(F.col(resid) - F.col("_a") - F.col("_b") * F.col(pred), 2)
    rows = attach(rows, measured(line, by), by).withColumn("_e2", e2)
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_r2("_e2", pred).alias("_r2"))
    out = out.withColumn("statistic", F.when(F.col("n") >= least, F.col("n") * F.col("_r2")))
    out = out.withColumn("p_value", chi2_tail("statistic", F.lit(1.0)))
    return out.select(*by, "n", "statistic", "p_value", (F.col("p_value") < ALPHA).alias("rejects"))


def durbin_watson(df: DataFrame, col: str, order: Sequence, by: Sequence[str] = (), least: int = 10, first: str | None = None) -> DataFrame:
    """``first`` here and below is that of ``row_frames``."""
    by = list(by)
    rows = row_frames(df.where(F.col(col).isNotNull()), by, order, 1, {"_prev": lambda w: F.lag(col, 1).over(w)}, first=first)
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.col(col) - F.col("_prev"), 2)).alias("_d"), F.sum(F.pow(col, 2)).alias("_s"))
    stat = F.when(F.col("n") >= least, F.try_divide(F.col("_d"), F.col("_s")))
    verdict = F.when(stat < 1.5, "positive").when(stat > 2.5, "negative").otherwise("ok")
    return out.select(*by, "n", stat.alias("statistic"), F.when(stat.isNotNull(), verdict).alias("verdict"), ((stat < 1.5) | (stat > 2.5)).alias("rejects"))


def autocorrelation(df: DataFrame, col: str, order: Sequence, lags: int, by: Sequence[str] = (), first: str | None = None) -> DataFrame:
    """One row per group: ``n`` and the array ``acf`` of lags 1..lags."""
    by = list(by)
    rows = df.where(F.col(col).isNotNull())
    mean = rows.groupBy(*by).agg(F.avg(col).alias("_m"))
    rows = attach(rows, measured(mean, by), by).withColumn("_c", F.col(col) - F.col("_m"))
    back = {f"_l{k}": (lambda w, k=k: F.lag("_c", k).over(w)) for k in range(1, lags + 1)}
    framed = row_frames(rows, by, order, lags, back, first=first, base=df.where(F.col(col).isNotNull()))
    out = framed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow("_c", 2)).alias("_g0"), *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_g{k}") for k in range(1, lags + 1)])
    acf = F.array(*[F.try_divide(F.col(f"_g{k}"), F.col("_g0")) for k in range(1, lags + 1)])
    return out.select(*by, "n", (F.col("_g0") / F.col("n")).alias("variance"), acf.alias("acf"))


def ljung_box(df: DataFrame, col: str, order: Sequence, lags: int = 10, by: Sequence[str] = (), first: str | None = None) -> DataFrame:
    out = autocorrelation(df, col, order, lags, by, first)
    n = F.col("n").cast("double")
    total = sum((F.pow(F.get("acf", F.lit(k - 1)), 2) / (n - k) for k in range(1, lags + 1)), F.lit(0.0))
    out = out.where(F.col("n") > lags).withColumn("statistic", F.when(F.col("n") >= lags + 5, n * (n + 2) * total))
    out = out.withColumn("p_value", chi2_tail("statistic", F.lit(float(lags))))
    return out.select(*by, "n", "statistic", "p_value", (F.col("p_value") < ALPHA).alias("rejects"))


def kpss(df: DataFrame, col: str, order: Sequence, lags: int, by: Sequence[str] = (), least: int = 30, first: str | None = None) -> DataFrame:
    """Level stationarity with a given bandwidth."""
    by = list(by)
    rows = df.where(F.col(col).isNotNull())
    mean = rows.groupBy(*by).agg(F.avg(col).alias("_m"))
    rows = attach(rows, measured(mean, by), by).withColumn("_c", F.col(col) - F.col("_m"))
    sums = running(rows, by, order, {"_s": F.col("_c")}).groupBy(*by).agg(F.sum(F.pow("_s", 2)).alias("_eta"))
    acf = autocorrelation(rows.select(*df.columns), col, order, lags, by, first)
    weights = sum(((1 - k / (lags + 1)) * F.get("acf", F.lit(k - 1)) for k in range(1, lags + 1)), F.lit(0.0))
    out = attach(acf, sums, by)
    long_run = F.col("variance") * (1 + 2 * weights)
    stat = F.when(F.col("n") >= least, F.try_divide(F.col("_eta") / F.pow(F.col("n").cast("double"), 2), long_run))
    out = out.withColumn("statistic", stat)
    p = interpolate(F.col("statistic"), KPSS_CRITICAL, KPSS_LEVELS)
    return out.select(*by, "n", "statistic", p.alias("p_value"), (p < ALPHA).alias("rejects"))


def dickey_fuller(df: DataFrame, col: str, order: Sequence, lags: int = 1, by: Sequence[str] = (), least: int = 30, first: str | None = None) -> DataFrame:
    """t of the level in the differenced regression with ``lags`` lagged differences."""
    by = list(by)
    rows = df.where(F.col(col).isNotNull())
    back = {f"_v{k}": (lambda w, k=k: F.lag(col, k).over(w)) for k in range(1, lags + 2)}
    framed = row_frames(rows, by, order, lags + 1, back, first=first)
    cols = {"_dy": F.col(col) - F.col("_v1"), "_level": F.col("_v1")}
    cols.update({f"_dl{k}": F.col(f"_v{k}") - F.col(f"_v{k + 1}") for k in range(1, lags + 1)})
    framed = framed.withColumns(cols)
    xs = ["_level", *[f"_dl{k}" for k in range(1, lags + 1)]]
    _, fit = ols(framed, "_dy", xs, by)
    n = F.col("n").cast("double")
    sigma2 = F.col("sse") / (n - len(xs) - 1)
    t = F.get("coef", F.lit(1)) / F.sqrt(sigma2 * F.get("inv", F.lit(1)))
    out = fit.withColumn("statistic", F.when(F.col("n") >= least, t))
    crit = {f"critical_{k[:-1]}": F.lit(a) + b / n + c / (n * n) + d / (n * n * n) for k, (a, b, c, d) in DF_SURFACE.items()}
    out = out.withColumns(crit)
    return out.select(*by, "n", "statistic", *crit, (F.col("statistic") < F.col("critical_5")).alias("rejects"))


def chi2_goodness(observed: DataFrame, baseline: DataFrame, level: str, keys: Sequence[str] = (), base_keys: Sequence[str] = ()) -> DataFrame:
    """Observed counts (``n``) against baseline shares (``freq``) on common levels."""
    both = attach(observed, baseline, [*base_keys, level]).where(F.col("freq") > 0)
    total = both.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum("freq").alias("_f"), F.count(F.lit(1)).alias("_k"))
    both = attach(both, total, keys)
    expected = F.col("freq") / F.col("_f") * F.col("_n")
    out = both.groupBy(*keys).agg(F.max("_k").alias("k"), F.sum(F.pow(F.col("n") - expected, 2) / expected).alias("_s"))
    out = out.withColumn("chi2", F.when(F.col("k") >= 2, F.col("_s")))
    return out.select(*keys, "k", "chi2", chi2_tail("chi2", (F.col("k") - 1).cast("double")).alias("chi2_p"))


def permanova(centroids: DataFrame, dims: Sequence[str], label: str, unit: str, permutations: int = 999, seed: int = 42) -> DataFrame:
    """Permutational ANOVA of centroids (one row per variety, so every window is small).

    Each permutation orders the varieties by a hash and hands out the labels in that order.
    """
    from pyspark.sql import Window

    v = F.array(*[F.col(d).cast("double") for d in dims])
    base = centroids.select(F.col(unit).alias("_u"), F.col(label).cast("string").alias("_l"), v.alias("_v"))
    runs = base.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    shuffled = Window.partitionBy("_p").orderBy(hash_order(F.concat_ws(":", F.col("_p").cast("string"), F.col("_u").cast("string")), seed), "_u")
    listed = Window.partitionBy("_p").orderBy("_l", "_u")
    runs = runs.withColumn("_i", F.row_number().over(shuffled)).withColumn("_j", F.row_number().over(listed))
    labels = runs.select("_p", F.col("_j").alias("_i"), F.col("_l").alias("_new"))
    mixed = runs.join(labels, ["_p", "_i"]).withColumn("_g", F.when(F.col("_p") == 0, F.col("_l")).otherwise(F.col("_new")))
    flat = mixed.select("_p", "_g", F.posexplode("_v").alias("_d", "_x"))
    cell = flat.groupBy("_p", "_g", "_d").agg(F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_q"), F.count(F.lit(1)).alias("_c"))
    per = cell.groupBy("_p", "_d").agg(F.sum("_q").alias("_q"), F.sum("_s").alias("_s"), F.sum(F.col("_s") * F.col("_s") / F.col("_c")).alias("_b"), F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    each = per.groupBy("_p").agg(
        F.sum(F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")).alias("_t"), F.sum(F.col("_q") - F.col("_b")).alias("_w"), F.max("_n").alias("_n"), F.max("_k").alias("_k")
    )
    f = F.try_divide((F.col("_t") - F.col("_w")) / F.greatest(F.col("_k") - 1, F.lit(1)), F.col("_w") / F.greatest(F.col("_n") - F.col("_k"), F.lit(1)))
    each = each.withColumn("_f", f)
    seen = each.where("_p = 0").select(F.col("_f").alias("f_obs"), ((F.col("_t") - F.col("_w")) / F.col("_t")).alias("r2"))
    judged = attach(each.where("_p > 0"), seen)
    out = judged.agg(F.max("f_obs").alias("f_obs"), F.max("r2").alias("r2"), ((F.count_if(F.col("_f") >= F.col("f_obs") - 1e-9) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
    return out.withColumn("rejects", F.col("p_value") < ALPHA)


def residual_battery(df: DataFrame, resid: str, pred: str, order: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Durbin-Watson, Ljung-Box, Anderson-Darling, Jarque-Bera, Breusch-Pagan and White as rows."""
    by = list(by)
    sq = df.withColumn("_r2", F.pow(resid, 2))
    tables = {
        "durbin_watson": durbin_watson(df, resid, order, by).withColumn("p_value", F.lit(None).cast("double")),
        "ljung_box": ljung_box(df, resid, order, 10, by),
        "anderson_darling": anderson_darling(df, resid, by),
        "jarque_bera": jarque_bera(df, resid, by),
        "breusch_pagan": breusch_pagan(sq, "_r2", [pred], by),
        "white": white_test(sq, "_r2", [pred], by),
    }
    out = None
    for name, t in tables.items():
        part = t.select(*by, F.lit(name).alias("test"), "n", "statistic", "p_value", "rejects")
        out = part if out is None else out.unionByName(part)
    return out


def residual_findings(battery: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Findings (severity, code) of a battery; a clean one gets ``good``."""
    hit = battery.groupBy(*by).agg(F.collect_set(F.when(F.col("rejects"), F.col("test"))).alias("_t"))

    def has(*names):
        test = F.lit(False)
        for n in names:
            test = test | F.array_contains("_t", n)
        return test

    rules = [
        (has("durbin_watson"), "high", "autocorrelation"),
        (has("ljung_box"), "high", "ljung_box"),
        (has("breusch_pagan", "white"), "medium", "heteroscedasticity"),
        (has("jarque_bera"), "low", "non_normal"),
    ]
    found = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("finding"))) for t, s, c in rules]))
    good = F.array(F.struct(F.lit("good").alias("severity"), F.lit("none").alias("finding")))
    return hit.select(*by, F.inline(F.when(F.size(found) > 0, found).otherwise(good)))
