"""Regression metrics as aggregate expressions, optionally weighted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.columns import MIN_DENOM


def _sum(x: Column, w: Column | None) -> Column:
    return F.sum(x if w is None else x * w)


def _mean(x: Column, w: Column | None, where: Column | None = None) -> Column:
    """Weighted mean over non-null x, optionally only where a condition holds."""
    x = x if where is None else F.when(where, x)
    if w is None:
        return F.avg(x)
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def metric_columns(y: Column, p: Column, min_denom: Column | float = MIN_DENOM, w: Column | None = None) -> dict[str, Column]:
    """Name -> aggregate over rows with target ``y`` and prediction ``p``."""
    floor = min_denom if isinstance(min_denom, Column) else F.lit(float(min_denom))
    err = F.abs(y - p)
    ok = F.abs(y) >= floor
    size = F.abs(y) + F.abs(p)
    one = F.when(y.isNotNull(), F.lit(1.0))
    n, sy, syy = _sum(one, w), _sum(y, w), _sum(y * y, w)
    sse = _sum((y - p) * (y - p), w)
    sst = F.var_pop(y) * F.count(y) if w is None else syy - F.try_divide(sy * sy, n)
    return {
        "mae": _mean(err, w),
        "rmse": F.sqrt(_mean((y - p) * (y - p), w)),
        "r2": F.when(sst > 0, 1.0 - F.try_divide(sse, sst)).when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)),
        "mape": _mean(err / F.nullif(F.abs(y), F.lit(0.0)), w, ok) * 100.0,
        "wape": F.try_divide(_sum(err, w), _sum(F.abs(y), w)) * 100.0,
        "smape": _mean(F.try_divide(2.0 * err, size), w) * 100.0,
        "bias": _mean(p - y, w),
        "mape_n_excluded": F.count_if(F.abs(y) < floor),
    }


def mape_safe(y: Column, p: Column, min_denom: Column | float = MIN_DENOM) -> Column:
    return metric_columns(y, p, min_denom)["mape"]


def mae_skill(model_mae: Column, base_mae: Column) -> Column:
    """1 - model / baseline; null without a usable baseline."""
    return F.when(base_mae > 0, 1.0 - model_mae / base_mae)
