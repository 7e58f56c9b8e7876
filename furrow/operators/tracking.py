"""Predicted against real values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.columns import DATE, FARM, FORMAT
from furrow.functions.scalar import iso_week, width_bin_left
from furrow.operators.groups import attach

KEYS = [FARM, FORMAT, DATE]
INPUTS = ["kg_ha", "dpc", "ha", "dia_cosecha", "indus_pct", "p_baya"]


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key by a mergeable maximum: copies never meet in one sort."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return newest.select(*keys, "_r.*")


def match_forecast_actual(forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str] = KEYS, scope: Sequence[str] = (), pred: str = "kghora_pred", real: str = "kg_jr_h") -> DataFrame:
    """Latest forecast (by ``created_at``) and last actual (by ``id``) of each key."""
    on = [*scope, *keys]
    f = latest_per_key(forecasts, on, ["created_at", "id"])
    a = latest_per_key(actuals, on, ["id"])
    f = f.select(*on, F.col("id").alias("forecast_id"), F.col(pred).alias("pred_original"), *[F.col(c).alias(f"fc_{c}") for c in INPUTS if c in f.columns])
    a = a.select(*on, F.col(real).alias("real"), *[F.col(c).alias(f"re_{c}") for c in INPUTS if c in a.columns])
    return f.join(a, on)


def coalesce_actual_inputs(matched: DataFrame) -> DataFrame:
    """Inputs for the second prediction: the real value where known, else the forecast's."""
    out = matched
    for c in INPUTS:
        sides = [F.col(n) for n in (f"re_{c}", f"fc_{c}") if n in matched.columns]
        if sides:
            out = out.withColumn(c, F.coalesce(*sides))
    return out.drop(*[n for c in INPUTS for n in (f"re_{c}", f"fc_{c}") if n in matched.columns])


def errors(pred: Column, real: Column) -> dict[str, Column]:
    total = pred - real
    return {"error_total": total, "abs_pct_error": F.when(real != 0, F.abs(total) / real * 100.0)}


def accuracy_points(forecasts: DataFrame, actuals: DataFrame, scope: Sequence[str] = (), **names) -> DataFrame:
    """Matched points with total and percent error."""
    points = match_forecast_actual(forecasts, actuals, scope=scope, **names)
    return points.withColumns(errors(F.col("pred_original"), F.col("real")))


def error_decomposition(points: DataFrame, pred_on_real: str = "pred_on_real") -> DataFrame:
    """total = data error (inputs missed) + model error (what is left)."""
    p = F.col(pred_on_real)
    return points.withColumns({"error_model": p - F.col("real"), "error_data": F.col("pred_original") - p})


def weekly_aggregate(points: DataFrame, by: Sequence[str] = (), date: str = DATE) -> DataFrame:
    """Sums, count and percent difference per ISO week."""
    week = iso_week(F.col(date)).alias("week")
    out = points.groupBy(*by, week).agg(F.sum("pred_original").alias("proj_sum"), F.sum("real").alias("real_sum"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("pct_diff", F.when(F.col("real_sum") != 0, (F.col("proj_sum") - F.col("real_sum")) / F.col("real_sum") * 100.0))


def forecast_verdict(mape: Column) -> Column:
    return F.when(mape < 10, "ok").when(mape < 20, "warning").otherwise("alert")


def tracking_kpis(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MAE, MAPE, bias, verdict and flags."""
    zero = F.lit(0.0)
    out = points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.coalesce(F.avg(F.abs("error_total")), zero).alias("mae"),
        F.coalesce(F.avg("abs_pct_error"), zero).alias("mape"),
        (F.count("abs_pct_error") > 0).alias("has_mape"),
        F.coalesce(F.avg("error_total"), zero).alias("bias"),
    )
    return out.withColumns({
        "verdict": forecast_verdict(F.col("mape")),
        "bias_direction": F.when(F.col("bias") > 0, "sobreestima").otherwise("subestima"),
        "mape_flag": F.when(F.col("mape") > 15, "warning").otherwise("success"),
        "bias_flag": F.when(F.abs("bias") > F.greatest(F.col("mae") * 0.5, F.lit(1e-9)), "warning").otherwise("success"),
    })


def decomposition_kpis(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    out = points.where(F.col("error_model").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("error_data")).alias("mean_data"), F.avg(F.abs("error_model")).alias("mean_model")
    )
    return out.withColumn("predominant", F.when(F.col("mean_data") > F.col("mean_model"), "data").otherwise("model"))


def weekly_light(pct: Column) -> Column:
    return F.when(pct.isNull(), "-").when(F.abs(pct) <= 10, "green").when(F.abs(pct) <= 20, "amber").otherwise("red")


def weekly_report(weeks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Compliance and the best and worst week."""
    key = F.when(F.col("pct_diff").isNotNull(), F.struct(F.abs("pct_diff"), "week"))
    out = weeks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_weeks"),
        F.coalesce(F.try_divide(F.sum("real_sum") * 100.0, F.sum("proj_sum")), F.lit(0.0)).alias("compliance"),
        F.min_by(F.struct("week", "pct_diff", "n"), key).alias("_b"),
        F.max_by(F.struct("week", "pct_diff", "n"), key).alias("_w"),
        F.count_if(F.abs("pct_diff") <= 10).alias("n_green"),
        F.count_if((F.abs("pct_diff") > 10) & (F.abs("pct_diff") <= 20)).alias("n_amber"),
        F.count_if(F.abs("pct_diff") > 20).alias("n_red"),
    )
    flag = F.when(F.abs(100 - F.col("compliance")) < 10, "success").otherwise("warning")
    return out.select(
        *by, "n_weeks", "compliance", flag.alias("compliance_flag"), F.col("_b.week").alias("best_week"), F.col("_b.pct_diff").alias("best_pct"),
        F.col("_w.week").alias("worst_week"), F.col("_w.pct_diff").alias("worst_pct"), "n_green", "n_amber", "n_red",
    )


def filter_points(points: DataFrame, farms: Sequence[str] | None = None, weeks: Sequence[str] | None = None, date: str = DATE) -> DataFrame:
    if farms:
        points = points.where(F.col(FARM).isin(list(farms)))
    if weeks:
        points = points.where(iso_week(F.col(date)).isin(list(weeks)))
    return points


def filter_options(points: DataFrame, date: str = DATE) -> DataFrame:
    """Distinct farms and weeks as (kind, value)."""
    farms = points.select(F.lit("farm").alias("kind"), F.col(FARM).cast("string").alias("value"))
    weeks = points.select(F.lit("week").alias("kind"), iso_week(F.col(date)).alias("value"))
    return farms.unionByName(weeks).distinct()


def live_accuracy(points: DataFrame, key: str) -> DataFrame:
    """KPIs over all varieties and the variety with most points."""
    counts = points.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.agg(F.max_by(key, F.struct("_n", key)).alias("top_variety"), F.max("_n").alias("n_top"))
    return attach(tracking_kpis(points), top)


def forecast_histogram(df: DataFrame, pred: str, by: str, bins: int = 20) -> DataFrame:
    """Bins over the range of all predictions with counts per variety, and the overall mean."""
    span = df.agg(F.min(pred).alias("_lo"), F.max(pred).alias("_hi"), F.avg(pred).alias("mean"))
    out = attach(df, span).withColumn("bin", width_bin_left(F.col(pred), F.col("_lo"), F.col("_hi"), F.lit(bins)))
    return out.groupBy(by, "bin", "mean").agg(F.count(F.lit(1)).alias("n"))


def score_summary(scored: DataFrame, by: str, pred: str) -> DataFrame:
    return scored.groupBy(by).agg(F.count(F.lit(1)).alias("n_scored"), F.avg(pred).alias("mean_pred"))
