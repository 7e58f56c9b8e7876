"""Choosing, explaining and gating models from a table of results.

One row per variety and model: ``variety, model_type, oof_mape, mae_test, mae_train, gap,
elapsed_seconds`` and, where known, full-fit and temporal metrics. A variety has a
handful of models, so windows per variety are tiny.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.columns import (
    MAPE_TIE,
    MAX_GAP_REL,
    MAX_MAPE,
    MAX_TEMPORAL_MAPE,
    MIN_BASELINE_SKILL,
    MIN_TEMPORAL_FOLDS,
    MIN_TEMPORAL_SKILL,
    WARN_TEMPORAL_MAPE,
    WARN_TEMPORAL_R2,
)
from furrow.operators.groups import attach

INF = float("inf")


def gap_rel() -> Column:
    """|gap| / test MAE; infinite without a usable test MAE."""
    mae = F.col("mae_test")
    return F.when((mae > 0) & (mae < INF), F.abs(F.coalesce(F.col("gap"), F.lit(0.0))) / mae).otherwise(F.lit(INF))


def _order() -> list[Column]:
    return [F.asc("elapsed_seconds"), F.asc("model_type")]


def _mark(df: DataFrame, key: str) -> DataFrame:
    """``_first`` is true for the model that the rule selects in each variety."""
    each = Window.partitionBy(key)
    passed = F.col("gap_rel") <= MAX_GAP_REL
    marked = df.withColumn("_any", F.max(passed.cast("int")).over(each))
    eligible = passed | (F.col("_any") == 0)
    mape = F.coalesce(F.col("oof_mape"), F.lit(INF))
    marked = marked.withColumn("_best", F.min(F.when(eligible, mape)).over(each))
    tied = eligible & ((mape <= F.col("_best") + MAPE_TIE) | (F.col("_best") == INF))
    ordered = each.orderBy(F.desc(tied.cast("int")), *_order())
    return marked.withColumn("_first", F.row_number().over(ordered) == 1).drop("_any", "_best")


def select_champion(results: DataFrame, key: str = "variety") -> DataFrame:
    """Gap gate (unless all fail), within 0.5 points of the best MAPE, fastest, name."""
    return _mark(results.withColumn("gap_rel", gap_rel()), key).where("_first").drop("_first")


def rank_models(results: DataFrame, models: int, key: str = "variety") -> DataFrame:
    """The selection repeated on the remainder; ``models`` is the most models per variety."""
    left = results.withColumn("gap_rel", gap_rel())
    out = None
    for place in range(1, models + 1):
        marked = _mark(left, key)
        chosen = marked.where("_first").drop("_first").withColumn("rank", F.lit(place))
        left = marked.where("NOT _first").drop("_first")
        out = chosen if out is None else out.unionByName(chosen)
    return out


def composite_score() -> Column:
    """Auxiliary score: MAPE + 0.05 gap, or MAE + 0.5 gap without a MAPE."""
    gap = F.greatest(F.coalesce(F.col("gap"), F.lit(0.0)), F.lit(0.0))
    return F.coalesce(F.col("oof_mape") + 0.05 * gap, F.col("mae_test") + 0.5 * gap)


def justify(results: DataFrame, key: str = "variety") -> DataFrame:
    """Why each rival lost to its champion."""
    marked = _mark(results.withColumn("gap_rel", gap_rel()), key)
    champ = marked.where("_first").select(
        key, F.col("model_type").alias("champion"), F.col("oof_mape").alias("_m"), F.col("elapsed_seconds").alias("_t"), F.col("gap_rel").alias("_g")
    )
    rivals = attach(marked.where("NOT _first"), champ, [key])
    d_mape, d_time = F.col("oof_mape") - F.col("_m"), F.col("elapsed_seconds") - F.col("_t")
    failed = (F.col("gap_rel") > MAX_GAP_REL) & (F.col("_g") <= MAX_GAP_REL)
    reason = F.when(failed, "gap_gate").when(d_mape > MAPE_TIE, "generalization").when(d_time > 0, "efficiency").otherwise("stable_order")
    return rivals.select(key, "champion", F.col("model_type").alias("rival"), reason.alias("reason"), d_mape.alias("d_mape"), d_time.alias("d_time"))


def champion_summary(results: DataFrame, models: int, key: str = "variety") -> DataFrame:
    """Ranking with every metric, the tolerances and the champion flag."""
    ranked = rank_models(results, models, key)
    return ranked.withColumns({
        "is_champion": F.col("rank") == 1,
        "abs_gap": F.abs("gap"),
        "composite": composite_score(),
        "gap_gate_rel": F.lit(MAX_GAP_REL),
        "oof_mape_pp": F.lit(MAPE_TIE),
    })


def temporal_warning(mape: str = "temporal_mape", r2: str = "temporal_r2", folds: str = "temporal_folds") -> Column:
    """Poor forecast of an unseen year, judged on two folds or more."""
    poor = F.coalesce(F.col(mape) > WARN_TEMPORAL_MAPE, F.lit(False)) | F.coalesce(F.col(r2) < WARN_TEMPORAL_R2, F.lit(False))
    return poor & F.coalesce(F.col(folds) >= 2, F.lit(True))


def quality_gate(champions: DataFrame, require_temporal: bool = False, smoke: bool = False, exante: bool = False, enabled: bool = True, shadow: bool = False, shadow_max: float = 35.0) -> DataFrame:
    """Pass or fail with a reason; the gap only warns.

    Optional per-variety limits in ``max_temporal_mape``, ``min_temporal_baseline_skill``
    and ``min_temporal_folds`` win over the defaults. Missing temporal evidence fails.
    """
    def limit(col: str, default: float) -> Column:
        return F.coalesce(F.col(col), F.lit(default)) if col in champions.columns else F.lit(default)

    df = champions if "gap_rel" in champions.columns else champions.withColumn("gap_rel", gap_rel())
    c = F.col
    reason = F.lit(None).cast("string")
    checks: list[tuple[Column, str]] = []
    if shadow:
        fit = F.coalesce(c("oof_mape") <= shadow_max, F.lit(False))
        return df.withColumns({"passed": F.lit(False), "reason": F.when(fit, "shadow_apt").otherwise("shadow_rejected"), "warning": F.lit(None).cast("string")})
    for blocked, name in ((smoke, "smoke"), (not enabled, "disabled"), (exante, "exante")):
        if blocked:
            checks.append((F.lit(True), name))
    checks.append((~F.coalesce(c("oof_mape") <= MAX_MAPE, F.lit(False)), "oof_mape"))
    checks.append((F.coalesce(c("baseline_skill") < MIN_BASELINE_SKILL, F.lit(False)), "baseline_skill"))
    if require_temporal:
        known = c("temporal_mape").isNotNull() & c("temporal_skill").isNotNull() & (c("temporal_folds") >= limit("min_temporal_folds", MIN_TEMPORAL_FOLDS))
        good = (c("temporal_mape") <= limit("max_temporal_mape", MAX_TEMPORAL_MAPE)) & (c("temporal_skill") >= limit("min_temporal_baseline_skill", MIN_TEMPORAL_SKILL))
        checks.append((~F.coalesce(known, F.lit(False)), "temporal_evidence"))
        checks.append((~F.coalesce(good, F.lit(False)), "temporal_quality"))
    for test, name in reversed(checks):
        reason = F.when(test, name).otherwise(reason)
    warn = F.when(c("gap_rel") > MAX_GAP_REL, "gap")
    return df.withColumn("reason", reason).withColumns({"passed": F.col("reason").isNull(), "warning": F.when(F.col("reason").isNull(), warn)})


def promotion_gate(candidates: DataFrame, production: DataFrame, max_mape: float = MAX_MAPE, key: str = "variety") -> DataFrame:
    """Candidate within the limit and better than what is in production."""
    prod = production.select(key, F.col("oof_mape").alias("_prod"))
    out = attach(candidates, prod, [key])
    reason = F.when(~F.coalesce(F.col("oof_mape") <= max_mape, F.lit(False)), "absolute").when(F.col("oof_mape") >= F.col("_prod"), "not_better")
    return out.withColumn("reason", reason).withColumn("promoted", F.col("reason").isNull()).drop("_prod")


def overfit_badge(train_mae: Column, test_mae: Column, train_r2: Column, test_r2: Column) -> Column:
    """Health label from the train-test gaps."""
    mae_gap = F.try_divide(test_mae - train_mae, test_mae)
    r2_gap = train_r2 - test_r2

    def over(mae: float, r2: float) -> Column:
        return F.coalesce(mae_gap > mae, F.lit(False)) | F.coalesce(r2_gap > r2, F.lit(False))

    return F.when(mae_gap.isNull() & r2_gap.isNull(), "sin_datos").when(over(0.30, 0.15), "sobreajuste").when(over(0.15, 0.08), "sobreajuste_leve").otherwise("generaliza")


def coverage(varieties: DataFrame, models: DataFrame, key: str = "variety") -> DataFrame:
    """Share of varieties with a model."""
    have = models.select(key).distinct().withColumn("_has", F.lit(1))
    joined = attach(varieties.select(key).distinct(), have, [key])
    out = joined.agg(F.count(F.lit(1)).alias("total"), F.count("_has").alias("n_with_model"))
    pct = F.coalesce(F.try_divide(F.col("n_with_model") * 100.0, F.col("total")), F.lit(0.0))
    grade = F.when(F.col("coverage_pct") >= 80, "success").when(F.col("coverage_pct") >= 50, "warning").otherwise("danger")
    return out.withColumn("pending", F.col("total") - F.col("n_with_model")).withColumn("coverage_pct", pct).withColumn("grade", grade)


def quality_board(models: DataFrame, key: str = "variety") -> DataFrame:
    """Best R2, worst MAE and the averages."""
    return models.agg(
        F.count(F.lit(1)).alias("n_models"),
        F.max_by(key, F.struct("r2", key)).alias("best_r2_name"),
        F.max("r2").alias("best_r2"),
        F.max_by(key, F.struct("mae", key)).alias("worst_mae_name"),
        F.max("mae").alias("worst_mae"),
        F.avg("r2").alias("avg_r2"),
        F.avg("mae").alias("avg_mae"),
    )


def quality_ranking(models: DataFrame, key: str = "variety") -> DataFrame:
    """One row per variety, best R2 first."""
    return models.withColumn("rank", F.rank().over(Window.orderBy(F.desc("r2"))))


def latest_champion(records: DataFrame, key: str = "variety", stamp: str = "modified") -> DataFrame:
    """Newest record per variety by a mergeable maximum."""
    rest = [c for c in records.columns if c != key]
    newest = records.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(stamp, *[c for c in rest if c != stamp])).alias("_r"))
    return newest.select(key, "_r.*")


def run_aggregate(champions: DataFrame, key: str = "variety") -> DataFrame:
    """Counts, failures and the champion of every variety of a run."""
    ok = F.col("model_type").isNotNull()
    return champions.agg(
        F.count(F.lit(1)).alias("n_varieties"),
        F.count_if(~ok).alias("n_failed"),
        F.sort_array(F.collect_list(F.when(~ok, F.col(key)))).alias("failed"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(ok, F.struct(key, "model_type"))))).alias("champions"),
    )
