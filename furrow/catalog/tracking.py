"""Champions, gates and forecast tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.catalog.base import H, harvest, harvest_full, query, r, rs, table
from furrow.operators import champion as C
from furrow.operators import tracking as T

# Model results of every farm and three models, from the harvest sums.
RES = f"""{H}, g AS (SELECT fundo AS variety, formato AS model_type, avg(kg_ha) AS a, avg(h_ef) AS b, count(*) AS n, stddev_samp(kg_ha) AS sd FROM h GROUP BY ALL),
res AS (SELECT variety, model_type, round(a / 2, 4) AS oof_mape, round(sd, 4) AS mae_test, round(sd - b + 1 + (n % 7), 4) AS mae_train, round(b - 1 - (n % 7), 4) AS gap, cast(n % 11 AS double) AS elapsed_seconds,
  round((a - 24) / 20, 4) AS baseline_skill, CASE WHEN n % 5 > 0 THEN round(a + (n % 9), 4) END AS temporal_mape, round((a - 25) / 10, 4) AS temporal_skill, cast(n % 4 AS integer) AS temporal_folds, round(1 - a / 50, 4) AS r2, round(sd, 4) AS mae FROM g),
rel AS (SELECT *, abs(gap) / mae_test AS gap_rel FROM res),
el AS (SELECT *, max(cast(gap_rel <= 0.4 AS integer)) OVER (PARTITION BY variety) AS any_ok FROM rel),
el2 AS (SELECT *, min(oof_mape) FILTER (gap_rel <= 0.4 OR any_ok = 0) OVER (PARTITION BY variety) AS best FROM el),
sel AS (SELECT *, row_number() OVER (PARTITION BY variety ORDER BY CASE WHEN (gap_rel <= 0.4 OR any_ok = 0) AND oof_mape <= best + 0.5 THEN 0 ELSE 1 END, elapsed_seconds, model_type) AS rn FROM el2)"""


def _results(spark, sf):
    g = harvest(spark, sf).groupBy(F.col("fundo").alias("variety"), F.col("formato").alias("model_type")).agg(
        F.avg("kg_ha").alias("a"), F.avg("h_ef").alias("b"), F.count(F.lit(1)).alias("n"), F.stddev_samp("kg_ha").alias("sd")
    )
    a, b, n, sd = (F.col(c) for c in ("a", "b", "n", "sd"))
    return g.select(
        "variety", "model_type", F.round(a / 2, 4).alias("oof_mape"), F.round(sd, 4).alias("mae_test"), F.round(sd - b + 1 + (n % 7), 4).alias("mae_train"),
        F.round(b - 1 - (n % 7), 4).alias("gap"), (n % 11).cast("double").alias("elapsed_seconds"), F.round((a - 24) / 20, 4).alias("baseline_skill"),
        F.when(n % 5 > 0, F.round(a + (n % 9), 4)).alias("temporal_mape"), F.round((a - 25) / 10, 4).alias("temporal_skill"), (n % 4).cast("int").alias("temporal_folds"),
        F.round(1 - a / 50, 4).alias("r2"), F.round(sd, 4).alias("mae"),
    )


@query("select_champion", f"{RES} SELECT variety, model_type, oof_mape, {rs('gap_rel', 5)} AS gap_rel FROM sel WHERE rn = 1")
def select_champion(spark, sf):
    return C.select_champion(_results(spark, sf)).select("variety", "model_type", "oof_mape", r("gap_rel", 5).alias("gap_rel"))


_NEXT = """el{k} AS (SELECT variety, model_type, oof_mape, gap_rel, elapsed_seconds, max(cast(gap_rel <= 0.4 AS integer)) OVER (PARTITION BY variety) AS any_ok FROM {src} WHERE rn > 1),
em{k} AS (SELECT *, min(oof_mape) FILTER (gap_rel <= 0.4 OR any_ok = 0) OVER (PARTITION BY variety) AS best FROM el{k}),
sel{k} AS (SELECT *, row_number() OVER (PARTITION BY variety ORDER BY CASE WHEN (gap_rel <= 0.4 OR any_ok = 0) AND oof_mape <= best + 0.5 THEN 0 ELSE 1 END, elapsed_seconds, model_type) AS rn FROM em{k})"""
RANKED = f"{RES}, {_NEXT.format(k='b', src='sel')}, {_NEXT.format(k='c', src='selb')}, rk AS (SELECT variety, model_type, 1 AS rank FROM sel WHERE rn = 1 UNION ALL SELECT variety, model_type, 2 FROM selb WHERE rn = 1 UNION ALL SELECT variety, model_type, 3 FROM selc WHERE rn = 1)"


@query("rank_models", f"{RANKED} SELECT * FROM rk")
def rank_models(spark, sf):
    return C.rank_models(_results(spark, sf), 3).select("variety", "model_type", "rank")


@query("champion_summary", f"""{RANKED} SELECT variety, model_type, rank, rank = 1 AS is_champion, abs(gap) AS abs_gap, {rs('oof_mape + 0.05 * greatest(gap, 0)')} AS composite, mae_test, r2,
  0.4::double AS gap_gate_rel, 0.5::double AS oof_mape_pp FROM rk JOIN res USING (variety, model_type)""")
def champion_summary(spark, sf):
    out = C.champion_summary(_results(spark, sf), 3)
    return out.select("variety", "model_type", "rank", "is_champion", "abs_gap", r("composite").alias("composite"), "mae_test", "r2", "gap_gate_rel", "oof_mape_pp")


@query("composite_score", f"{RES} SELECT variety, model_type, {rs('coalesce(CASE WHEN elapsed_seconds > 3 THEN oof_mape END + 0.05 * greatest(gap, 0), mae_test + 0.5 * greatest(gap, 0))')} AS score FROM res")
def composite_score(spark, sf):
    res = _results(spark, sf).withColumn("oof_mape", F.when(F.col("elapsed_seconds") > 3, F.col("oof_mape")))
    return res.select("variety", "model_type", r(C.composite_score()).alias("score"))


@query("justify", f"""{RES} SELECT s.variety, c.model_type AS champion, s.model_type AS rival, CASE WHEN s.gap_rel > 0.4 AND c.gap_rel <= 0.4 THEN 'gap_gate' WHEN s.oof_mape - c.oof_mape > 0.5 THEN 'generalization'
  WHEN s.elapsed_seconds - c.elapsed_seconds > 0 THEN 'efficiency' ELSE 'stable_order' END AS reason, {rs('s.oof_mape - c.oof_mape', 5)} AS d_mape FROM sel s JOIN sel c ON s.variety = c.variety AND c.rn = 1 WHERE s.rn > 1""")
def justify(spark, sf):
    return C.justify(_results(spark, sf)).select("variety", "champion", "rival", "reason", r("d_mape", 5).alias("d_mape"))


@query("quality_gate", f"""{RES}, q AS (SELECT *, CASE WHEN NOT oof_mape <= 12.9 THEN 'oof_mape' WHEN baseline_skill < 0.05 THEN 'baseline_skill'
  WHEN temporal_mape IS NULL OR temporal_folds < 2 THEN 'temporal_evidence' WHEN temporal_mape > 30 OR temporal_skill < 0 THEN 'temporal_quality' END AS reason FROM sel WHERE rn = 1)
  SELECT variety, model_type, reason, reason IS NULL AS passed, CASE WHEN reason IS NULL AND gap_rel > 0.4 THEN 'gap' END AS warning FROM q""".replace("12.9", "25"))
def quality_gate(spark, sf):
    champs = C.select_champion(_results(spark, sf)).withColumn("max_temporal_mape", F.lit(30.0))
    return C.quality_gate(champs, require_temporal=True).select("variety", "model_type", "reason", "passed", "warning")


@query("temporal_warning", f"{RES} SELECT variety, model_type, (coalesce(temporal_mape > 30, false) OR r2 < 0.2) AND temporal_folds >= 2 AS warn FROM res")
def temporal_warning(spark, sf):
    return _results(spark, sf).select("variety", "model_type", C.temporal_warning(r2="r2").alias("warn"))


@query("promotion_gate", f"""{RES}, c AS (SELECT * FROM sel WHERE rn = 1), p AS (SELECT variety, min(oof_mape) AS prod FROM res WHERE model_type = 'A' AND elapsed_seconds > 2 GROUP BY 1)
  SELECT variety, CASE WHEN NOT oof_mape <= 12.8 THEN 'absolute' WHEN oof_mape >= prod THEN 'not_better' END AS reason, NOT (oof_mape > 12.8 OR coalesce(oof_mape >= prod, false)) AS promoted FROM c LEFT JOIN p USING (variety)""")
def promotion_gate(spark, sf):
    res = _results(spark, sf)
    prod = res.where("model_type = 'A' AND elapsed_seconds > 2").select("variety", "oof_mape")
    return C.promotion_gate(C.select_champion(res), prod, 12.8).select("variety", "reason", "promoted")


@query("overfit_badge", f"""{RES} SELECT variety, model_type, CASE WHEN (mae_test - mae_train) / mae_test > 0.3 OR r2 - 0.38 > 0.15 THEN 'sobreajuste' WHEN (mae_test - mae_train) / mae_test > 0.15 OR r2 - 0.38 > 0.08 THEN 'sobreajuste_leve' ELSE 'generaliza' END AS badge FROM res""")
def overfit_badge(spark, sf):
    c = F.col
    return _results(spark, sf).select("variety", "model_type", C.overfit_badge(c("mae_train"), c("mae_test"), c("r2"), F.lit(0.38)).alias("badge"))


@query("coverage", f"""{RES} SELECT count(DISTINCT variety) AS total, count(DISTINCT variety) FILTER (oof_mape < 12) AS n_with_model, count(DISTINCT variety) - count(DISTINCT variety) FILTER (oof_mape < 12) AS pending,
  {rs('count(DISTINCT variety) FILTER (oof_mape < 12) * 100.0 / count(DISTINCT variety)', 4)} AS coverage_pct FROM res""")
def coverage(spark, sf):
    res = _results(spark, sf)
    return C.coverage(res, res.where("oof_mape < 12")).select("total", "n_with_model", "pending", r("coverage_pct", 4).alias("coverage_pct"))


@query("quality_board", f"""{RES}, v AS (SELECT variety || model_type AS variety, r2, mae FROM res) SELECT count(*) AS n_models, arg_max(variety, (r2, variety)) AS best_r2_name, max(r2) AS best_r2, arg_max(variety, (mae, variety)) AS worst_mae_name, max(mae) AS worst_mae,
  {rs('avg(r2)')} AS avg_r2, {rs('avg(mae)')} AS avg_mae FROM v""")
def quality_board(spark, sf):
    out = C.quality_board(_results(spark, sf).select(F.concat("variety", "model_type").alias("variety"), "r2", "mae"))
    return out.withColumns({"avg_r2": r("avg_r2"), "avg_mae": r("avg_mae")})


@query("quality_ranking", f"{RES} SELECT variety, r2, cast(rank() OVER (ORDER BY r2 DESC) AS integer) AS rank FROM sel WHERE rn = 1")
def quality_ranking(spark, sf):
    return C.quality_ranking(C.select_champion(_results(spark, sf)).select("variety", "r2"))


@query("latest_champion", f"{RES} SELECT variety, arg_max(model_type, (elapsed_seconds, model_type)) AS model_type, max(elapsed_seconds) AS modified FROM res GROUP BY 1")
def latest_champion(spark, sf):
    rec = _results(spark, sf).select("variety", "model_type", F.col("elapsed_seconds").alias("modified"))
    return C.latest_champion(rec)


@query("run_aggregate", f"""{RES}, c AS (SELECT variety, CASE WHEN oof_mape < 12.9 THEN model_type END AS model_type FROM sel WHERE rn = 1)
  SELECT count(*) AS n_varieties, count(*) FILTER (model_type IS NULL) AS n_failed, count(*) FILTER (model_type IS NOT NULL) AS n_champions, list_aggregate(list(variety ORDER BY variety) FILTER (model_type IS NULL), 'string_agg', ',') AS failed FROM c""")
def run_aggregate(spark, sf):
    champs = C.select_champion(_results(spark, sf)).withColumn("model_type", F.when(F.col("oof_mape") < 12.9, F.col("model_type")))
    out = C.run_aggregate(champs)
    return out.select("n_varieties", "n_failed", F.size("champions").cast("bigint").alias("n_champions"), F.array_join("failed", ",").alias("failed"))


# Forecasts: two per record, the later one kept; actuals: the record itself.
TR = f"""{H}, fc AS (SELECT row_id AS id, fundo, formato, fecha, h_ef AS created_at, round(kg_ha + (h_ef - 4) * 1.3, 4) AS kghora_pred, kg_ha AS fc_kg_ha FROM h WHERE h_ef > 2),
  ac AS (SELECT row_id AS id, fundo, formato, fecha, kg_ha AS kg_jr_h, CASE WHEN h_ef <> 3 THEN kg_ha + 1 END AS re_kg_ha FROM h WHERE h_ef < 8),
  f1 AS (SELECT * FROM fc QUALIFY row_number() OVER (PARTITION BY fundo, formato, fecha ORDER BY created_at DESC, id DESC) = 1), a1 AS (SELECT * FROM ac QUALIFY row_number() OVER (PARTITION BY fundo, formato, fecha ORDER BY id DESC) = 1),
  p AS (SELECT fundo, formato, fecha, kghora_pred AS pred_original, kg_jr_h AS real, coalesce(re_kg_ha, fc_kg_ha) AS kg_ha, kghora_pred - kg_jr_h AS error_total, abs(kghora_pred - kg_jr_h) / kg_jr_h * 100 AS abs_pct_error FROM f1 JOIN a1 USING (fundo, formato, fecha)),
  dc AS (SELECT *, CASE WHEN kg_ha > 5 THEN kg_ha * 0.9 + 2 END AS pred_on_real FROM p),
  wk AS (SELECT formato, strftime(fecha, '%G-W%V') AS week, sum(pred_original) AS proj_sum, sum(real) AS real_sum, count(*) AS n, (sum(pred_original) - sum(real)) / sum(real) * 100 AS pct_diff FROM p GROUP BY ALL)"""


def _sides(spark, sf):
    h = harvest(spark, sf)
    fc = h.where("h_ef > 2").select(
        F.col("row_id").alias("id"), "fundo", "formato", "fecha", F.col("h_ef").alias("created_at"), F.round(F.col("kg_ha") + (F.col("h_ef") - 4) * 1.3, 4).alias("kghora_pred"), "kg_ha"
    )
    ac = h.where("h_ef < 8").select(F.col("row_id").alias("id"), "fundo", "formato", "fecha", F.col("kg_ha").alias("kg_jr_h"), F.when(F.col("h_ef") != 3, F.col("kg_ha") + 1).alias("kg_ha"))
    return fc, ac


def _points(spark, sf):
    return T.accuracy_points(*_sides(spark, sf))


def _parts(spark, sf):
    p = T.coalesce_actual_inputs(_points(spark, sf))
    return T.error_decomposition(p.withColumn("pred_on_real", F.when(F.col("kg_ha") > 5, F.col("kg_ha") * 0.9 + 2)))


@query("match_forecast_actual", f"{TR} SELECT fundo, formato, fecha, pred_original, real FROM p")
def match_forecast_actual(spark, sf):
    return T.match_forecast_actual(*_sides(spark, sf)).select("fundo", "formato", "fecha", "pred_original", "real")


@query("coalesce_actual_inputs", f"{TR} SELECT fundo, formato, fecha, kg_ha FROM p")
def coalesce_actual_inputs(spark, sf):
    return T.coalesce_actual_inputs(T.match_forecast_actual(*_sides(spark, sf))).select("fundo", "formato", "fecha", "kg_ha")


@query("accuracy_points", f"{TR} SELECT fundo, formato, fecha, {rs('error_total', 4)} AS error_total, {rs('abs_pct_error', 4)} AS abs_pct_error FROM p")
def accuracy_points(spark, sf):
    return _points(spark, sf).select("fundo", "formato", "fecha", r("error_total", 4).alias("error_total"), r("abs_pct_error", 4).alias("abs_pct_error"))


@query("error_decomposition", f"{TR} SELECT fundo, formato, fecha, {rs('pred_on_real - real', 4)} AS error_model, {rs('pred_original - pred_on_real', 4)} AS error_data FROM dc")
def error_decomposition(spark, sf):
    return _parts(spark, sf).select("fundo", "formato", "fecha", r("error_model", 4).alias("error_model"), r("error_data", 4).alias("error_data"))


@query("weekly_aggregate", f"{TR} SELECT formato, week, {rs('proj_sum', 3)} AS proj_sum, {rs('real_sum', 3)} AS real_sum, n, {rs('pct_diff', 3)} AS pct_diff FROM wk")
def weekly_aggregate(spark, sf):
    out = T.weekly_aggregate(_points(spark, sf), ["formato"])
    return out.select("formato", "week", r("proj_sum", 3).alias("proj_sum"), r("real_sum", 3).alias("real_sum"), "n", r("pct_diff", 3).alias("pct_diff"))


_KPI = f"""count(*) AS n_points, {rs('avg(abs(error_total))', 4)} AS mae, {rs('avg(abs_pct_error)', 4)} AS mape, count(abs_pct_error) > 0 AS has_mape, {rs('avg(error_total)', 4)} AS bias,
  CASE WHEN avg(abs_pct_error) < 10 THEN 'ok' WHEN avg(abs_pct_error) < 20 THEN 'warning' ELSE 'alert' END AS verdict, CASE WHEN avg(error_total) > 0 THEN 'sobreestima' ELSE 'subestima' END AS bias_direction,
  CASE WHEN avg(abs_pct_error) > 15 THEN 'warning' ELSE 'success' END AS mape_flag, CASE WHEN abs(avg(error_total)) > greatest(avg(abs(error_total)) * 0.5, 1e-9) THEN 'warning' ELSE 'success' END AS bias_flag"""


def _kpi(df):
    return df.withColumns({c: r(c, 4) for c in ("mae", "mape", "bias")})


@query("tracking_kpis", f"{TR} SELECT fundo, {_KPI} FROM p GROUP BY 1")
def tracking_kpis(spark, sf):
    return _kpi(T.tracking_kpis(_points(spark, sf), ["fundo"]))


@query("decomposition_kpis", f"""{TR} SELECT fundo, count(*) AS n, {rs('avg(abs(pred_original - pred_on_real))', 4)} AS mean_data, {rs('avg(abs(pred_on_real - real))', 4)} AS mean_model,
  CASE WHEN avg(abs(pred_original - pred_on_real)) > avg(abs(pred_on_real - real)) THEN 'data' ELSE 'model' END AS predominant FROM dc WHERE pred_on_real IS NOT NULL GROUP BY 1""")
def decomposition_kpis(spark, sf):
    out = T.decomposition_kpis(_parts(spark, sf), ["fundo"])
    return out.withColumns({c: r(c, 4) for c in ("mean_data", "mean_model")})


@query("weekly_report", f"""{TR}, wr AS (SELECT * REPLACE ({rs('pct_diff')} AS pct_diff) FROM wk) SELECT formato, count(*) AS n_weeks, {rs('sum(real_sum) * 100 / sum(proj_sum)', 4)} AS compliance, CASE WHEN abs(100 - sum(real_sum) * 100 / sum(proj_sum)) < 10 THEN 'success' ELSE 'warning' END AS compliance_flag,
  arg_min(week, (abs(pct_diff), week)) AS best_week, {rs('arg_min(pct_diff, (abs(pct_diff), week))', 4)} AS best_pct, arg_max(week, (abs(pct_diff), week)) AS worst_week, {rs('arg_max(pct_diff, (abs(pct_diff), week))', 4)} AS worst_pct,
  count(*) FILTER (abs(pct_diff) <= 10) AS n_green, count(*) FILTER (abs(pct_diff) > 10 AND abs(pct_diff) <= 20) AS n_amber, count(*) FILTER (abs(pct_diff) > 20) AS n_red FROM wr GROUP BY 1""")
def weekly_report(spark, sf):
    weeks = T.weekly_aggregate(_points(spark, sf), ["formato"]).withColumn("pct_diff", r("pct_diff"))
    out = T.weekly_report(weeks, ["formato"])
    return out.withColumns({c: r(c, 4) for c in ("compliance", "best_pct", "worst_pct")})


@query("filter_points", f"{TR} SELECT fundo, formato, fecha, real FROM p WHERE fundo IN ('3', '17') AND strftime(fecha, '%G-W%V') IN ('1998-W10', '1998-W11', '1999-W01')")
def filter_points(spark, sf):
    return T.filter_points(_points(spark, sf), ["3", "17"], ["1998-W10", "1998-W11", "1999-W01"]).select("fundo", "formato", "fecha", "real")


@query("filter_options", f"{TR} SELECT DISTINCT 'farm' AS kind, fundo AS value FROM p UNION ALL SELECT DISTINCT 'week', strftime(fecha, '%G-W%V') FROM p")
def filter_options(spark, sf):
    return T.filter_options(_points(spark, sf))


@query("live_accuracy", f"{TR} SELECT {_KPI}, (SELECT arg_max(fundo, (n, fundo)) FROM (SELECT fundo, count(*) AS n FROM p GROUP BY 1)) AS top_variety, (SELECT max(n) FROM (SELECT count(*) AS n FROM p GROUP BY fundo)) AS n_top FROM p")
def live_accuracy(spark, sf):
    return _kpi(T.live_accuracy(_points(spark, sf), "fundo"))


@query("forecast_histogram", f"""{TR}, l AS (SELECT min(kghora_pred) AS lo, max(kghora_pred) AS hi, avg(kghora_pred) AS mean FROM fc) SELECT formato, cast(least(floor((kghora_pred - lo) / ((hi - lo) / 20)), 19) AS integer) AS bin, {rs('mean', 4)} AS mean, count(*) AS n FROM fc, l GROUP BY ALL""")
def forecast_histogram(spark, sf):
    return T.forecast_histogram(_sides(spark, sf)[0], "kghora_pred", "formato").withColumn("mean", r("mean", 4))


@query("score_summary", f"{TR} SELECT formato, count(*) AS n_scored, {rs('avg(kghora_pred)', 4)} AS mean_pred FROM fc GROUP BY 1")
def score_summary(spark, sf):
    return T.score_summary(_sides(spark, sf)[0], "formato", "kghora_pred").withColumn("mean_pred", r("mean_pred", 4))
