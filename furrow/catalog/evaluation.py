"""Folds, weights, errors, bands and reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from furrow.catalog.base import FOLD_SQL, H, HF, S, harvest, harvest_full, query, r, rs, scored, table
from furrow.functions import metrics as M
from furrow.operators import evaluation as E
from furrow.operators import folds as FO
from furrow.operators.groups import attach
from furrow.session import cut

def _rn(part, seed=42):
    p = f"PARTITION BY {part} " if part else ""
    return f"cast((row_number() OVER ({p}ORDER BY md5('{seed}|' || row_id), row_id) - 1) % 5 AS integer)"


@query("kfold", f"{H} SELECT row_id, {_rn('')} AS fold_id FROM h")
def kfold(spark, sf):
    return FO.kfold(harvest(spark, sf).select("row_id"), 5)


@query("stratified_kfold", f"{H} SELECT row_id, {_rn('fundo')} AS fold_id FROM h")
def stratified_kfold(spark, sf):
    return FO.stratified_kfold(harvest(spark, sf).select("row_id", "fundo"), "fundo", 5).select("row_id", "fold_id")


@query("stratify_label", f"""{H}, a AS (SELECT *, count(*) OVER (PARTITION BY fundo, formato) AS n FROM h), b AS (SELECT count(*) FILTER (n < 200) AS rare FROM a)
  SELECT CASE WHEN n < 200 THEN 'RARE' ELSE fundo || '_' || formato END AS strat_label, 'farm_format' AS strategy, count(*) AS n FROM a GROUP BY ALL""")
def stratify_label(spark, sf):
    out = FO.stratify_label(harvest(spark, sf).select("fundo", "formato"), 200)
    return out.groupBy("strat_label", "strategy").agg(F.count(F.lit(1)).alias("n"))


@query("temporal_year_split", f"""{H}, y AS (SELECT DISTINCT year(fecha) AS y FROM h), f AS (SELECT y AS test_year, row_number() OVER (ORDER BY y) - 1 AS fold
  FROM (SELECT y FROM y ORDER BY y DESC LIMIT 3)) SELECT cast(fold AS integer) AS fold, cast(test_year AS integer) AS test_year,
  CASE WHEN year(fecha) < test_year THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(fecha) AS first, max(fecha) AS last
  FROM h JOIN f ON year(fecha) <= test_year GROUP BY ALL""")
def temporal_year_split(spark, sf):
    out = FO.temporal_year_split(harvest(spark, sf).select("fecha"), 3, 2)
    return out.groupBy("fold", "test_year", "role").agg(F.count(F.lit(1)).alias("n"), F.min("fecha").alias("first"), F.max("fecha").alias("last"))


@query("purged_date_split", f"""{H}, d AS (SELECT fecha, row_number() OVER (ORDER BY fecha) - 1 AS i FROM (SELECT DISTINCT fecha FROM h)),
  c AS (SELECT count(*) AS n, least(3, greatest(0, (count(*) - 32) // 10)) AS k, greatest(10, (count(*) - 32) // least(3, greatest(0, (count(*) - 32) // 10))) AS size FROM d),
  f AS (SELECT fold, n - k * size + fold * size AS s, CASE WHEN fold = k - 1 THEN n ELSE n - k * size + (fold + 1) * size END AS e FROM c, (VALUES (0), (1), (2)) t(fold) WHERE fold < k)
  SELECT fold, CASE WHEN i < s - 2 THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(fecha) AS first, max(fecha) AS last
  FROM h JOIN d USING (fecha) JOIN f ON i < s - 2 OR (i >= s AND i < e) WHERE s - 2 >= 30 GROUP BY ALL""")
def purged_date_split(spark, sf):
    out = FO.purged_date_split(harvest(spark, sf).select("fecha"), 3, gap=2)
    return out.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("fecha").alias("first"), F.max("fecha").alias("last"))


@query("recent_window", f"{H} SELECT row_id FROM h WHERE fecha >= (SELECT max(fecha) FROM h) - 365")
def recent_window(spark, sf):
    h = harvest(spark, sf).select("row_id", "fecha")
    return FO.recent_window(h, 365, h.agg(F.max("fecha").alias("m")).scalar()).select("row_id")


@query("temporal_tail_holdout", f"""{H}, p AS (SELECT row_id, row_number() OVER (PARTITION BY fundo ORDER BY fecha, row_id) AS i, count(*) OVER (PARTITION BY fundo) AS n FROM h)
  SELECT row_id, i > n - greatest(1, least(greatest(cast(floor(n * 0.1) AS bigint), 12), n // 3)) AS is_val FROM p""")
def temporal_tail_holdout(spark, sf):
    return FO.temporal_tail_holdout(harvest(spark, sf).select("row_id", "fundo", "fecha"), ["fundo"]).select("row_id", "is_val")


@query("adapt_folds", f"""{H}, n AS (SELECT fundo || formato AS g, count(*) AS n FROM h GROUP BY 1), o AS (SELECT *, greatest(2, least(5, n // 120)) AS o FROM n)
  SELECT g, n, cast(o AS integer) AS outer_folds, cast(greatest(2, least(3, (n * (o - 1) // o) // 150)) AS integer) AS inner_folds FROM o""")
def adapt_folds(spark, sf):
    n = harvest(spark, sf).groupBy(F.concat("fundo", "formato").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumns(FO.adapt_folds(F.col("n"), 5, 3))


W_DENSITY = """s AS (SELECT *, count(*) OVER (PARTITION BY formato) AS n, min(kg_jr_h) OVER (PARTITION BY formato) AS lo, max(kg_jr_h) OVER (PARTITION BY formato) AS hi FROM h),
  b AS (SELECT *, least(greatest(ceil((kg_jr_h - lo) / ((hi - lo) / least(10, greatest(3, n // 40)))) - 1, 0), least(10, greatest(3, n // 40)) - 1) AS bin FROM s),
  c AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY formato, bin) AS w FROM b), d AS (SELECT *, sqrt(least(w, 5 * avg(w) OVER (PARTITION BY formato))) AS w2 FROM c)"""


@query("density_weights", f"{H}, {W_DENSITY} SELECT row_id, {rs('w2 / avg(w2) OVER (PARTITION BY formato)')} AS w FROM d")
def density_weights(spark, sf):
    out = FO.density_weights(harvest(spark, sf), bins=10, by=["formato"])
    return out.select("row_id", r("w_density").alias("w"))


@query("inverse_target_weights", f"""{H}, m AS (SELECT *, median(kg_jr_h) OVER (PARTITION BY formato) AS ref FROM h), c AS (SELECT *, least(greatest(ref / kg_jr_h, 0.2), 5.0) AS w FROM m)
  SELECT row_id, {rs('w / avg(w) OVER (PARTITION BY formato)')} AS w FROM c""")
def inverse_target_weights(spark, sf):
    out = FO.inverse_target_weights(harvest(spark, sf), by=["formato"])
    return out.select("row_id", r("w_inverse").alias("w"))


PEAK = """m AS (SELECT month(fecha) AS mo, avg(kg_jr_h) AS mean FROM h GROUP BY 1 HAVING count(*) >= 5), l AS (SELECT quantile_cont(mean, 0.66) AS hi FROM m),
  p AS (SELECT mo FROM m, l WHERE mean >= hi), b AS (SELECT *, CASE WHEN month(fecha) IN (SELECT mo FROM p) THEN 1.5 ELSE 1.0 END AS w FROM h)"""


@query("season_boost", f"{H}, {PEAK} SELECT row_id, {rs('w / (SELECT avg(w) FROM b)')} AS w FROM b")
def season_boost(spark, sf):
    return FO.season_boost(harvest(spark, sf)).select("row_id", r("w_season").alias("w"))


@query("combine_weights", f"""{H}, b AS (SELECT *, (1 + kg_ha / 50) * CASE WHEN month(fecha) IN (8, 9, 10) THEN 1.5 ELSE 1.0 END / (SELECT avg(CASE WHEN month(fecha) IN (8, 9, 10) THEN 1.5 ELSE 1.0 END) FROM h) AS w FROM h)
  SELECT row_id, {rs('w / (SELECT avg(w) FROM b)')} AS w FROM b""")
def combine_weights(spark, sf):
    df = FO.season_boost(harvest(spark, sf).withColumn("a", 1 + F.col("kg_ha") / 50), [8, 9, 10])
    return FO.combine_weights(df, ["a", "w_season"]).select("row_id", r("sample_weight").alias("w"))


def _metrics_sql(y="y_true", p="y_pred", floor="1.0", digits=4):
    cols = {
        "mae": f"avg(abs({y} - {p}))", "rmse": f"sqrt(avg(({y} - {p}) ^ 2))", "r2": f"1 - sum(({y} - {p}) ^ 2) / (var_pop({y}) * count(*))",
        "mape": f"avg(abs({y} - {p}) / abs({y})) FILTER (abs({y}) >= {floor}) * 100", "wape": f"sum(abs({y} - {p})) / sum(abs({y})) * 100",
        "smape": f"avg(2 * abs({y} - {p}) / (abs({y}) + abs({p}))) * 100", "bias": f"avg({p} - {y})", "median_ae": f"median(abs({y} - {p}))",
    }
    out = ", ".join(f"{rs(e.replace(') FILTER', ') FILTER'), digits)} AS {k}" for k, e in cols.items())
    return f"count(*) AS n, {out}, count(*) FILTER (abs({y}) < {floor}) AS mape_n_excluded"


NAMES = ["mae", "rmse", "r2", "mape", "wape", "smape", "bias", "median_ae"]


def _rounded(df, keys, digits=4):
    return df.select(*keys, "n", *[r(c, digits).alias(c) for c in NAMES], "mape_n_excluded")


@query("regression_metrics", f"{S} SELECT formato, {_metrics_sql(floor='500')} FROM s GROUP BY 1")
def regression_metrics(spark, sf):
    return _rounded(E.regression_metrics(scored(spark, sf), ["formato"], min_denom=500), ["formato"])


@query("mape_safe", f"{S} SELECT fundo, {rs('avg(abs(y_true - y_pred) / y_true) FILTER (abs(y_true) >= 1000) * 100', 4)} AS mape FROM s GROUP BY 1")
def mape_safe(spark, sf):
    out = scored(spark, sf).groupBy("fundo").agg(M.mape_safe(F.col("y_true"), F.col("y_pred"), 1000).alias("mape"))
    return out.select("fundo", r("mape", 4).alias("mape"))


@query("mae_skill", f"{S} SELECT formato, {rs('1 - avg(abs(y_true - y_pred)) / avg(abs(y_true - 3000))')} AS skill FROM s GROUP BY 1")
def mae_skill(spark, sf):
    out = scored(spark, sf).groupBy("formato").agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("a"), F.avg(F.abs(F.col("y_true") - 3000)).alias("b"))
    return out.select("formato", r(M.mae_skill(F.col("a"), F.col("b"))).alias("skill"))


@query("fold_summary", f"""{S}, f AS (SELECT formato, fold_id, avg(abs(y_true - y_pred)) AS mae FROM s GROUP BY ALL)
  SELECT formato, count(*) AS n_folds, {rs('avg(mae)', 4)} AS mae_mean, {rs('stddev_pop(mae)', 4)} AS mae_std FROM f GROUP BY 1""")
def fold_summary(spark, sf):
    folds = E.regression_metrics(scored(spark, sf), ["formato", "fold_id"])
    out = E.fold_summary(folds, ["mae"], ["formato"])
    return out.select("formato", "n_folds", r("mae_mean", 4).alias("mae_mean"), r("mae_std", 4).alias("mae_std"))


@query("relative_floor_metrics", f"{S}, f AS (SELECT s.*, 0.05 * median(abs(y_true)) OVER (PARTITION BY formato) AS fl FROM s) SELECT formato, {_metrics_sql(floor='fl')} FROM f GROUP BY 1")
def relative_floor_metrics(spark, sf):
    return _rounded(E.relative_floor_metrics(scored(spark, sf), ["formato"]), ["formato"])


@query("business_validation", f"""{S}, b AS (SELECT formato, kg_jr AS y_true, y_pred * h_ef AS y_pred, fold_id < 4 AS ok FROM s)
  SELECT formato, 'oof' AS "set", (SELECT count(*) FROM b x WHERE NOT ok AND x.formato = b.formato) AS n_dropped, {_metrics_sql()} FROM b WHERE ok GROUP BY formato
  UNION ALL SELECT formato, 'insample', 0, {_metrics_sql()} FROM b GROUP BY formato""")
def business_validation(spark, sf):
    df = scored(spark, sf).withColumn("oof", F.when(F.col("fold_id") < 4, F.col("y_pred")))
    return _rounded(E.business_validation(df, {"oof": "oof", "insample": "y_pred"}, ["formato"]), ["formato", "set", "n_dropped"])


PT = f"""{S}, p AS (SELECT row_id, fundo, formato, kg_jr AS kg_jr_real, y_pred * h_ef AS kg_jr_pred, abs(y_pred * h_ef - kg_jr) AS error_abs, abs(y_pred * h_ef - kg_jr) * 100 / kg_jr AS error_pct, h_ef, y_pred, fold_id FROM s)"""


@query("prediction_table", f"""{PT} SELECT row_id, {rs('kg_jr_pred', 3)} AS kg_jr_pred, {rs('error_abs', 3)} AS error_abs, {rs('error_pct', 3)} AS error_pct,
  {rs('(y_pred - 100) * h_ef', 3)} AS low, {rs('(y_pred + 100) * h_ef', 3)} AS high, fold_id FROM p""")
def prediction_table(spark, sf):
    out = E.prediction_table(scored(spark, sf).withColumn("hw", F.lit(100.0)), half_width="hw")
    return out.select("row_id", *[r(c, 3).alias(c) for c in ("kg_jr_pred", "error_abs", "error_pct", "low", "high")], "fold_id")


@query("subgroup_summary", f"""{PT} SELECT fundo, count(*) AS n, {rs('avg(kg_jr_real)', 3)} AS mean_real, {rs('avg(kg_jr_pred)', 3)} AS mean_pred, {rs('avg(error_abs)', 3)} AS mae,
  {rs('avg(error_pct)', 3)} AS mean_pct, {rs('max(error_abs)', 3)} AS max_error, cast(row_number() OVER (ORDER BY avg(error_pct) DESC, fundo) AS integer) AS rank FROM p GROUP BY fundo""")
def subgroup_summary(spark, sf):
    t = E.prediction_table(scored(spark, sf), keep=["row_id", "fundo"])
    out = E.subgroup_summary(t, "fundo")
    return out.select("fundo", "n", *[r(c, 3).alias(c) for c in ("mean_real", "mean_pred", "mae", "mean_pct", "max_error")], "rank")


DIMS = """q AS (SELECT quantile_cont(kg_ha, [0, 0.25, 0.5, 0.75, 1]) AS e FROM s), g AS (
  SELECT 'formato' AS dimension, formato AS level, y_true, y_pred FROM s UNION ALL SELECT 'fundo', fundo, y_true, y_pred FROM s
  UNION ALL SELECT 'anio', cast(year(fecha) AS varchar), y_true, y_pred FROM s
  UNION ALL SELECT 'mes', strftime(fecha, '%m-') || ['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'][month(fecha)], y_true, y_pred FROM s
  UNION ALL SELECT 'ha', CASE WHEN ha <= 1 THEN '<=1 ha' WHEN ha <= 3 THEN '1-3 ha' WHEN ha <= 6 THEN '3-6 ha' ELSE '>6 ha' END, y_true, y_pred FROM s
  UNION ALL SELECT 'kg_ha', CASE WHEN kg_ha <= e[2] THEN 'Q1 bajo' WHEN kg_ha <= e[3] THEN 'Q2' WHEN kg_ha <= e[4] THEN 'Q3' ELSE 'Q4 alto' END, y_true, y_pred FROM s, q)"""
SHA = S.replace("s AS (SELECT h.*,", "s AS (SELECT h.*, kg_ha / 6 AS ha,")


def _long(spark, sf):
    # Written once: the quartiles and every dimension read it.
    df = cut(scored(spark, sf).withColumn("ha", F.col("kg_ha") / 6).select("row_id", "formato", "fundo", "fecha", "ha", "kg_ha", "y_true", "y_pred"))
    return E.grouping_dimensions(df, quartiles=["kg_ha"])


@query("grouping_dimensions", f"{SHA}, {DIMS} SELECT dimension, level, count(*) AS n, {rs('sum(y_pred)', 2)} AS total FROM g GROUP BY ALL")
def grouping_dimensions(spark, sf):
    return _long(spark, sf).groupBy("dimension", "level").agg(F.count(F.lit(1)).alias("n"), r(F.sum("y_pred"), 2).alias("total"))


_SE = f"""count(*) AS n, {rs('avg(abs(y_true - y_pred))', 3)} AS mae, {rs('avg(abs(y_true - y_pred) / y_true) * 100', 3)} AS mape,
  {rs('quantile_cont(abs(y_true - y_pred), 0.5)', 3)} AS p50, {rs('quantile_cont(abs(y_true - y_pred), 0.9)', 3)} AS p90"""


@query("subgroup_errors", f"""{SHA}, {DIMS} SELECT dimension, level, {_SE}, {rs('avg(abs(y_true - y_pred) / y_true) / (SELECT avg(abs(y_true - y_pred) / y_true) FROM s)', 4)} AS ratio
  FROM g GROUP BY dimension, level HAVING count(*) >= 5 UNION ALL SELECT dimension, 'GLOBAL', {_SE}, 1.0 FROM g GROUP BY dimension""")
def subgroup_errors(spark, sf):
    out = E.subgroup_errors(_long(spark, sf))
    return out.select("dimension", "level", "n", *[r(c, 3).alias(c) for c in ("mae", "mape", "p50", "p90")], r("ratio", 4).alias("ratio"))


@query("group_bias", f"""{S}, b AS (SELECT fundo AS group_value, count(*) AS n, avg(y_pred * 1.04 + h_ef * 30 - y_true) AS bias, avg(y_true) AS m FROM s GROUP BY 1)
  SELECT group_value, n, {rs('bias', 4)} AS bias, {rs('bias / m * 100', 4)} AS bias_pct, CASE WHEN bias > 0 THEN 'sobreestima' ELSE 'subestima' END AS direction
  FROM b WHERE n >= 10 AND abs(bias / m * 100) >= 5""")
def group_bias(spark, sf):
    df = scored(spark, sf).withColumn("y_pred", F.col("y_pred") * 1.04 + F.col("h_ef") * 30)
    return E.group_bias(df).select("group_value", "n", r("bias", 4).alias("bias"), r("bias_pct", 4).alias("bias_pct"), "direction")


@query("error_percentiles", f"{S} SELECT formato, " + ", ".join(f"{rs(f'quantile_cont(abs(y_true - y_pred), {q})', 4)} AS p{int(q * 100)}" for q in (0.5, 0.8, 0.9, 0.99)) + " FROM s GROUP BY 1")
def error_percentiles(spark, sf):
    out = E.error_percentiles(scored(spark, sf), ["formato"])
    return out.select("formato", *[r(c, 4).alias(c) for c in ("p50", "p80", "p90", "p99")])


@query("top_errors", f"""{S} SELECT row_id, fecha, fundo, formato, {rs('abs(y_true - y_pred)', 4)} AS error_abs, CASE WHEN y_pred > y_true THEN 'sobreestima' ELSE 'subestima' END AS direction
  FROM s ORDER BY abs(y_true - y_pred) DESC, row_id LIMIT 20""")
def top_errors(spark, sf):
    return E.top_errors(scored(spark, sf)).select("row_id", "fecha", "fundo", "formato", r("error_abs", 4).alias("error_abs"), "direction")


@query("error_histogram", f"""{S}, e AS (SELECT formato, abs(y_true - y_pred) AS e FROM s), lim AS (SELECT formato, min(e) AS lo, max(e) AS hi FROM e GROUP BY 1)
  SELECT formato, cast(least(floor((e - lo) / ((hi - lo) / 60)), 59) AS integer) AS bin, count(*) AS n FROM e JOIN lim USING (formato) GROUP BY ALL""")
def error_histogram(spark, sf):
    return E.error_histogram(scored(spark, sf), 60, ["formato"]).select("formato", "bin", "n")


@query("calibration_bins", f"""{S}, e AS (SELECT list_distinct(quantile_cont(y_pred, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) AS e FROM s),
  b AS (SELECT s.*, cast(greatest(len(list_filter(e, lambda x: x < y_pred)) - 1, 0) AS integer) AS bin_idx FROM s, e)
  SELECT bin_idx, {rs('avg(y_pred)', 4)} AS bin_pred_mean, {rs('avg(y_true)', 4)} AS bin_real_mean, count(*) AS bin_count, {rs('(avg(y_true) - avg(y_pred)) * 100 / avg(y_pred)', 4)} AS bin_diff_pct FROM b GROUP BY 1""")
def calibration_bins(spark, sf):
    out = E.calibration_bins(scored(spark, sf))
    return out.select("bin_idx", r("bin_pred_mean", 4).alias("bin_pred_mean"), r("bin_real_mean", 4).alias("bin_real_mean"), "bin_count", r("bin_diff_pct", 4).alias("bin_diff_pct"))


_EDGES, _t = [], 0.0
for _k in range(12):
    _t += math.exp(-1) / math.factorial(_k)
    _EDGES.append(_t)
W_SQL = " + ".join(f"cast(x > {e!r} AS integer)" for e in _EDGES)


_HASHED = "('0x' || substr(md5('{}|' || row_id), 1, 8))::bigint"


@query("bootstrap_ci", f"""{S}, un AS (SELECT {_HASHED.format(42)} AS hx, {_HASHED.format(43)} AS hy, 1 AS n, abs(y_true - y_pred) AS ae,
  coalesce(CASE WHEN abs(y_true) >= 1 THEN abs(y_true - y_pred) / abs(y_true) END, 0) AS ape, cast(abs(y_true) >= 1 AS integer) AS na, (y_true - y_pred) ^ 2 AS se, y_true AS sy, y_true ^ 2 AS syy FROM s),
  d0 AS (SELECT *, (hx * 1640531527 + hy + b * 1597334677) % 4294967296 AS h0 FROM un, (SELECT unnest(range(1::bigint, 1001::bigint)) AS b)),
  d1 AS (SELECT *, (xor(h0, h0 >> 15) * 2146121005) % 4294967296 AS h1 FROM d0),
  dr AS (SELECT *, (xor(h1, h1 >> 13) + 0.5) / 4294967296.0::double AS x FROM d1), wt AS (SELECT *, {W_SQL} AS w FROM dr),
  e AS (SELECT b, sum(ae * w) / sum(n * w) AS mae, sum(ape * w) / sum(na * w) * 100 AS mape, 1 - sum(se * w) / (sum(syy * w) - sum(sy * w) ^ 2 / sum(n * w)) AS r2 FROM wt GROUP BY 1),
  pt AS (SELECT sum(ae) / sum(n) AS mae, sum(ape) / sum(na) * 100 AS mape, 1 - sum(se) / (sum(syy) - sum(sy) ^ 2 / sum(n)) AS r2 FROM un)
  """ + " UNION ALL ".join(f"SELECT '{m}' AS metric, {rs(f'(SELECT {m} FROM pt)', 4)} AS point, {rs(f'quantile_cont({m}, 0.025)', 4)} AS ci_low, {rs(f'quantile_cont({m}, 0.975)', 4)} AS ci_high FROM e" for m in ("mae", "mape", "r2")))
def bootstrap_ci(spark, sf):
    out = E.bootstrap_ci(scored(spark, sf))
    return out.select("metric", *[r(c, 4).alias(c) for c in ("point", "ci_low", "ci_high")])


def _q(alpha, src, keys, name):
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""{name} AS (SELECT {k}max(n) AS n, max(ae) FILTER (i = floor(h) + 1) + (max(ae) FILTER (i = ceil(h) + 1) - max(ae) FILTER (i = floor(h) + 1)) * max(h - floor(h)) AS q FROM
      (SELECT *, (n - 1) * least(1.0::double, (1 - {alpha}) * (n::double + 1) / n::double) AS h FROM (SELECT *, row_number() OVER ({part} ORDER BY ae, row_id) AS i, count(*) OVER ({part}) AS n FROM {src})) {grp})"""


@query("conformal_interval", f"""{S}, a AS (SELECT *, abs(y_true - y_pred) AS ae FROM s), {_q(0.05, 'a', 'fundo', 'z')}
  SELECT fundo, n, {rs('CASE WHEN n < 20 THEN 0 ELSE q END', 4)} AS half_width FROM z""")
def conformal_interval(spark, sf):
    out = E.conformal_interval(scored(spark, sf), by=["fundo"])
    return out.select("fundo", "n", r("half_width", 4).alias("half_width"))


BANDS = f"""{S}, a AS (SELECT *, abs(y_true - y_pred) AS ae, row_number() OVER (ORDER BY fecha, row_id) AS i0, count(*) OVER () AS n0 FROM s),
  rc AS (SELECT * FROM a WHERE i0 > n0 - greatest(100, cast(round_even(n0 * 0.25, 0) AS bigint))), ea AS (SELECT * FROM a WHERE i0 <= cast(round_even(n0 * 0.7, 0) AS bigint)),
  {_q(0.1, 'a', '', 'ga')}, {_q(0.1, 'rc', '', 'gr')}, {_q(0.1, 'ea', '', 'ge')}, {_q(0.1, 'a', 'fundo', 'fa')}, {_q(0.1, 'rc', 'fundo', 'fr')}"""


@query("conformal_bands", f"""{BANDS} SELECT ga.n AS n_calibration, gr.n AS n_recent, {rs('ga.q', 4)} AS q_all, {rs('gr.q', 4)} AS q_recent, {rs('greatest(ga.q, gr.q)', 4)} AS q_global,
  {rs('(SELECT avg(cast(ae <= ge.q AS double)) FROM a WHERE i0 > cast(round_even(n0 * 0.7, 0) AS bigint))')} AS backtest_coverage FROM ga, gr, ge""")
def conformal_bands(spark, sf):
    out = E.conformal_bands(scored(spark, sf))["overall"]
    return out.select("n_calibration", "n_recent", *[r(c, 4).alias(c) for c in ("q_all", "q_recent", "q_global")], r("backtest_coverage").alias("backtest_coverage"))


@query("conformal_bands_by_farm", f"""{BANDS} SELECT fa.fundo, fa.n, {rs('CASE WHEN fr.n >= 50 THEN greatest(fa.q, fr.q) ELSE fa.q END', 4)} AS q_farm FROM fa LEFT JOIN fr USING (fundo) WHERE fa.n >= 100""")
def conformal_bands_by_farm(spark, sf):
    return E.conformal_bands(scored(spark, sf))["farms"].select("fundo", "n", r("q_farm", 4).alias("q_farm"))


@query("known_group_flag", f"""{H}, k AS (SELECT fundo, formato FROM h GROUP BY ALL HAVING count(*) >= 200) SELECT row_id, k.fundo IS NOT NULL AS known FROM h LEFT JOIN k USING (fundo, formato)""")
def known_group_flag(spark, sf):
    h = harvest(spark, sf)
    return E.known_group_flag(h, E.rows_known(h, ["fundo", "formato"], 200)).select("row_id", "known")


@query("apply_bands", f"""{BANDS}, hw AS (SELECT s.row_id, y_pred, coalesce(CASE WHEN fa.n >= 100 THEN CASE WHEN fr.n >= 50 THEN greatest(fa.q, fr.q) ELSE fa.q END END, greatest(ga.q, gr.q)) * CASE WHEN formato = 'R' THEN 2 ELSE 1 END AS w
  FROM s LEFT JOIN fa USING (fundo) LEFT JOIN fr USING (fundo), ga, gr)
  SELECT row_id, {rs('w', 3)} AS half_width, {rs('round_even(greatest(0, y_pred - w), 4)', 4)} AS low, {rs('round_even(y_pred + w, 4)', 4)} AS high, CASE WHEN w / y_pred > 0.5 THEN 'baja' WHEN w / y_pred > 0.25 THEN 'media' ELSE 'alta' END AS confidence FROM hw""")
def apply_bands(spark, sf):
    df = scored(spark, sf)
    bands = E.conformal_bands(df)
    bands["known"] = bands["known"].where("formato <> 'R'")
    return E.apply_bands(df, bands).select("row_id", r("half_width", 3).alias("half_width"), r("low", 4).alias("low"), r("high", 4).alias("high"), "confidence")


@query("ensemble_band", f"{H} SELECT fundo, {rs('1.96 * stddev_samp(kg_jr_h)', 4)} AS half_width FROM h GROUP BY 1")
def ensemble_band(spark, sf):
    return harvest(spark, sf).groupBy("fundo").agg(r(E.ensemble_band(F.stddev_samp("kg_jr_h")), 4).alias("half_width"))


@query("kpi_table", f"""{S}, c AS (SELECT s.*, avg(y_true) OVER (PARTITION BY formato) AS mu FROM s), k AS (SELECT formato, avg(abs(y_true - y_pred) / y_true) FILTER (y_true >= 1) * 100 AS mape,
  (1 - sum((y_true - y_pred) ^ 2) / (var_pop(y_true) * count(*))) * 100 AS ex, avg(abs(y_true - y_pred)) AS mae, avg(abs(y_true - mu)) AS mm, quantile_cont(abs(y_true - y_pred), 0.8) AS p80 FROM c GROUP BY 1)
  SELECT formato, {rs('mape', 4)} AS mape, {rs('ex', 4)} AS explained_pct, {rs('p80', 4)} AS p80, {rs('(mm - mae) / mm * 100', 4)} AS gain_pct,
  CASE WHEN mape <= 15 THEN 'ALTO' WHEN mape <= 25 THEN 'MEDIO' ELSE 'BAJO' END AS precision_grade, CASE WHEN ex >= 80 THEN 'ALTO' WHEN ex >= 60 THEN 'MEDIO' ELSE 'BAJO' END AS explained_grade,
  CASE WHEN (mm - mae) / mm * 100 >= 50 THEN 'ALTO' WHEN (mm - mae) / mm * 100 >= 25 THEN 'MEDIO' ELSE 'BAJO' END AS gain_grade FROM k""")
def kpi_table(spark, sf):
    out = E.kpi_table(scored(spark, sf), ["formato"])
    return out.select("formato", *[r(c, 4).alias(c) for c in ("mape", "explained_pct", "p80", "gain_pct")], "precision_grade", "explained_grade", "gain_grade")


@query("verdict", """WITH m AS (SELECT s_suppkey, s_acctbal % 40 + s_suppkey % 7 AS mape, (s_suppkey % 40) / 100.0 AS gap FROM supplier)
  SELECT s_suppkey, CASE WHEN mape <= 15 AND gap <= 0.1 THEN 'alta_confianza' WHEN mape <= 22 AND gap <= 0.18 THEN 'confianza_aceptable' WHEN mape <= 35 AND gap <= 0.3 THEN 'confianza_limitada' ELSE 'no_recomendado' END AS verdict FROM m""")
def verdict(spark, sf):
    s = table(spark, sf, "supplier")
    mape = F.col("s_acctbal") % 40 + F.col("s_suppkey") % 7
    return s.select("s_suppkey", E.verdict(mape, (F.col("s_suppkey") % 40) / 100.0).alias("verdict"))


@query("recommended_actions", f"""{S}, g AS (SELECT avg(abs(y_true - y_pred) / y_true) FILTER (y_true >= 1) * 100 AS m FROM s), f AS (SELECT fundo, count(*) AS n, avg(abs(y_true - y_pred) / y_true) FILTER (y_true >= 1) * 100 AS m FROM s GROUP BY 1)
  SELECT 'critical' AS severity, 'error_global' AS subject, {rs('m', 4)} AS value FROM g WHERE m > 25 UNION ALL SELECT 'warning', 'gap', 0.3
  UNION ALL SELECT 'warning', 'fundo=' || fundo, {rs('f.m / g.m', 4)} FROM f, g WHERE n >= 10 AND f.m >= 1.1 * g.m""")
def recommended_actions(spark, sf):
    out = E.recommended_actions(scored(spark, sf), 0.3, ["fundo"], ratio=1.1)
    return out.select("severity", "subject", r("value", 4).alias("value"))


@query("training_context", f"""{H} SELECT formato AS g, count(*) AS n_rows, strftime(min(fecha), '%Y-%m') AS month_min, strftime(max(fecha), '%Y-%m') AS month_max, count(DISTINCT fundo) AS n_farms, count(DISTINCT estado) AS n_formats,
  list_slice(list_sort(list(DISTINCT fundo)), 1, 5) AS farms_top, list_slice(list_sort(list(DISTINCT estado)), 1, 5) AS formats_top FROM h GROUP BY 1""")
def training_context(spark, sf):
    return E.training_context(harvest(spark, sf).withColumn("g", F.col("formato")), ["g"], fmt="estado")


@query("traffic_light", """WITH m AS (SELECT s_suppkey, (s_suppkey % 100) / 100.0 AS r2, (s_suppkey % 60) / 100.0 AS mae FROM supplier)
  SELECT s_suppkey, CASE WHEN r2 >= 0.9 THEN 'VERDE' WHEN r2 >= 0.7 THEN 'AMARILLO' ELSE 'ROJO' END AS r2_light, CASE WHEN mae <= 0.2 THEN 'VERDE' WHEN mae <= 0.4 THEN 'AMARILLO' ELSE 'ROJO' END AS mae_light FROM m""")
def traffic_light(spark, sf):
    lights = E.traffic_light((F.col("s_suppkey") % 100) / 100.0, (F.col("s_suppkey") % 60) / 100.0)
    return table(spark, sf, "supplier").select("s_suppkey", *[c.alias(k) for k, c in lights.items()])


@query("hierarchical_median_baseline", f"""{H}, t AS (SELECT * FROM h WHERE fecha < DATE '2000-01-01' AND NOT (formato = 'R' AND h_ef > 4)),
  a AS (SELECT fundo, formato, median(kg_jr_h) AS m FROM t GROUP BY ALL HAVING count(*) >= 150), b AS (SELECT fundo, median(kg_jr_h) AS m FROM t GROUP BY ALL HAVING count(*) >= 150), c AS (SELECT formato, median(kg_jr_h) AS m FROM t GROUP BY ALL HAVING count(*) >= 150)
  SELECT row_id, {rs('coalesce(a.m, b.m, c.m, (SELECT median(kg_jr_h) FROM t))', 4)} AS baseline_pred FROM h LEFT JOIN a USING (fundo, formato) LEFT JOIN b USING (fundo) LEFT JOIN c USING (formato)""")
def hierarchical_median_baseline(spark, sf):
    h = harvest(spark, sf)
    train = h.where((F.col("fecha") < F.lit("2000-01-01").cast("date")) & ~((F.col("formato") == "R") & (F.col("h_ef") > 4)))
    out = E.predict_baseline(h, E.fit_baseline(train, least=150))
    return out.select("row_id", r("baseline_pred", 4).alias("baseline_pred"))


@query("cascade_lookup", f"""{H}, a AS (SELECT fundo, formato, avg(kg_ha) AS m FROM h GROUP BY ALL HAVING count(*) >= 200), b AS (SELECT fundo, avg(kg_ha) AS m FROM h GROUP BY ALL HAVING count(*) >= 600)
  SELECT row_id, {rs('coalesce(a.m, b.m, (SELECT avg(kg_ha) FROM h))')} AS level_mean FROM h LEFT JOIN a USING (fundo, formato) LEFT JOIN b USING (fundo)""")
def cascade_lookup(spark, sf):
    h = harvest(spark, sf)

    def mean(keys, least, name):
        g = h.groupBy(*keys).agg(F.avg("kg_ha").alias(name), F.count(F.lit(1)).alias("n"))
        return g.where(F.col("n") >= least).drop("n")

    states = [(["fundo", "formato"], mean(["fundo", "formato"], 200, "_a")), (["fundo"], mean(["fundo"], 600, "_b")), ([], mean([], 0, "_c"))]
    return E.cascade_lookup(h, states, "level_mean").select("row_id", r("level_mean").alias("level_mean"))
