"""History features and their joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.catalog.base import H, harvest, query, r, rs
from furrow.columns import FF
from furrow.operators import lags as L
from furrow.plans.chain import LagStep
from furrow.session import cut

SPLIT_DAY = "2000-01-01"


def _over(keys: str, k: int) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"OVER ({part} ORDER BY fecha, row_id ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def _med(value: str, keys: str, k: int) -> str:
    o = _over(keys, k)
    return f"CASE WHEN count({value}) {o} >= 3 THEN quantile_cont({value}, 0.5) {o} END"


def _slim(spark, sf):
    return harvest(spark, sf).select("row_id", "fundo", "formato", "fecha", "kg_ha", "kg_jr_h", "p_baya")


@query("rolling_median_30", f"""{H} SELECT row_id, {rs(_med('kg_ha', 'fundo, formato', 30))} AS lag_30,
  coalesce({rs(_med('kg_jr_h', 'fundo, formato', 30))}, -1) AS target_lag_30 FROM h""")
def rolling_median_30(spark, sf):
    out = L.rolling_medians(
        _slim(spark, sf), FF, L.row_order(), {"lag_30": ("kg_ha", 30), "target_lag_30": ("kg_jr_h", 30)}
    )
    return L.fill_cold_start(out.select("row_id", r("lag_30").alias("lag_30"), r("target_lag_30").alias("target_lag_30")), ["target_lag_30"])


@query("rolling_medians_all_levels", f"{H} SELECT row_id, " + ", ".join(
    f"{rs(_med(v, keys, k))} AS {v}_lag_{alias}_{k}"
    for alias, keys in (("FF", "fundo, formato"), ("F", "fundo"), ("FMT", "formato"))
    for v in ("kg_jr_h", "kg_ha") for k in (7, 14, 30, 90)) + " FROM h")
def rolling_medians_all_levels(spark, sf):
    df = base = _slim(spark, sf)
    names = []
    for alias, keys in L.LEVELS.items():
        cols = {f"{v}_lag_{alias}_{k}": (v, k) for v in ("kg_jr_h", "kg_ha") for k in L.WINDOWS}
        names += cols
        df = L.rolling_medians(df, keys, L.row_order(), cols, first="fecha", base=base)
    return df.select("row_id", *[r(n).alias(n) for n in names])


DAILY = "d AS (SELECT fundo, formato, fecha, median(kg_ha) AS kg_ha FROM h GROUP BY ALL)"


@query("daily_median", f"{H} SELECT fundo, formato, fecha, {rs('median(kg_ha)')} AS kg_ha, {rs('median(p_baya)')} AS p_baya FROM h GROUP BY ALL")
def daily_median(spark, sf):
    out = L.daily_median(_slim(spark, sf), FF, ["kg_ha", "p_baya"])
    return out.select("fundo", "formato", "fecha", r("kg_ha").alias("kg_ha"), r("p_baya").alias("p_baya"))


@query("rolling_median_exante", f"""{H}, {DAILY}, e AS (SELECT fundo, formato, fecha,
  CASE WHEN count(kg_ha) OVER w >= 3 THEN quantile_cont(kg_ha, 0.5) OVER w END AS lag_14 FROM d
  WINDOW w AS (PARTITION BY fundo, formato ORDER BY fecha ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
  SELECT row_id, {rs('lag_14')} AS lag_14 FROM h LEFT JOIN e USING (fundo, formato, fecha)""")
def rolling_median_exante(spark, sf):
    out = L.rolling_medians_exante(_slim(spark, sf), FF, {"lag_14": ("kg_ha", 14)})
    return out.select("row_id", r("lag_14").alias("lag_14"))


def _season(value, period):
    o = f"""OVER (PARTITION BY fundo, formato ORDER BY fecha RANGE BETWEEN INTERVAL {period + 15} DAYS PRECEDING
            AND INTERVAL {period - 15} DAYS PRECEDING)"""
    return f"CASE WHEN count(*) {o} >= 3 AND count(*) {o} = count({value}) {o} THEN quantile_cont({value}, 0.5) {o} END"


@query("seasonal_median", f"""{H} SELECT row_id, {rs(_season('kg_ha', 365))} AS season,
  {rs(_season('kg_jr_h', 365))} AS target_season, {rs(_season('indus_pct', 365))} AS indus_season FROM h""")
def seasonal_median(spark, sf):
    df = harvest(spark, sf).select("row_id", "fundo", "formato", "fecha", "kg_ha", "kg_jr_h", "indus_pct")
    spec = {"season": ("kg_ha", 365), "target_season": ("kg_jr_h", 365), "indus_season": ("indus_pct", 365)}
    out = L.seasonal_median(df, FF, spec)
    return out.select("row_id", *[r(n).alias(n) for n in spec])


@query("seasonal_median_2y", f"{H} SELECT row_id, {rs(_season('kg_jr_h', 730))} AS season_2y FROM h")
def seasonal_median_2y(spark, sf):
    out = L.seasonal_median(_slim(spark, sf), FF, {"season_2y": ("kg_jr_h", 730)})
    return out.select("row_id", r("season_2y").alias("season_2y"))


def _std(value, keys="fundo, formato"):
    return f"CASE WHEN count({value}) {_over(keys, 30)} >= 3 THEN stddev_samp({value}) {_over(keys, 30)} END"


@query("rolling_std", f"{H} SELECT row_id, {rs(_std('kg_ha'))} AS std_30 FROM h")
def rolling_std(spark, sf):
    out = L.rolling_std(_slim(spark, sf), FF, "kg_ha", 30, "std_30")
    return out.select("row_id", r("std_30").alias("std_30"))


@query("target_volatility", f"{H} SELECT row_id, {rs(_std('kg_jr_h'), 3)} AS target_std_30 FROM h")
def target_volatility(spark, sf):
    out = L.rolling_std(_slim(spark, sf), FF, "kg_jr_h", 30, "target_std_30")
    return out.select("row_id", r("target_std_30", 3).alias("target_std_30"))


@query("rolling_std_exante", f"""{H}, {DAILY}, e AS (SELECT fundo, formato, fecha,
  CASE WHEN count(kg_ha) OVER w >= 3 THEN stddev_samp(kg_ha) OVER w END AS std_30 FROM d
  WINDOW w AS (PARTITION BY fundo, formato ORDER BY fecha ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
  SELECT row_id, {rs('std_30')} AS std_30 FROM h LEFT JOIN e USING (fundo, formato, fecha)""")
def rolling_std_exante(spark, sf):
    df = _slim(spark, sf)
    out = L._exante_momentum(df, FF)
    return out.select("row_id", r("kg_ha_std_FF_30").alias("std_30"))


@query("rolling_slope", f"""{H}, n AS (SELECT *, row_number() OVER (PARTITION BY fundo, formato ORDER BY fecha, row_id) AS rn FROM h)
  SELECT row_id, {rs(f"CASE WHEN count(kg_ha) {_over('fundo, formato', 30)} >= 3 THEN regr_slope(kg_ha, rn) {_over('fundo, formato', 30)} END", 5)} AS slope_30,
  {rs(f"CASE WHEN count(p_baya) {_over('fundo, formato', 30)} >= 3 THEN regr_slope(p_baya, rn) {_over('fundo, formato', 30)} END", 5)} AS slope_gaps FROM n""")
def rolling_slope(spark, sf):
    df = _slim(spark, sf)
    df = L.rolling_slope(df, FF, "kg_ha", 30, "slope_30")
    df = L.rolling_slope(df, FF, "p_baya", 30, "slope_gaps")
    return df.select("row_id", r("slope_30", 5).alias("slope_30"), r("slope_gaps", 5).alias("slope_gaps"))


@query("days_since_last", f"""{H} SELECT row_id, cast(fecha - lag(fecha) OVER (PARTITION BY fundo, formato
  ORDER BY fecha, row_id) AS double) AS gap FROM h""")
def days_since_last(spark, sf):
    return L.days_since_last(_slim(spark, sf), FF, "gap").select("row_id", "gap")


@query("tenure_days", f"{H} SELECT row_id, cast(fecha - min(fecha) OVER (PARTITION BY fundo) AS double) AS tenure FROM h")
def tenure_days(spark, sf):
    return L.tenure_days(_slim(spark, sf), ["fundo"], "tenure").select("row_id", "tenure")


@query("serving_tenure", f"""{H}, f AS (SELECT formato, min(fecha) AS first_seen FROM h WHERE fecha < DATE '{SPLIT_DAY}' AND formato <> 'R' GROUP BY 1)
  SELECT row_id, coalesce(cast(fecha - first_seen AS double), 0) AS tenure FROM h LEFT JOIN f USING (formato) WHERE fecha >= DATE '{SPLIT_DAY}'""")
def serving_tenure(spark, sf):
    df = _slim(spark, sf)
    day = F.lit(SPLIT_DAY).cast("date")
    first = df.where((F.col("fecha") < day) & (F.col("formato") != "R")).groupBy("formato").agg(F.min("fecha").alias("first_seen"))
    return L.serving_tenure(df.where(F.col("fecha") >= day), first, "formato", "tenure").select("row_id", "tenure")


@query("simple_lags", f"""{H}, l AS (SELECT row_id, lag(kg_jr_h, 1) OVER w AS l1, lag(kg_jr_h, 2) OVER w AS l2 FROM h
  WINDOW w AS (PARTITION BY fundo, formato ORDER BY fecha, row_id))
  SELECT row_id, {rs('l1')} AS lag_1, {rs('l2')} AS lag_2, {rs('l1 - l2')} AS diff_1 FROM l""")
def simple_lags(spark, sf):
    out = L.simple_lags(_slim(spark, sf), FF, "kg_jr_h", "t")
    return out.select("row_id", r("t_lag_1").alias("lag_1"), r("t_lag_2").alias("lag_2"), r("t_diff_1").alias("diff_1"))


@query("feature_lags", f"{H} SELECT row_id, " + ", ".join(
    f"{rs(_med('p_baya', 'fundo, formato', k))} AS p_baya_lag_{k}" for k in (7, 30)) + " FROM h")
def feature_lags(spark, sf):
    out = L.rolling_medians(_slim(spark, sf), FF, L.row_order(), {f"p_baya_lag_{k}": ("p_baya", k) for k in (7, 30)})
    return out.select("row_id", *[r(f"p_baya_lag_{k}").alias(f"p_baya_lag_{k}") for k in (7, 30)])


@query("lag_ratios", f"""{H}, l AS (SELECT row_id, kg_ha, {_med('kg_ha', 'fundo, formato', 30)} AS f30, {_med('kg_ha', 'fundo, formato', 90)} AS f90,
  {_med('kg_ha', 'fundo', 30)} AS a30, {_med('kg_ha', 'formato', 30)} AS m30 FROM h)
  SELECT row_id, {rs('CASE WHEN f30 > 0 THEN kg_ha / f30 END')} AS ratio_30, {rs('CASE WHEN f90 > 0 THEN kg_ha / f90 END')} AS ratio_90,
  {rs('CASE WHEN f90 > 0 THEN f30 / f90 END')} AS lag_ratio, {rs('CASE WHEN m30 > 0 THEN a30 / m30 END')} AS farm_vs_format FROM l""")
def lag_ratios(spark, sf):
    df = _slim(spark, sf)
    df = L.rolling_medians(df, FF, L.row_order(), {"f30": ("kg_ha", 30), "f90": ("kg_ha", 90)})
    df = L.rolling_medians(df, ["fundo"], L.row_order(), {"a30": ("kg_ha", 30)})
    df = L.rolling_medians(df, ["formato"], L.row_order(), {"m30": ("kg_ha", 30)})
    c = F.col
    return df.select(
        "row_id",
        r(L.safe_ratio(c("kg_ha"), c("f30"))).alias("ratio_30"),
        r(L.safe_ratio(c("kg_ha"), c("f90"))).alias("ratio_90"),
        r(L.safe_ratio(c("f30"), c("f90"))).alias("lag_ratio"),
        r(L.safe_ratio(c("a30"), c("m30"))).alias("farm_vs_format"),
    )


@query("relative_to_global", f"""{H}, l AS (SELECT row_id, kg_ha, {_med('kg_ha', '', 30)} AS g FROM h)
  SELECT row_id, {rs('CASE WHEN g > 0 THEN kg_ha / g END')} AS rel_global FROM l""")
def relative_to_global(spark, sf):
    out = L.relative_to_global(_slim(spark, sf), "kg_ha", 30, name="rel_global")
    return out.select("row_id", r("rel_global").alias("rel_global"))


@query("cold_start_counts", f"""{H}, l AS (SELECT {_med('kg_ha', 'fundo, formato', 30)} AS a, {_med('p_baya', 'fundo, formato', 7)} AS b,
  {_season('kg_ha', 365)} AS s FROM h) SELECT count(*) AS n_rows, count(*) FILTER (a IS NULL AND b IS NULL) AS cold_lags,
  count(*) FILTER (s IS NULL) AS cold_seasonal FROM l""")
def cold_start_counts(spark, sf):
    df = L.rolling_medians(_slim(spark, sf), FF, L.row_order(), {"a": ("kg_ha", 30), "b": ("p_baya", 7)})
    df = L.seasonal_median(df, FF, {"s": ("kg_ha", 365)})
    return L.cold_counts(df, ["a", "b"], ["s"])


@query("log_derived", f"""{H}, l AS (SELECT row_id, {_std('kg_ha')} AS s, cast(fecha - lag(fecha) OVER (PARTITION BY fundo, formato ORDER BY fecha, row_id) AS double) AS gap FROM h)
  SELECT row_id, {rs('ln(1 + s)')} AS std_log, {rs('ln(1 + gap)')} AS gap_log FROM l""")
def log_derived(spark, sf):
    df = L.rolling_std(_slim(spark, sf), FF, "kg_ha", 30, "kg_ha_std_FF_30")
    df = L.log_derived(L.days_since_last(df, FF, "days_since_last_FF"))
    return df.select("row_id", r("kg_ha_std_FF_30").alias("std_log"), r("days_since_last_FF").alias("gap_log"))


_LEVEL_SQL = {"FF": "fundo, formato", "F": "fundo", "FMT": "formato"}
_BLOCK = {f"{v}_lag_{a}_{k}": _med(v, keys, k) for a, keys in _LEVEL_SQL.items() for v in ("kg_jr_h", "kg_ha") for k in L.WINDOWS}
_BLOCK.update({
    "kg_jr_h_lag_FF_seasonal": _season("kg_jr_h", 365),
    "kg_ha_lag_FF_seasonal": _season("kg_ha", 365),
    "kg_ha_std_FF_30": _std("kg_ha"),
    "kg_ha_slope_FF_30": f"CASE WHEN count(kg_ha) {_over('fundo, formato', 30)} >= 3 THEN regr_slope(kg_ha, rn) {_over('fundo, formato', 30)} END",
    "days_since_last_FF": "cast(fecha - lag(fecha) OVER (PARTITION BY fundo, formato ORDER BY fecha, row_id) AS double)",
    "tenure_fundo_days": "cast(fecha - min(fecha) OVER (PARTITION BY fundo) AS double)",
    "_g": _med("kg_ha", "", 30),
})


def _div(num, den):
    return f"CASE WHEN {den} > 0 THEN {num} / {den} END"


_BLOCK_OUT = {n: n for n in _BLOCK if n != "_g"}
_BLOCK_OUT.update({
    "kg_ha_ratio_FF_30": _div("kg_ha", "kg_ha_lag_FF_30"),
    "kg_ha_ratio_FF_90": _div("kg_ha", "kg_ha_lag_FF_90"),
    "kg_ha_rel_global_30": _div("kg_ha", "_g"),
    "delta_kg_jr_h_30_90": _div("kg_jr_h_lag_FF_30", "kg_jr_h_lag_FF_90"),
    "kg_ha_rel_formato_30": _div("kg_ha_lag_F_30", "kg_ha_lag_FMT_30"),
})
LAG_SQL = f"""{H}, n AS (SELECT *, row_number() OVER (PARTITION BY fundo, formato ORDER BY fecha, row_id) AS rn FROM h),
  l AS (SELECT row_id, kg_ha, {', '.join(f'{e} AS {n}' for n, e in _BLOCK.items())} FROM n)
  SELECT row_id, {', '.join(rs(f"coalesce({e}, {-99999.0 if 'slope' in n else -1.0})", 4) + f' AS {n}' for n, e in _BLOCK_OUT.items())} FROM l"""


@query("lag_features", LAG_SQL)
def lag_features(spark, sf):
    """The whole block: 35 columns, cold starts filled."""
    out = L.lag_features(_slim(spark, sf))
    return out.select("row_id", *[r(c, 4).alias(c) for c in L.lag_columns()])


@query("chain_training_features", LAG_SQL)
def chain_training_features(spark, sf):
    """The fitted lag stage served its own training rows, as a pipeline's transform does."""
    df = cut(_slim(spark, sf))
    out = LagStep().fit(df).transform(df.select("*"))
    return out.select("row_id", *[r(c, 4).alias(c) for c in L.lag_columns()])


@query("lag_features_exante")
def lag_features_exante(spark, sf):
    flags = L.LagFlags(exante=True, simple_lags=True, seasonal_2y=True, log_derived=True)
    return L.lag_features(_slim(spark, sf), flags).select("row_id", *L.lag_columns(flags))


@query("lag_transform", f"""{H}, u AS (SELECT (CASE WHEN fecha >= DATE '{SPLIT_DAY}' THEN '1|' ELSE '0|' END) || row_id AS row_id,
  fecha >= DATE '{SPLIT_DAY}' AS is_new, fundo, formato, fecha, kg_ha, CASE WHEN fecha < DATE '{SPLIT_DAY}' THEN kg_jr_h END AS kg_jr_h FROM h),
  l AS (SELECT row_id, is_new, {_med('kg_jr_h', 'fundo, formato', 30)} AS t30, {_med('kg_ha', 'fundo', 7)} AS a7 FROM u)
  SELECT substr(row_id, 3) AS row_id, {rs('coalesce(t30, -1)')} AS t30, {rs('coalesce(a7, -1)')} AS a7 FROM l WHERE is_new""")
def lag_transform(spark, sf):
    """Serving form: rows after the split day against the history before it."""
    df = _slim(spark, sf)
    day = F.lit(SPLIT_DAY).cast("date")
    state = L.fit_lags(df.where(F.col("fecha") < day))
    out = L.transform_lags(state, df.where(F.col("fecha") >= day))
    return out.select("row_id", r("kg_jr_h_lag_FF_30").alias("t30"), r("kg_ha_lag_F_7").alias("a7"))


@query("rolling_time_mean", f"""{H}, d AS (SELECT formato, fecha, sum(abs(kg_ha - 25)) AS s, count(*) AS c FROM h GROUP BY ALL),
  m AS (SELECT formato, fecha, CASE WHEN sum(c) OVER w >= 5 THEN sum(s) OVER w / sum(c) OVER w END AS mean_30 FROM d
  WINDOW w AS (PARTITION BY formato ORDER BY fecha RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW))
  SELECT row_id, {rs('mean_30')} AS mean_30 FROM h JOIN m USING (formato, fecha)""")
def rolling_time_mean(spark, sf):
    df = _slim(spark, sf).withColumn("err", F.abs(F.col("kg_ha") - 25))
    return L.rolling_time_mean(df, ["formato"], "err", name="mean_30").select("row_id", r("mean_30").alias("mean_30"))


@query("centered_moving_average", f"""{H} SELECT row_id, {rs('avg(kg_ha) OVER (PARTITION BY fundo ORDER BY fecha, row_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)')} AS smooth FROM h""")
def centered_moving_average(spark, sf):
    out = L.centered_moving_average(_slim(spark, sf), ["fundo"], L.row_order(), "kg_ha", 7, "smooth")
    return out.select("row_id", r("smooth").alias("smooth"))


@query("join_daily_lag", f"""{H}, {DAILY} SELECT row_id, {rs('d.kg_ha')} AS day_median FROM h LEFT JOIN d USING (fundo, formato, fecha)""")
def join_daily_lag(spark, sf):
    df = _slim(spark, sf)
    daily = L.daily_median(df, FF, ["kg_ha"]).withColumnRenamed("kg_ha", "day_median")
    return L.join_daily(df, daily, FF).select("row_id", r("day_median").alias("day_median"))


@query("seasonal_range_join", f"""{H}, n AS (SELECT DISTINCT fundo, formato, fecha FROM h WHERE fecha >= DATE '{SPLIT_DAY}')
  SELECT n.fundo, n.formato, n.fecha, {rs('CASE WHEN count(*) >= 3 THEN quantile_cont(h.kg_ha, 0.5) END')} AS season FROM n JOIN h
  ON n.fundo = h.fundo AND n.formato = h.formato AND h.fecha BETWEEN n.fecha - 380 AND n.fecha - 350 AND h.fecha < DATE '{SPLIT_DAY}' GROUP BY ALL""")
def seasonal_range_join(spark, sf):
    df = _slim(spark, sf)
    day = F.lit(SPLIT_DAY).cast("date")
    out = L.seasonal_range_join(df.where(F.col("fecha") >= day), df.where(F.col("fecha") < day), FF, name="season")
    return out.select("fundo", "formato", "fecha", r("season").alias("season"))


@query("asof_prior_day", f"""{H}, {DAILY}, n AS (SELECT * FROM h WHERE formato = 'N'), p AS (SELECT * FROM d WHERE formato = 'A')
  SELECT n.row_id, {rs('p.kg_ha')} AS prior_kg_ha FROM n ASOF LEFT JOIN p ON n.fundo = p.fundo AND n.fecha > p.fecha""")
def asof_prior_day(spark, sf):
    df = _slim(spark, sf)
    state = L.daily_median(df.where("formato = 'A'"), FF, ["kg_ha"])
    out = L.asof_prior_day(df.where("formato = 'N'"), state, ["fundo"], ["kg_ha"])
    return out.select("row_id", r("prior_kg_ha").alias("prior_kg_ha"))
