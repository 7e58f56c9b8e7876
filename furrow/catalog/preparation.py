"""Fitted cleaning steps and engineered features."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from furrow.catalog.base import H, HF, harvest, harvest_full, query, r, rs, table
from furrow.functions import scalar as SC
from furrow.operators import features as FE
from furrow.operators import imputing as I
from furrow.operators import isolation as ISO
from furrow.operators import neighbors as N
from furrow.operators.groups import attach

DAY = "2000-01-01"
TRAIN = f"t AS (SELECT * FROM h WHERE fecha < DATE '{DAY}')"


def _train(df):
    return df.where(F.col("fecha") < F.lit(DAY).cast("date"))


@query("rare_category_grouper", f"""{HF}, {TRAIN}, f AS (SELECT tipo || fundo AS level FROM t GROUP BY 1 HAVING count(*) >= 80)
  SELECT row_id, CASE WHEN tipo || fundo IN (SELECT level FROM f) THEN tipo || fundo ELSE 'OTROS' END AS level FROM h""")
def rare_category_grouper(spark, sf):
    df = harvest_full(spark, sf).withColumn("level", F.concat("tipo", "fundo"))
    return I.RareCategoryGrouper(["level"], 80).fit(_train(df)).transform(df).select("row_id", "level")


@query("rare_adaptive", f"""{HF}, f AS (SELECT variedad || formato AS level FROM h GROUP BY 1 HAVING count(*) >= 50)
  SELECT CASE WHEN variedad || formato IN (SELECT level FROM f) THEN variedad || formato ELSE 'OTROS' END AS level, count(*) AS n FROM h GROUP BY 1""")
def rare_adaptive(spark, sf):
    df = harvest_full(spark, sf).select(F.concat("variedad", "formato").alias("level"))
    out = I.RareCategoryGrouper(["level"]).fit(df).transform(df)
    return out.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("collapse_rare", f"""{HF}, c AS (SELECT *, count(*) OVER (PARTITION BY tipo || fundo) AS n FROM h)
  SELECT row_id, CASE WHEN n < 100 THEN 'OTROS' ELSE tipo || fundo END AS level FROM c""")
def collapse_rare(spark, sf):
    df = harvest_full(spark, sf).select("row_id", F.concat("tipo", "fundo").alias("level"))
    return I.collapse_rare(df, "level", 100)


@query("missing_flags", f"""{H} SELECT row_id, cast(indus_pct IS NULL AS integer) AS indus_pct__miss, cast(p_baya IS NULL AS integer) AS p_baya__miss,
  cast(indus_pct IS NULL AS integer) + cast(p_baya IS NULL AS integer) AS n_miss_raw FROM h""")
def missing_flags(spark, sf):
    out = I.MissingFlagger().transform(harvest(spark, sf))
    return out.select("row_id", "indus_pct__miss", "p_baya__miss", "n_miss_raw")


@query("median_imputer", f"""{H}, {TRAIN} SELECT row_id, coalesce(p_baya, (SELECT median(p_baya) FROM t)) AS p_baya, indus_pct FROM h""")
def median_imputer(spark, sf):
    df = harvest(spark, sf)
    return I.MedianImputer(["p_baya", "indus_pct"]).fit(_train(df)).transform(df).select("row_id", "p_baya", "indus_pct")


@query("group_median_imputer", f"""{H}, {TRAIN},
  a AS (SELECT fundo, formato, median(p_baya) AS m FROM t GROUP BY ALL HAVING count(p_baya) >= 60),
  b AS (SELECT fundo, median(p_baya) AS m FROM t GROUP BY ALL HAVING count(p_baya) >= 60)
  SELECT row_id, {rs('coalesce(p_baya, a.m, b.m, (SELECT median(p_baya) FROM t))')} AS p_baya FROM h
  LEFT JOIN a USING (fundo, formato) LEFT JOIN b USING (fundo)""")
def group_median_imputer(spark, sf):
    df = harvest(spark, sf)
    out = I.GroupMedianImputer(["p_baya"], least=60).fit(_train(df)).transform(df)
    return out.select("row_id", r("p_baya").alias("p_baya"))


@query("robust_scaler", f"""{H}, {TRAIN}, q AS (SELECT quantile_cont(kg_jr_h, [0.25, 0.5, 0.75]) AS q FROM t)
  SELECT row_id, {rs('(kg_jr_h - q[2]) / (q[3] - q[1])')} AS z, {rs('kg_jr_h', 4)} AS back FROM h, q""")
def robust_scaler(spark, sf):
    df = harvest(spark, sf)
    model = N.RobustScaler(["kg_jr_h"]).fit(_train(df))
    out = model.transform(df).withColumn("z", F.col("kg_jr_h"))
    return model.inverse(out).select("row_id", r("z").alias("z"), r("kg_jr_h", 4).alias("back"))


@query("knn_imputer")
def knn_imputer(spark, sf):
    df = harvest_full(spark, sf).select("row_id", "kg_ha", "indus_pct", "dpc", "p_baya")
    return N.KnnImputer(["kg_ha", "indus_pct", "dpc", "p_baya"]).fit(df).transform(df)


@query("lof_score")
def lof_score(spark, sf):
    df = harvest_full(spark, sf).select("row_id", "kg_ha", "dpc")
    return N.LofScorer(["kg_ha", "dpc"]).fit(df).transform(df)


@query("isolation_scores_cover", f"""{HF} SELECT row_id, CASE WHEN dpc <= 40 THEN tipo END AS tipo, true AS scored FROM h""")
def isolation_scores_cover(spark, sf):
    """Every row has a score, those without a group included."""
    df = harvest_full(spark, sf).select("row_id", F.when(F.col("dpc") <= 40, F.col("tipo")).alias("tipo"), "kg_ha", "kg_jr_h", "dpc")
    out = ISO.isolation_scores(df, ["kg_ha", "kg_jr_h", "dpc"], "tipo", trees=20)
    return out.select("row_id", "tipo", ((F.col("iso_score") > 0) & (F.col("iso_score") <= 1)).alias("scored"))


@query("isolation_filter")
def isolation_filter(spark, sf):
    df = harvest_full(spark, sf).select("row_id", "tipo", "kg_ha", "kg_jr_h", "dpc")
    return ISO.isolation_filter(df, ["kg_ha", "kg_jr_h", "dpc"], "tipo")


IQR = "quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi"


@query("cap_iqr", f"""{H}, {TRAIN}, b AS (SELECT {IQR.format(c='kg_jr_h')} FROM t)
  SELECT row_id, {rs('least(greatest(kg_jr_h, lo), hi)')} AS y FROM h, b""")
def cap_iqr(spark, sf):
    df = harvest(spark, sf)
    return I.OutlierCapper(["kg_jr_h"]).fit(_train(df)).transform(df).select("row_id", r("kg_jr_h").alias("y"))


@query("cap_percentile", f"""{H}, {TRAIN}, b AS (SELECT quantile_cont(kg_jr_h, 0.02) AS lo, quantile_cont(kg_jr_h, 0.97) AS hi FROM t)
  SELECT row_id, {rs('least(greatest(kg_jr_h, lo), hi)')} AS y FROM h, b""")
def cap_percentile(spark, sf):
    df = harvest(spark, sf)
    model = I.OutlierCapper(["kg_jr_h"], "percentile", low=0.02, high=0.97).fit(_train(df))
    return model.transform(df).select("row_id", r("kg_jr_h").alias("y"))


@query("cap_group_cascade", f"""{H}, {TRAIN},
  a AS (SELECT fundo, formato, {IQR.format(c='kg_jr_h')} FROM t GROUP BY ALL HAVING count(*) >= 150),
  b AS (SELECT fundo, {IQR.format(c='kg_jr_h')} FROM t GROUP BY ALL HAVING count(*) >= 150), g AS (SELECT {IQR.format(c='kg_jr_h')} FROM t)
  SELECT row_id, {rs('least(greatest(kg_jr_h, coalesce(a.lo, b.lo, g.lo)), coalesce(a.hi, b.hi, g.hi))')} AS y
  FROM h LEFT JOIN a USING (fundo, formato) LEFT JOIN b USING (fundo), g""")
def cap_group_cascade(spark, sf):
    df = harvest(spark, sf)
    model = I.OutlierCapper(["kg_jr_h"], group=["fundo", "formato"], least=150).fit(_train(df))
    return model.transform(df).select("row_id", r("kg_jr_h").alias("y"))


@query("count_outliers", f"""{H}, v AS (SELECT formato, 'kg_jr_h' AS variable, kg_jr_h AS x FROM h UNION ALL SELECT formato, 'kg_ha', kg_ha FROM h),
  s AS (SELECT formato, variable, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS md, quantile_cont(x, 0.75) AS q3, avg(x) AS mu, stddev_samp(x) AS sd FROM v GROUP BY ALL),
  d AS (SELECT v.*, q1, md, q3, mu, sd, abs(x - md) AS dev FROM v JOIN s USING (formato, variable)),
  m AS (SELECT formato, variable, median(dev) AS mad FROM d GROUP BY ALL)
  SELECT formato, variable, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_iqr,
  count(*) FILTER (abs((x - mu) / sd) > 3) AS n_zscore, count(*) FILTER (abs(0.6745 * (x - md) / mad) > 3.5) AS n_mad
  FROM d JOIN m USING (formato, variable) GROUP BY ALL""")
def count_outliers(spark, sf):
    return I.count_outliers(harvest(spark, sf), ["kg_jr_h", "kg_ha"], ["formato"])


@query("variance_filter", f"{H} SELECT row_id, kg_ha, kg_jr_h FROM h")
def variance_filter(spark, sf):
    df = harvest(spark, sf).select("row_id", "kg_ha", F.signum("kg_ha").alias("one"), F.length("formato").alias("len"), "kg_jr_h")
    return I.VarianceFilter().fit(df).transform(df)


@query("safe_ratio", f"{H} SELECT row_id, {rs('CASE WHEN p_baya > 0.02 THEN kg_ha / (p_baya - 0.02) END')} AS ratio FROM h")
def safe_ratio(spark, sf):
    return harvest(spark, sf).select("row_id", r(SC.safe_ratio(F.col("kg_ha"), F.when(F.col("p_baya") > 0.02, F.col("p_baya") - 0.02))).alias("ratio"))


@query("structural_ratios", f"""{HF} SELECT row_id, {rs('kg_ha * ha', 4)} AS kg_total, {rs('indus_pct * kg_ha', 4)} AS indus_kg_ha,
  {rs('CASE WHEN p_baya > 0 THEN kg_ha / p_baya END', 4)} AS kg_per_baya, {rs('CASE WHEN dpc > 0 THEN kg_ha / dpc END', 4)} AS kg_ha_per_dpc FROM h""")
def structural_ratios(spark, sf):
    return harvest_full(spark, sf).select("row_id", *[r(e, 4).alias(n) for n, e in SC.structural_ratios().items()])


def _wave(fn, h, x, period):
    return rs(f"{fn}({2 * h} * pi() * {x} / {period}.0)")


@query("cyclic_date", f"{H} SELECT row_id, " + ", ".join(
    f"{_wave(fn, h, 'month(fecha)', 12)} AS mes_{fn}{s}" for h, s in ((1, ""), (2, "2"), (3, "3")) for fn in ("sin", "cos")) + ", " + ", ".join(
    f"{_wave(fn, h, 'weekofyear(fecha)', 52)} AS semana_{fn}{s}" for h, s in ((1, ""), (2, "2")) for fn in ("sin", "cos")) + ", cast(year(fecha) AS integer) AS anio FROM h")
def cyclic_date(spark, sf):
    cols = SC.cyclic_date(F.col("fecha"), True)
    return harvest(spark, sf).select("row_id", *[(c if n == "anio" else r(c)).alias(n) for n, c in cols.items()])


@query("fill_date_with_median", f"""{H}, g AS (SELECT row_id, CASE WHEN h_ef > 5 THEN NULL ELSE fecha END AS fecha FROM h)
  SELECT row_id, coalesce(fecha, DATE '1970-01-01' + cast(floor((SELECT quantile_cont(fecha - DATE '1970-01-01', 0.5) FROM g WHERE fecha IS NOT NULL)) AS integer)) AS fecha FROM g""")
def fill_date_with_median(spark, sf):
    df = harvest(spark, sf).select("row_id", F.when(F.col("h_ef") > 5, F.lit(None)).otherwise(F.col("fecha")).alias("fecha"))
    return FE.fill_date_with_median(df)


@query("season_flags", f"{H} SELECT row_id, cast(month(fecha) IN (6,7,8,9,10) AS integer) AS temporada_alta, cast(month(fecha) IN (12,1,2,3,4) AS integer) AS temporada_baja FROM h")
def season_flags(spark, sf):
    from furrow.columns import HIGH_SEASON, LOW_SEASON

    flags = SC.season_flags(F.col("fecha"), HIGH_SEASON, LOW_SEASON)
    return harvest(spark, sf).select("row_id", *[c.alias(n) for n, c in flags.items()])


@query("derive_season_months", f"""{H}, m AS (SELECT fundo, cast(month(fecha) AS integer) AS mo, avg(kg_jr_h) AS mean FROM h GROUP BY ALL HAVING count(*) >= 5),
  l AS (SELECT fundo, count(*) AS n, quantile_cont(mean, 0.66) AS hi, quantile_cont(mean, 0.33) AS lo FROM m GROUP BY ALL)
  SELECT fundo, list(mo ORDER BY mo) FILTER (n >= 3 AND mean >= hi) AS high, list(mo ORDER BY mo) FILTER (n >= 3 AND mean <= lo) AS low FROM m JOIN l USING (fundo) GROUP BY ALL""")
def derive_season_months(spark, sf):
    return FE.derive_season_months(harvest(spark, sf), by=["fundo"])


@query("trend_index", f"{H} SELECT row_id, cast(fecha - (SELECT min(fecha) FROM h) AS double) AS t_index_days, {rs('(fecha - (SELECT min(fecha) FROM h)) / 365.25')} AS t_index_years FROM h")
def trend_index(spark, sf):
    df = harvest(spark, sf)
    df = attach(df, df.agg(F.min("fecha").alias("anchor")))
    cols = SC.trend_index(F.col("fecha"), F.col("anchor"))
    return df.select("row_id", cols["t_index_days"].alias("t_index_days"), r(cols["t_index_years"]).alias("t_index_years"))


@query("skew_transformer", f"""{H}, {TRAIN}, x AS (SELECT h.*, (SELECT greatest(-min(kg_jr_h - 500), 0) FROM t) AS shift FROM h)
  SELECT row_id, kg_ha, {rs('ln(1 + greatest(kg_jr_h - 500 + shift, 0))')} AS y_log1p FROM x""")
def skew_transformer(spark, sf):
    df = harvest(spark, sf).select("row_id", "fecha", "kg_ha", (F.col("kg_jr_h") - 500).alias("y"))
    out = FE.SkewTransformer(["kg_ha", "y"], drop_raw=True).fit(_train(df)).transform(df)
    return out.select("row_id", "kg_ha", r("y_log1p").alias("y_log1p"))


@query("skew_profile", f"""{H}, v AS (SELECT 'kg_ha' AS "column", kg_ha AS x FROM h UNION ALL SELECT 'kg_jr_h', kg_jr_h FROM h UNION ALL SELECT 'p_baya', p_baya FROM h),
  s AS (SELECT "column", count(x) AS n, skewness(x) AS skew, kurtosis(x) AS kurt, greatest(-min(x), 0.0) AS shift FROM v GROUP BY ALL)
  SELECT "column", n, {rs('skew', 4)} AS skew, {rs('kurt', 3)} AS kurt, shift, CASE WHEN abs(kurt) > 50 THEN 'sqrt' WHEN abs(skew) > 1.5 THEN 'log1p' END AS "transform" FROM s""")
def skew_profile(spark, sf):
    out = FE.skew_profile(harvest(spark, sf), ["kg_ha", "kg_jr_h", "p_baya"])
    return out.select("column", "n", r("skew", 4).alias("skew"), r("kurt", 3).alias("kurt"), (F.col("shift") + 0.0).alias("shift"), "transform")


@query("one_hot", f"""{HF} SELECT row_id, {', '.join(f"cast(formato = '{v}' AS integer) AS formato__{v}" for v in ('A', 'N'))} FROM h""")
def one_hot(spark, sf):
    df = harvest_full(spark, sf)
    return FE.OneHot("formato").fit(df.where("formato <> 'R'")).transform(df).select("row_id", "formato__A", "formato__N")


@query("interaction_one_hot", f"""{H} SELECT row_id, {', '.join(f"cast(estado || '__' || formato = '{a}__{b}' AS integer) AS ef__{a}__{b}" for a in 'FO' for b in 'ANR')} FROM h""")
def interaction_one_hot(spark, sf):
    df = harvest(spark, sf)
    model = FE.OneHot(["estado", "formato"], "ef").fit(df)
    return model.transform(df).select("row_id", *model.names())


@query("sparse_one_hot", f"""{HF}, {TRAIN}, l AS (SELECT variedad || '__' || formato AS level, row_number() OVER (ORDER BY variedad || '__' || formato) AS place FROM t WHERE variedad IS NOT NULL AND formato IS NOT NULL GROUP BY 1)
  SELECT row_id, coalesce(place, 0) AS place, cast(l.level IS NOT NULL AS integer) AS n_set FROM h LEFT JOIN l ON l.level = variedad || '__' || formato""")
def sparse_one_hot(spark, sf):
    """Place of the one entry that is set (0 for none) and the number of entries."""
    df = harvest_full(spark, sf)
    model = FE.SparseOneHot(["variedad", "formato"], "v").fit(_train(df))
    values = vector_to_array("v")
    out = model.transform(df).select("row_id", F.array_position(values, 1.0).alias("place"), F.size(F.filter(values, lambda x: x != 0)).alias("n_set"))
    return out


@query("frequency_encode", f"""{H}, t AS (SELECT * FROM h WHERE formato <> 'R'), a AS (SELECT fundo, count(*) / (SELECT count(*) FROM t)::double AS f FROM t GROUP BY 1),
  b AS (SELECT formato, count(*) / (SELECT count(*) FROM t)::double AS f FROM t GROUP BY 1)
  SELECT row_id, {rs('coalesce(a.f, 0)')} AS fundo_freq, {rs('coalesce(b.f, 0)')} AS formato_freq FROM h LEFT JOIN a USING (fundo) LEFT JOIN b USING (formato)""")
def frequency_encode(spark, sf):
    df = harvest(spark, sf)
    out = FE.FrequencyEncoder().fit(df.where("formato <> 'R'")).transform(df)
    return out.select("row_id", r("fundo_freq").alias("fundo_freq"), r("formato_freq").alias("formato_freq"))


@query("drop_concurrent", f"{H} SELECT row_id, fundo, kg_jr_h AS kg_ha_lag_FF_7 FROM h")
def drop_concurrent(spark, sf):
    df = harvest(spark, sf).select("row_id", "fundo", "kg_ha", "indus_pct", (F.col("kg_ha") * 2).alias("kg_total"), F.col("kg_jr_h").alias("kg_ha_lag_FF_7"), F.col("kg_ha").alias("kg_ha_ratio_FF_30"))
    return FE.drop_concurrent(df)


@query("log_target", f"""{H}, {TRAIN}, c AS (SELECT quantile_cont(kg_jr_h, 0.995) AS cap FROM t)
  SELECT row_id, {rs('ln(1 + least(greatest(kg_jr_h, 0), cap))')} AS z, {rs('least(greatest(kg_jr_h, 0), cap)', 4)} AS back FROM h, c""")
def log_target(spark, sf):
    df = harvest(spark, sf)
    out = attach(df, FE.log_target_state(_train(df))).withColumn("z", FE.log_target(F.col("kg_jr_h"), F.col("y_cap")))
    return out.select("row_id", r("z").alias("z"), r(FE.unlog_target(F.col("z")), 4).alias("back"))


@query("daily_kilos", f"{H} SELECT row_id, {rs('CASE WHEN h_ef > 3 THEN kg_ha * (h_ef + 0.123) END', 4)} AS kgjn FROM h")
def daily_kilos(spark, sf):
    hours = F.when(F.col("h_ef") > 3, F.col("h_ef") + 0.123)
    return harvest(spark, sf).select("row_id", r(SC.daily_kilos(F.col("kg_ha"), hours), 4).alias("kgjn"))


@query("iso_week_label", f"{H} SELECT row_id, strftime(fecha, '%G-W%V') AS week FROM h")
def iso_week_label(spark, sf):
    return harvest(spark, sf).select("row_id", SC.iso_week(F.col("fecha")).alias("week"))
