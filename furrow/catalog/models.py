"""Training, scoring, routing, streaming and whole jobs."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from furrow.catalog.base import H, HF, S, harvest, harvest_full, query, r, rs, scored, table
from furrow.columns import FF
from furrow.operators import drift as D
from furrow.operators import evaluation as E
from furrow.operators import lags as L
from furrow.operators import routing as RO
from furrow.operators.cleaning import member_rule, range_rule
from furrow.operators.groups import attach
from furrow.operators.imputing import MedianImputer, OutlierCapper
from furrow.plans import chain as CH
from furrow.plans import training as T
from furrow.plans import varieties as V
from furrow.session import cut, shared_root
from furrow.streaming import streams as ST

FEATURES = ["kg_ha", "dpc", "h_ef", "dia_cosecha"]
SMALL = {"maxIter": 5, "maxDepth": 4, "numTrees": 5}
GRID = ({"maxDepth": 2}, {"maxDepth": 4})


def _rows(spark, sf):
    return harvest_full(spark, sf).select("row_id", "fundo", "formato", "fecha", "tipo", "variedad", "kg_ha", "dpc", "h_ef", "dia_cosecha", "kg_jr_h", "kg_jr")


@query("flagship", None)
def flagship(spark, sf):
    """Lags, seasonal band and ratio, then the group baseline and its errors by format."""
    h = harvest(spark, sf).select("row_id", "fundo", "formato", "fecha", "kg_ha", "kg_jr_h")
    df = L.seasonal_median(h, FF, {"season": ("kg_ha", 365)})
    df = L.rolling_medians(df, FF, L.row_order(), {"lag_30": ("kg_ha", 30)}, first="fecha", base=h)
    df = df.withColumn("ratio", L.safe_ratio(F.col("kg_ha"), F.col("lag_30")))
    cutoff = F.lit("2000-01-01").cast("date")
    scored_rows = E.predict_baseline(df.where(F.col("fecha") >= cutoff), E.fit_baseline(df.where(F.col("fecha") < cutoff)), "y_pred")
    # Read by the metrics, their medians and the means, so lags and baseline are computed once.
    scored_rows = cut(scored_rows.select("formato", F.col("kg_jr_h").alias("y_true"), "y_pred", "ratio", "season"))
    m = E.regression_metrics(scored_rows, ["formato"])
    extra = scored_rows.groupBy("formato").agg(F.avg("ratio").alias("mean_ratio"), F.avg("season").alias("mean_season"))
    out = attach(m, extra, ["formato"])
    return out.select("formato", "n", *[r(c, 4).alias(c) for c in ("mae", "rmse", "mape", "bias", "median_ae", "mean_ratio", "mean_season")])


_LAG = "OVER (PARTITION BY fundo, formato ORDER BY fecha, row_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"
_SEA = "OVER (PARTITION BY fundo, formato ORDER BY fecha RANGE BETWEEN INTERVAL 380 DAYS PRECEDING AND INTERVAL 350 DAYS PRECEDING)"
from furrow.catalog.base import ORACLE  # noqa: E402

ORACLE["flagship"] = f"""{H}, l AS (SELECT *, CASE WHEN count(kg_ha) {_LAG} >= 3 THEN quantile_cont(kg_ha, 0.5) {_LAG} END AS lag_30, CASE WHEN count(*) {_SEA} >= 3 THEN quantile_cont(kg_ha, 0.5) {_SEA} END AS season FROM h),
  t AS (SELECT * FROM h WHERE fecha < DATE '2000-01-01'), a AS (SELECT fundo, formato, median(kg_jr_h) AS m FROM t GROUP BY ALL HAVING count(*) >= 10), b AS (SELECT fundo, median(kg_jr_h) AS m FROM t GROUP BY ALL HAVING count(*) >= 10),
  c AS (SELECT formato, median(kg_jr_h) AS m FROM t GROUP BY ALL HAVING count(*) >= 10), p AS (SELECT l.*, kg_jr_h AS y, coalesce(a.m, b.m, c.m, (SELECT median(kg_jr_h) FROM t)) AS q FROM l LEFT JOIN a USING (fundo, formato) LEFT JOIN b USING (fundo) LEFT JOIN c USING (formato) WHERE fecha >= DATE '2000-01-01')
  SELECT formato, count(*) AS n, {rs('avg(abs(y - q))', 4)} AS mae, {rs('sqrt(avg((y - q) ^ 2))', 4)} AS rmse, {rs('avg(abs(y - q) / y) FILTER (y >= 1) * 100', 4)} AS mape, {rs('avg(q - y)', 4)} AS bias, {rs('median(abs(y - q))', 4)} AS median_ae,
  {rs('avg(CASE WHEN lag_30 > 0 THEN kg_ha / lag_30 END)', 4)} AS mean_ratio, {rs('avg(season)', 4)} AS mean_season FROM p GROUP BY 1"""


@query("train_gbt")
def train_gbt(spark, sf):
    from furrow.operators.folds import density_weights, temporal_tail_holdout

    df = cut(density_weights(temporal_tail_holdout(_rows(spark, sf)), bins=10))
    model = T.train_gbt(df, FEATURES, SMALL, weight="w_density", val="is_val")
    return E.regression_metrics(model.predict(df).withColumn("y_true", F.col("kg_jr_h")), ["formato"])


@query("train_second_backend")
def train_second_backend(spark, sf):
    df = cut(_rows(spark, sf))
    model = T.train_second_backend(df, FEATURES, SMALL)
    return E.regression_metrics(model.predict(df).withColumn("y_true", F.col("kg_jr_h")), ["formato"])


@query("train_residual_hybrid")
def train_residual_hybrid(spark, sf):
    df = cut(_rows(spark, sf))
    model = T.train_residual_hybrid(df, FEATURES, SMALL)
    return E.regression_metrics(model.predict(df).withColumn("y_true", F.col("kg_jr_h")), ["formato"])


@query("inner_search")
def inner_search(spark, sf):
    got = T.inner_search(_rows(spark, sf), FEATURES, "gbt", GRID, 2, "mape", base={"maxIter": 3})
    rows = [(str(sorted(g["params"].items())), g["score"], i + 1) for i, g in enumerate(got)]
    return spark.createDataFrame(rows, "params string, score double, rank int")


@query("nested_cv")
def nested_cv(spark, sf):
    """Five outer and three inner folds, all candidates of the backend, all trees."""
    df = _rows(spark, sf)
    return T.fold_table(df, T.nested_cv(df, FEATURES, "gbt"))


# Folds by hash order, as kfold deals them; each row is predicted once, by a model of the other fold.
@query("nested_cv_oof", f"""{HF} SELECT row_id, (row_number() OVER (ORDER BY md5('42|' || row_id), row_id) - 1) % 2 AS fold_id, true AS predicted FROM h""")
def nested_cv_oof(spark, sf):
    """Out-of-fold rows of a model whose imputer and caps are fitted inside each fold."""
    chain = Pipeline(stages=[MedianImputer(["kg_ha", "dpc"], 0.0), OutlierCapper(["kg_ha", "dpc"], group=["fundo"])])
    got = T.nested_cv(_rows(spark, sf), FEATURES, "gbt", ({"maxDepth": 3},), 2, 2, base={"maxIter": 3}, preprocessor=chain)
    return got.oof.select("row_id", F.col("fold_id").cast("bigint").alias("fold_id"), F.col("y_pred").isNotNull().alias("predicted"))


@query("pick_final_params")
def pick_final_params(spark, sf):
    """The median fold's choice, each fold having searched all candidates of the backend."""
    best = T.pick_final_params(T.nested_cv(_rows(spark, sf), FEATURES, "forest"))
    return spark.createDataFrame([(str(sorted(best.items())),)], "params string")


@query("temporal_honesty_check")
def temporal_honesty_check(spark, sf):
    return T.temporal_honesty_check(_rows(spark, sf), FEATURES, params=SMALL, k=2)


@query("ensemble_predict")
def ensemble_predict(spark, sf):
    df = cut(_rows(spark, sf))
    ens = T.ensemble_fit(df, FEATURES, 3, params={"maxIter": 3, "maxDepth": 3})
    return ens.predict(df).select("row_id", r("y_pred", 4).alias("y_pred"), r("y_pred_std", 4).alias("y_pred_std"))


@query("final_refit")
def final_refit(spark, sf):
    df = cut(_rows(spark, sf))
    part = T.train(df.where("fecha < DATE'2000-01-01'"), FEATURES, "gbt", {"maxIter": 4, "maxDepth": 3})
    full = T.final_refit(df, FEATURES, part, {"maxDepth": 3})
    return spark.createDataFrame([(part.n_trees, part.n_train, full.n_trees, full.n_train)], "trees_found int, rows_found int, trees_final int, rows_final int")


@query("capacity_caps", f"""{H}, n AS (SELECT fundo || formato AS g, count(*) * 4 AS n FROM h GROUP BY 1) SELECT g, n, CASE WHEN n >= 900 THEN 8 WHEN n < 400 THEN 5 ELSE 6 END AS max_depth, CASE WHEN n >= 900 THEN 64 WHEN n < 400 THEN 24 ELSE 32 END AS max_leaves,
  CASE WHEN n >= 900 THEN 5 ELSE cast(greatest(5, round_even(CASE WHEN n < 400 THEN n * 0.02::double ELSE n * 0.015::double END, 0)) AS integer) END AS min_child FROM n""")
def capacity_caps(spark, sf):
    n = harvest(spark, sf).groupBy(F.concat("fundo", "formato").alias("g")).agg((F.count(F.lit(1)) * 4).alias("n"))
    return n.withColumns(T.capacity_caps(F.col("n")))


BY_KEY = ["kg_ha", "dpc", "dia_cosecha", "fundo_freq", "formato_freq"]


def _by_variety(spark, sf, backends=("gbt", "forest")):
    """All varieties with default trees and folds; preprocessing fitted inside each fold."""
    steps = lambda scope: V.scoped_chain(scope, ["kg_ha", "dpc", "dia_cosecha"])
    return V.cross_validate(_rows(spark, sf), BY_KEY, "variedad", {b: V.DEFAULTS[b] for b in backends}, preprocessor=steps)


@query("train_all_varieties")
def train_all_varieties(spark, sf):
    return _by_variety(spark, sf)[0]


# Folds by hash order inside a variety; each row is predicted once a backend, by models of other folds.
@query("varieties_oof", f"""{HF}, f AS (SELECT row_id, variedad, (row_number() OVER (PARTITION BY variedad ORDER BY md5('42|' || row_id), row_id) - 1) % 5 AS fold_id, kg_jr_h FROM h WHERE variedad IS NOT NULL AND kg_jr_h IS NOT NULL),
  m AS (SELECT 'gbt' AS model_type) SELECT row_id, variedad, model_type, fold_id, {rs('kg_jr_h', 4)} AS y_true, true AS predicted, true AS sane FROM f, m""")
def varieties_oof(spark, sf):
    """Every row once, and whether its variety's error stays within 1.5 times the baseline's."""
    results, oof = _by_variety(spark, sf, ["gbt"])
    sane = results.select("variedad", "model_type", (F.col("mae_test") < 1.5 * F.col("baseline_mae")).alias("sane"))
    out = oof.join(sane, ["variedad", "model_type"])
    return out.select("row_id", "variedad", "model_type", F.col("fold_id").cast("bigint").alias("fold_id"), r("y_true", 4).alias("y_true"), F.col("y_pred").isNotNull().alias("predicted"), "sane")


@query("varieties_search", f"{HF} SELECT formato, 'gbt' AS model_type, 8 AS n_candidates, 36 AS rank_sum FROM h WHERE formato IS NOT NULL GROUP BY formato")
def varieties_search(spark, sf):
    """Eight drawn candidates a format over all its rows, halved once: how many came out, and the sum of their ranks."""
    rows = _rows(spark, sf).where(F.col("formato").isNotNull())
    table = V.search(rows, ["formato"], ["kg_ha", "dpc", "dia_cosecha"], {"gbt": V.GBT_SPACE.draw(8)}, 2, halving=((0.25, 0.25), (1.0, 0.5)))
    return table.groupBy("formato", "model_type").agg(F.count(F.lit(1)).alias("n_candidates"), F.sum("rank").alias("rank_sum"))


def _two_models(spark, sf, key="formato"):
    df = cut(_rows(spark, sf))
    models = {v: T.train(df.where(F.col(key) == v), FEATURES, "gbt", {"maxIter": 2, "maxDepth": 3}) for v in ("A", "N", "R")}
    return df, models


@query("score_batch")
def score_batch(spark, sf):
    df, models = _two_models(spark, sf)
    bands = E.conformal_bands(T.score_batch(df, models, "formato").withColumn("y_true", F.col("kg_jr_h")))
    base = D.drift_baseline(df, ["kg_ha", "dpc"], ["fundo"], "formato")
    out = T.score_batch(df, models, "formato", "h_ef", bands, base)
    return out.select("row_id", r("y_pred", 4).alias("y_pred"), r("kgjn_pred", 4).alias("kgjn_pred"), r("low", 4).alias("low"), r("high", 4).alias("high"), "confidence", "drift_status", "score_reason")


@query("score_batch_coverage", f"""{HF} SELECT row_id, formato IN ('A', 'N') AS predicted, CASE WHEN formato NOT IN ('A', 'N') THEN 'no model' END AS score_reason FROM h""")
def score_batch_coverage(spark, sf):
    """Every row comes out, with a model's prediction or with the reason why not."""
    df = cut(_rows(spark, sf))
    models = {v: T.train(df.where(F.col("formato") == v), FEATURES, "gbt", {"maxIter": 2, "maxDepth": 3}) for v in ("A", "N")}
    out = T.score_batch(df, models, "formato")
    return out.select("row_id", F.col("y_pred").isNotNull().alias("predicted"), "score_reason")


@query("rescore_changed", f"""{H} SELECT row_id, {rs("CASE WHEN formato = 'A' THEN (kg_ha + 1) * 3 ELSE kg_ha * 3 + 0.5 END")} AS y_pred, formato = 'A' AS rescored FROM h""")
def rescore_changed(spark, sf):
    h = harvest(spark, sf).select("row_id", "formato", "kg_ha", "h_ef")
    old = h.withColumn("y_pred", F.col("kg_ha") * 3 + 0.5)
    new = h.withColumn("kg_ha", F.when(F.col("formato") == "A", F.col("kg_ha") + 1).otherwise(F.col("kg_ha")))
    out = T.rescore_changed(old, new, ["kg_ha", "h_ef"], lambda df: df.withColumn("y_pred", F.col("kg_ha") * 3))
    return out.select("row_id", r("y_pred").alias("y_pred"), "rescored")


@query("warm_start", f"""{H}, l AS (SELECT fundo, CASE WHEN count(*) % 3 = 0 THEN 'forest' ELSE 'gbt' END AS b, cast(count(*) % 12 AS integer) AS d, cast(count(*) % 90 AS integer) AS lv, avg(kg_ha) - 24 AS gap, 3.0 AS mt FROM h WHERE formato <> 'R' GROUP BY 1 HAVING count(*) % 7 <> 0),
  q AS (SELECT DISTINCT fundo FROM h) SELECT fundo, CASE WHEN b = 'gbt' AND abs(gap) / mt <= 0.4 THEN least(greatest(d, 3), 8) END AS seed_depth, CASE WHEN b = 'gbt' AND abs(gap) / mt <= 0.4 THEN least(greatest(lv, 8), 64) END AS seed_leaves,
  CASE WHEN b IS NULL THEN 'no_model' WHEN b <> 'gbt' THEN 'other_backend' WHEN abs(gap) / mt > 0.4 THEN 'overfit' ELSE 'seeded' END AS start FROM q LEFT JOIN l USING (fundo)""")
def warm_start(spark, sf):
    h = harvest(spark, sf)
    n = F.count(F.lit(1))
    last = h.where("formato <> 'R'").groupBy("fundo").agg(
        F.when(n % 3 == 0, "forest").otherwise("gbt").alias("backend"), (n % 12).cast("int").alias("depth"), (n % 90).cast("int").alias("leaves"),
        (F.avg("kg_ha") - 24).alias("gap"), F.lit(3.0).alias("mae_test"), n.alias("n")).where("n % 7 <> 0")
    req = h.select("fundo").distinct().withColumn("backend", F.lit("gbt"))
    return T.warm_start(req, last, "fundo").drop("backend")


@query("partial_dependence")
def partial_dependence(spark, sf):
    df, models = _two_models(spark, sf)
    return T.partial_dependence(models["A"], df, 2, 10)


# Routing over brands: four anchors, two features.
ANCHORS = ["Brand#1", "Brand#2", "Brand#3", "Brand#4"]
RF = ["kg_ha", "kg_jr_h"]
_A = ", ".join(f"'{a}'" for a in ANCHORS)
RT = f"""{HF}, an AS (SELECT unnest([{_A}]) AS anchor), va AS (SELECT DISTINCT variedad FROM h WHERE variedad NOT IN ({_A})), lg AS (SELECT variedad, 'kg_ha' AS variable, kg_ha AS x FROM h UNION ALL SELECT variedad, 'kg_jr_h', kg_jr_h FROM h),
  vc AS (SELECT variedad, variable, x, count(*) AS c FROM lg GROUP BY ALL), pv AS (SELECT variedad, anchor, variable, x, c AS a, 0 AS b FROM vc, an WHERE variedad NOT IN ({_A}) UNION ALL SELECT va.variedad, vc.variedad, variable, x, 0, c FROM vc, va WHERE vc.variedad IN ({_A})),
  pc AS (SELECT variedad, anchor, variable, x, sum(a) AS a, sum(b) AS b FROM pv GROUP BY ALL), pw AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY variedad, anchor, variable) AS na, sum(b) OVER (PARTITION BY variedad, anchor, variable) AS nb, lead(x) OVER (PARTITION BY variedad, anchor, variable ORDER BY x) AS nx FROM pc
  WINDOW w AS (PARTITION BY variedad, anchor, variable ORDER BY x ROWS UNBOUNDED PRECEDING)),
  pf AS (SELECT variedad, anchor, variable, max(na)::double AS na, max(nb)::double AS nb, sum(abs(ca::double / na - cb::double / nb) * (nx - x)) AS w1, sum(a * (ca + cb - (a + b - 1) / 2.0)) - max(na) * (max(na) + 1) / 2.0 AS u, sum((a + b)::double ^ 3 - (a + b)) AS ties FROM pw GROUP BY ALL),
  pd AS (SELECT *, 2 * u / (na * nb) - 1 AS delta, greatest(abs(u - na * nb / 2) - 0.5, 0) / sqrt(na * nb / 12 * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1)))) AS z FROM pf),
  ds AS (SELECT variedad, anchor, avg(w1) AS w1, max(abs(delta)) AS mx, avg(abs(delta)) AS mn FROM pd GROUP BY ALL), asg AS (SELECT *, row_number() OVER (PARTITION BY variedad ORDER BY mx, w1, anchor) AS rk FROM ds)"""


def _dist(spark, sf):
    return cut(RO.pair_distances(harvest_full(spark, sf), RF, ANCHORS))


@query("viability", f"{HF}, n AS (SELECT variedad, formato, count(*) AS n FROM h GROUP BY ALL) SELECT variedad, formato, n, CASE WHEN n >= 638 THEN 'robusto' WHEN n >= 160 THEN 'basico' WHEN n >= 80 THEN 'minimo' ELSE 'insuficiente' END AS zone FROM n")
def viability(spark, sf):
    n = harvest_full(spark, sf).groupBy("variedad", "formato").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("zone", RO.viability(F.col("n")))


@query("pairwise_groups", f"{RT} SELECT variedad, anchor FROM va, an")
def pairwise_groups(spark, sf):
    return RO.pairwise_groups(harvest_full(spark, sf), ANCHORS)


@query("wasserstein", f"{RT} SELECT variedad, anchor, {rs('w1', 4)} AS w1 FROM ds")
def wasserstein(spark, sf):
    return _dist(spark, sf).select("variedad", "anchor", r("w1", 4).alias("w1"))


@query("cliffs_delta", f"{RT} SELECT variedad, anchor, {rs('mx')} AS max_cliff, {rs('mn')} AS mean_cliff FROM ds")
def cliffs_delta(spark, sf):
    return _dist(spark, sf).select("variedad", "anchor", r("max_cliff").alias("max_cliff"), r("mean_cliff").alias("mean_cliff"))


@query("assign_to_anchor", f"{RT} SELECT a.variedad, a.anchor, {rs('a.w1', 4)} AS w1, b.anchor AS second, {rs('b.w1', 4)} AS w1_second FROM asg a JOIN asg b ON a.variedad = b.variedad AND a.rk = 1 AND b.rk = 2")
def assign_to_anchor(spark, sf):
    out = RO.assign_to_anchor(_dist(spark, sf))
    return out.select("variedad", "anchor", r("w1", 4).alias("w1"), "second", r("w1_second", 4).alias("w1_second"))


# |z| under 1.959963985 is p above 0.05.
@query("validate_mann_whitney", f"""{RT}, o AS (SELECT variedad, anchor, count(*) FILTER (z < 1.959963984540054) AS n_similar, count(*) AS n_total FROM pd WHERE na >= 3 AND nb >= 3 AND (variedad, anchor) IN (SELECT (variedad, anchor) FROM asg WHERE rk = 1) GROUP BY ALL)
  SELECT variedad, anchor, n_similar, n_total, {rs('n_similar * 100.0 / n_total', 4)} AS pct_similar, n_similar * 100.0 / n_total >= 60 AS ok FROM o""")
def validate_mann_whitney(spark, sf):
    df = harvest_full(spark, sf)
    sums = RO.pair_sums(df, RF, ANCHORS)
    out = RO.validate_mann_whitney(RO.mann_whitney_pairs(df, RF, ANCHORS, sums=sums), RO.assign_to_anchor(cut(RO.pair_distances(df, RF, ANCHORS, sums=sums))))
    return out.withColumn("pct_similar", r("pct_similar", 4))


# With two features Holm compares the smaller p with 0.025 and the larger with 0.05.
@query("mann_whitney_holm", f"""{RT}, hk AS (SELECT *, row_number() OVER (PARTITION BY variedad, anchor ORDER BY z DESC, variable) AS i FROM pd), hr AS (SELECT *, bool_and(z >= CASE WHEN i = 1 THEN 2.241402727604947 ELSE 1.959963984540054 END) OVER (PARTITION BY variedad, anchor ORDER BY i ROWS UNBOUNDED PRECEDING) AS rej FROM hk),
  hp AS (SELECT variedad, anchor, count(*) FILTER (NOT rej) * 100.0 / count(*) AS pct, count(*) AS n_valid FROM hr GROUP BY ALL), mk AS (SELECT hp.*, asg.rk = 1 AS mine FROM hp JOIN asg USING (variedad, anchor))
  SELECT variedad, anchor, {rs('pct', 4)} AS pct_similar_holm, n_valid, {rs('(SELECT quantile_cont(pct, 0.9) FROM mk WHERE NOT mine)', 4)} AS threshold FROM mk WHERE mine""")
def mann_whitney_holm(spark, sf):
    df = harvest_full(spark, sf)
    sums = RO.pair_sums(df, RF, ANCHORS)
    out = RO.mann_whitney_holm(RO.mann_whitney_pairs(df, RF, ANCHORS, sums=sums), RO.assign_to_anchor(cut(RO.pair_distances(df, RF, ANCHORS, sums=sums))))
    return out.withColumns({c: r(c, 4) for c in ("pct_similar_holm", "threshold")})


@query("validate_effect_size", f"""{RT}, n AS (SELECT variedad, count(*) AS n FROM h GROUP BY 1) SELECT variedad, anchor, n, {rs('CASE WHEN n >= 2300 THEN mx END')} AS max_cliff, CASE WHEN n < 2300 THEN 'insuficiente' WHEN mx < 0.33 THEN 'similar' WHEN mx < 0.474 THEN 'moderado' ELSE 'diferente' END AS verdict FROM asg JOIN n USING (variedad) WHERE rk = 1""")
def validate_effect_size(spark, sf):
    sizes = harvest_full(spark, sf).groupBy("variedad").agg(F.count(F.lit(1)).alias("n"))
    out = RO.validate_effect_size(RO.assign_to_anchor(_dist(spark, sf)), sizes, least=2300)
    return out.select("variedad", "anchor", "n", r("max_cliff").alias("max_cliff"), "verdict")


@query("bootstrap_stability")
def bootstrap_stability(spark, sf):
    df = harvest_full(spark, sf)
    return RO.bootstrap_stability(df, RO.assign_to_anchor(_dist(spark, sf)), RF, ANCHORS)


@query("silhouette")
def silhouette(spark, sf):
    df = harvest_full(spark, sf)
    return spark.createDataFrame([("tipo", RO.silhouette(df, "tipo", ["kg_ha", "dpc"]))], "label string, silhouette double")


@query("centroids", f"{HF} SELECT variedad, {rs('avg(kg_ha)')} AS kg_ha, {rs('avg(kg_jr_h)', 4)} AS kg_jr_h FROM h GROUP BY 1")
def centroids(spark, sf):
    return RO.centroids(harvest_full(spark, sf), RF).select("variedad", r("kg_ha").alias("kg_ha"), r("kg_jr_h", 4).alias("kg_jr_h"))


@query("centroid_silhouette", f"""{HF}, c AS (SELECT variedad, substr(variedad, 7, 1) AS g, avg(kg_ha) AS a, avg(dpc) AS b FROM h GROUP BY ALL), k AS (SELECT * FROM c WHERE g IN (SELECT g FROM c GROUP BY 1 HAVING count(*) > 1)),
  d AS (SELECT x.variedad, x.g, y.g AS og, avg(sqrt((x.a - y.a) ^ 2 + (x.b - y.b) ^ 2)) AS m FROM k x JOIN k y ON x.variedad <> y.variedad GROUP BY ALL), s AS (SELECT variedad, g, min(m) FILTER (og = g) AS a, min(m) FILTER (og <> g) AS b FROM d GROUP BY ALL)
  SELECT variedad, {rs('(b - a) / greatest(a, b)')} AS silhouette FROM s""")
def centroid_silhouette(spark, sf):
    c = RO.centroids(harvest_full(spark, sf), ["kg_ha", "dpc"]).withColumn("g", F.substring("variedad", 7, 1))
    return RO.centroid_silhouette(c, ["kg_ha", "dpc"], "g").select("variedad", r("silhouette").alias("silhouette"))


@query("intra_inter_ratio", f"""{RT}, m AS (SELECT avg(w1) FILTER (rk = 1) AS a, avg(w1) FILTER (rk > 1) AS b FROM asg) SELECT {rs('a', 4)} AS mean_intra, {rs('b', 4)} AS mean_inter, {rs('a / b')} AS ratio FROM m""")
def intra_inter_ratio(spark, sf):
    d = _dist(spark, sf)
    out = RO.intra_inter_ratio(d, RO.assign_to_anchor(d))
    return out.select(r("mean_intra", 4).alias("mean_intra"), r("mean_inter", 4).alias("mean_inter"), r("ratio").alias("ratio"))


@query("k_sweep")
def k_sweep(spark, sf):
    return RO.k_sweep(harvest_full(spark, sf), ["kg_ha", "dpc"], 3, 5)


@query("route_predictive")
def route_predictive(spark, sf):
    df = _rows(spark, sf)
    return T.route_predictive(df, ["ECONOMY", "STANDARD"], FEATURES, "tipo", params={"maxIter": 2, "maxDepth": 3}, own_folds=2)


DEC = f"""{HF}, e0 AS (SELECT variedad, kg_ha, kg_jr_h FROM h), am AS (SELECT variedad AS anchor, median(kg_jr_h) AS m FROM h WHERE variedad IN ({_A}) GROUP BY 1), er AS (SELECT variedad, anchor, avg(abs(kg_jr_h - m) / kg_jr_h) * 100 AS mape, count(*) AS n FROM e0, am GROUP BY ALL),
  ow AS (SELECT variedad, avg(abs(kg_jr_h - 3000) / kg_jr_h) * 100 AS mape FROM h GROUP BY 1), bs AS (SELECT avg(mape) AS b FROM er WHERE variedad = anchor), be AS (SELECT variedad, arg_min(anchor, (mape, anchor)) AS trains_with, min(mape) AS oos, max(n) AS n FROM er WHERE variedad NOT IN ({_A}) GROUP BY 1),
  dc AS (SELECT variedad, trains_with, n, oos, ow.mape - oos AS gain, oos / b AS ratio, CASE WHEN oos / b <= 1.5 THEN 'bueno' WHEN oos / b <= 2 THEN 'aceptable' ELSE 'revisar' END AS decision FROM be JOIN ow USING (variedad), bs
  UNION ALL SELECT variedad, anchor, n, mape, 0, 1, 'ancla' FROM er WHERE variedad = anchor)"""


def _decisions(spark, sf):
    """Decisions from a median model per anchor."""
    df = harvest_full(spark, sf).select("variedad", "kg_jr_h")
    am = RO.quantiles(df.where(F.col("variedad").isin(ANCHORS)), ["variedad"], {"m": ("kg_jr_h", 0.5)})
    pairs = am.agg(F.collect_list(F.struct(F.col("variedad").alias("anchor"), "m")).alias("all"))
    long = attach(df, pairs).select("variedad", "kg_jr_h", F.explode("all").alias("_p"))
    err = long.groupBy("variedad", F.col("_p.anchor").alias("anchor")).agg((F.avg(F.abs(F.col("kg_jr_h") - F.col("_p.m")) / F.col("kg_jr_h")) * 100).alias("mape"), F.count(F.lit(1)).alias("n"))
    own = df.groupBy("variedad").agg((F.avg(F.abs(F.col("kg_jr_h") - 3000) / F.col("kg_jr_h")) * 100).alias("mape"))
    return RO.routing_decisions(err, own, ANCHORS)


@query("routing_decisions", f"{DEC} SELECT variedad, trains_with, n, {rs('oos', 3)} AS mape_oos, {rs('gain', 3)} AS gain, {rs('ratio', 5)} AS ratio, decision FROM dc")
def routing_decisions(spark, sf):
    return _decisions(spark, sf).select("variedad", "trains_with", "n", r("mape_oos", 3).alias("mape_oos"), r("gain", 3).alias("gain"), r("ratio", 5).alias("ratio"), "decision")


@query("routing_kpis", f"""{DEC} SELECT count(*) FILTER (decision = 'ancla') AS n_anchor, count(*) FILTER (decision <> 'ancla') AS n_routed, count(*) FILTER (decision <> 'revisar') AS n_reliable, count(*) FILTER (decision = 'revisar') AS n_review, {rs("avg(gain) FILTER (decision <> 'ancla')", 3)} AS mean_gain FROM dc""")
def routing_kpis(spark, sf):
    return RO.routing_kpis(_decisions(spark, sf)).withColumn("mean_gain", r("mean_gain", 3))


FT = f"""{RT}, n AS (SELECT variedad, count(*) AS n FROM h GROUP BY 1), ft AS (SELECT variedad, n, CASE WHEN n >= 638 THEN 'robusto' WHEN n >= 160 THEN 'basico' WHEN n >= 80 THEN 'minimo' ELSE 'insuficiente' END AS zone, variedad AS trains_with, 0.0::double AS w1 FROM n WHERE variedad IN ({_A})
  UNION ALL SELECT variedad, n, 'agrupar', anchor, {rs('w1', 4)} FROM asg JOIN n USING (variedad) WHERE rk = 1)"""


def _final(spark, sf):
    sizes = harvest_full(spark, sf).groupBy("variedad").agg(F.count(F.lit(1)).alias("n"))
    a = RO.assign_to_anchor(_dist(spark, sf))
    return RO.final_table(sizes, a, a.select("variedad", F.lit(60.0).alias("pct_similar")), ANCHORS)


@query("final_table", f"{FT} SELECT * FROM ft")
def final_table(spark, sf):
    return _final(spark, sf).select("variedad", "n", "zone", "trains_with", r("w1", 4).alias("w1"))


@query("group_summary", f"{FT} SELECT trains_with AS anchor, cast(coalesce(sum(n) FILTER (variedad = trains_with), 0) AS bigint) AS own_rows, cast(coalesce(sum(n) FILTER (variedad <> trains_with), 0) AS bigint) AS assigned_rows, count(*) FILTER (variedad <> trains_with) AS n_assigned, cast(sum(n) AS bigint) AS total FROM ft GROUP BY 1")
def group_summary(spark, sf):
    return RO.group_summary(_final(spark, sf))


@query("preprocessing_chain")
def preprocessing_chain(spark, sf):
    """Fitted before 2000, applied to the rows after."""
    df = harvest_full(spark, sf).select("row_id", "fundo", "formato", "fecha", "kg_ha", "indus_pct", "dpc", "p_baya", "ha", "dia_cosecha", "kg_jr_h")
    day = F.lit("2000-01-01").cast("date")
    train = cut(df.where(F.col("fecha") < day))
    model = CH.preprocessing_chain(knn=False, lof=False).fit(train)
    out = model.transform(df.where(F.col("fecha") >= day))
    return out.select("row_id", "kg_ha", "kg_total", "kg_ha_lag_FF_30", "n_miss_raw", "mes_sin", "t_index_days", "formato__A")


@query("saved_chain", f"{HF} SELECT row_id, true AS same FROM h WHERE fecha >= DATE '2000-01-01'")
def saved_chain(spark, sf):
    """A fitted chain with lags, written and read back, gives every later row as before."""
    df = harvest_full(spark, sf).select("row_id", "fundo", "formato", "fecha", "kg_ha", "indus_pct", "dpc", "p_baya", "ha", "dia_cosecha", "kg_jr_h")
    day = F.lit("2000-01-01").cast("date")
    model = CH.preprocessing_chain(knn=False, lof=False).fit(cut(df.where(F.col("fecha") < day)))
    path = f"{shared_root(spark)}/furrow/{spark.sparkContext.applicationId}/chain-{uuid.uuid4().hex}"
    model.write().save(path)
    new = df.where(F.col("fecha") >= day)
    first, again = model.transform(new), PipelineModel.load(path).transform(new)
    digest = lambda x, name: x.select("row_id", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in first.columns]).alias(name))
    both = digest(first, "_a").join(digest(again, "_b"), "row_id", "full")
    return both.select("row_id", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("same"))


def _eda(spark, sf):
    df = harvest_full(spark, sf)
    return CH.run_eda(df, ["estado"], ["kg_ha", "dpc"], ["formato", "tipo"])


@query("run_eda_findings")
def run_eda_findings(spark, sf):
    return _eda(spark, sf)["findings"]


@query("run_eda_summary")
def run_eda_summary(spark, sf):
    return _eda(spark, sf)["drift_summary"]


@query("evaluation_report")
def evaluation_report(spark, sf):
    t = CH.evaluation_report(scored(spark, sf), 0.1)
    a = t["intervals"].select(F.col("metric").alias("item"), F.col("point").alias("value"))
    b = t["actions"].select(F.col("subject").alias("item"), "value")
    c = t["calibration"].select(F.concat(F.lit("bin"), F.col("bin_idx").cast("string")).alias("item"), F.col("bin_diff_pct").alias("value"))
    d = t["heteroscedasticity"].select(F.lit("breusch_pagan").alias("item"), F.col("statistic").alias("value"))
    return a.unionByName(b).unionByName(c).unionByName(d)


# Streams over the files of the given tables.
def _place(spark, name):
    root = f"{shared_root(spark)}/furrow-stream/{name}-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


def _stream(spark, sf, name):
    return ST.file_stream(spark, sf, table(spark, sf, name).schema, f"{name}.parquet")


def _events(spark, sf):
    return _stream(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("stream_validate", """SELECT event_id AS "row", 'value' AS "column", 'must be between 1 and 200' AS reason FROM events WHERE NOT (value BETWEEN 1 AND 200)
  UNION ALL SELECT event_id, 'event_type', 'value not allowed' FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')""")
def stream_validate(spark, sf):
    out, ck = _place(spark, "validate")
    rules = [range_rule("value", 1, 200), member_rule("event_type", ["view", "click", "purchase"])]
    q = ST.stream_validate(_stream(spark, sf, "events"), rules, f"{out}/good", f"{out}/issues", ck, "event_id")
    q.awaitTermination()
    return spark.read.parquet(f"{out}/issues").select(F.col("row").cast("bigint").alias("row"), "column", "reason")


@query("stream_row_drift", """WITH o AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15'), b AS (SELECT event_type, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM o GROUP BY 1), z AS (SELECT event_id, abs(value - q[2]) / greatest(q[3] - q[1], 1e-9) AS z FROM events JOIN b USING (event_type))
  SELECT event_id, CASE WHEN z >= 3 THEN 'alert' WHEN z >= 1 THEN 'warning' ELSE 'ok' END AS drift_status FROM z""")
def stream_row_drift(spark, sf):
    out, ck = _place(spark, "rowdrift")
    old = table(spark, sf, "events").where(F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))).withColumn("fecha", F.to_date("ts"))
    base = D.drift_baseline(old, ["value"], [], "event_type", "fecha", "event_id")
    base["numeric"] = cut(base["numeric"])
    drifted = ST.stream_row_drift(_stream(spark, sf, "events"), base, ["value"], [], "event_type").select("event_id", "drift_status")
    ST.run_available(drifted, out, ck).awaitTermination()
    return spark.read.schema("event_id bigint, drift_status string").parquet(out)


@query("stream_batch_drift", """WITH o AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15'), b AS (SELECT event_type, quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95]) AS e FROM o GROUP BY 1),
  lim AS (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM events), g AS (SELECT event_type, date_trunc('week', ts) AS w, len(list_filter(e, lambda q: q <= value)) AS bin FROM events JOIN b USING (event_type)),
  s AS (SELECT event_type, len(list_filter(e, lambda q: q <= value)) AS bin, count(*) / sum(count(*)) OVER (PARTITION BY event_type) AS share FROM o JOIN b USING (event_type) GROUP BY event_type, 2),
  t AS (SELECT event_type, w, count(*) AS n FROM g, lim WHERE w + INTERVAL 7 DAY <= wm GROUP BY ALL), a AS (SELECT t.event_type, t.w, t.n, s.share, coalesce(c.c, 0) AS c FROM t JOIN s USING (event_type) LEFT JOIN (SELECT event_type, w, bin, count(*) AS c FROM g GROUP BY ALL) c ON c.event_type = t.event_type AND c.w = t.w AND c.bin = s.bin)
  SELECT event_type, cast(w AS date) AS week_start, max(n) AS n_observed, """ + rs("sum((greatest(c / n, 1e-4) - greatest(share, 1e-4)) * ln(greatest(c / n, 1e-4) / greatest(share, 1e-4)))") + " AS psi FROM a GROUP BY event_type, w")
def stream_batch_drift(spark, sf):
    from furrow.functions.scalar import edge_bin_left

    out, ck = _place(spark, "batchdrift")
    old = table(spark, sf, "events").where(F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))).withColumn("fecha", F.to_date("ts"))
    base = D.drift_baseline(old, ["value"], [], "event_type", "fecha", "event_id")
    edges = cut(base["numeric"].select("event_type", "variable", F.array("p05", "p25", "center", "p75", "p95").alias("e")))
    bins = attach(old.withColumn("variable", F.lit("value")), edges, ["event_type", "variable"]).groupBy("event_type", "variable", edge_bin_left(F.col("value"), F.col("e")).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    total = bins.groupBy("event_type", "variable").agg(F.sum("c").alias("t"))
    shares = cut(attach(bins, total, ["event_type", "variable"]).select("event_type", "variable", "bin", (F.col("c") / F.col("t")).alias("share")))
    ST.stream_batch_drift(_events(spark, sf), edges, shares, ["value"], "at", out, ck, "event_type").awaitTermination()
    return spark.read.parquet(out).select("event_type", F.to_date("window_start").alias("week_start"), "n_observed", r("psi").alias("psi"))


@query("stream_weekly", f"""WITH l AS (SELECT max(ts) - INTERVAL 7 DAY AS wm FROM events) SELECT event_type, cast(date_trunc('week', ts) AS date) AS week_start, {rs('sum(value) * 1.1', 3)} AS proj_sum, {rs('sum(value)', 3)} AS real_sum, count(*) AS n
  FROM events, l WHERE date_trunc('week', ts) + INTERVAL 7 DAY <= wm GROUP BY ALL""")
def stream_weekly(spark, sf):
    out, ck = _place(spark, "weekly")
    points = _events(spark, sf).select("event_type", "at", (F.col("value") * 1.1).alias("pred_original"), F.col("value").alias("real"))
    ST.run_available(ST.stream_weekly(points, "at", ["event_type"]), out, ck).awaitTermination()
    return spark.read.parquet(out).select("event_type", "week_start", r("proj_sum", 3).alias("proj_sum"), r("real_sum", 3).alias("real_sum"), "n")


@query("stream_dedup_forecasts", "SELECT DISTINCT user_id, event_type, cast(ts AS date) AS fecha FROM events")
def stream_dedup_forecasts(spark, sf):
    out, ck = _place(spark, "dedup")
    s = _events(spark, sf).withColumn("fecha", F.to_date("ts"))
    one = ST.stream_dedup_forecasts(s, "at", ["user_id", "event_type", "fecha"], "40 days").select("user_id", "event_type", "fecha")
    ST.run_available(one, out, ck).awaitTermination()
    return spark.read.parquet(out)


@query("stream_match", """SELECT f.event_id AS forecast, a.event_id AS actual FROM events f JOIN events a ON f.user_id = a.user_id AND f.event_type = 'view' AND a.event_type = 'purchase' AND a.ts BETWEEN f.ts - INTERVAL 1 DAY AND f.ts + INTERVAL 1 DAY""")
def stream_match(spark, sf):
    out, ck = _place(spark, "match")
    s = _events(spark, sf)
    f = s.where("event_type = 'view'").select(F.col("event_id").alias("forecast"), "user_id", F.col("at").alias("f_at"))
    a = s.where("event_type = 'purchase'").select(F.col("event_id").alias("actual"), "user_id", F.col("at").alias("a_at"))
    ST.run_available(ST.stream_match(f, a, ["user_id"], "f_at", "a_at").select("forecast", "actual"), out, ck).awaitTermination()
    return spark.read.schema("forecast bigint, actual bigint").parquet(out)
