"""Models of all varieties in one job, scoped steps and exact resampled distances, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow.functions.scalar import hash_bucket, replicate_weights
from furrow.operators.features import FrequencyEncoder
from furrow.operators.imputing import GroupMedianImputer, MedianImputer, OutlierCapper, RareCategoryGrouper
from furrow.operators.routing import bootstrap_distances
from furrow.plans import boosting as B
from furrow.plans import varieties as V
from furrow.session import HOT_ROWS_KEY


def boosted_by_hand(x, y, w, p, bins=32):
    pred = np.full(len(y), np.sort(y)[max(int(np.ceil(len(y) * 0.5)), 1) - 1] if p.loss == "absolute" else (y * w).sum() / w.sum())
    cuts = []
    for j in range(x.shape[1]):
        v = np.sort(x[~np.isnan(x[:, j]), j])
        cuts.append(np.unique([v[max(int(np.ceil(len(v) * q / bins)), 1) - 1] for q in range(1, bins)]) if len(v) else np.zeros(0))
    binned = np.column_stack([np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(cuts[j], x[:, j], side="left")) for j in range(x.shape[1])])
    for _ in range(p.trees):
        rest = np.sign(y - pred) if p.loss == "absolute" else y - pred

        def grow(at, depth, rest=rest):
            g, total, best = (w[at] * rest[at]).sum(), w[at].sum(), None
            if depth < p.depth:
                for j in range(x.shape[1]):
                    for b in sorted(set(binned[at, j])):
                        left, right = at[binned[at, j] <= b], at[binned[at, j] > b]
                        if min(len(left), len(right)) < p.min_rows:
                            continue
                        fit = [((w[s] * rest[s]).sum() ** 2) / (w[s].sum() + p.ridge) for s in (left, right, at)]
                        gain = round(fit[0] + fit[1] - fit[2], 9)
                        if best is None or gain > best[0]:
                            best = (gain, left, right)
            if best is None or best[0] <= 1e-12 * max(1.0, g * g / total):
                pred[at] += p.step * g / (total + p.ridge)
                return
            grow(best[1], depth + 1)
            grow(best[2], depth + 1)

        grow(np.arange(len(y)), 0)
    return pred


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        k, x, z = ["a", "b", None][i % 3], float(rng.normal()), float(rng.normal()) if i % 9 else None
        rows.append((k, i, x, z, float((x > 0.3) * 2 + (z or 0) * x + 3 * (k == "a") + 0.1 * rng.normal()), float(1 + i % 3)))
    return rows, spark.createDataFrame(rows, "k string, i int, x double, z double, y double, w double").repartition(5)


def test_boosted_trees_of_all_groups_equal_growing_each_by_hand(spark, points):
    rows, df = points
    params = {"a": B.TreeParams(trees=12, depth=3), "b": B.TreeParams(trees=3, depth=2, step=0.5, ridge=1.0, min_rows=20), None: B.TreeParams(trees=4, depth=3, loss="absolute")}
    forest = B.fit_forest(df, ["k"], ["x", "z"], "y", lambda keys: params[keys["k"]], "w")
    got = {r.i: r.p for r in forest.predict(df, "p").collect()}
    for k, p in params.items():
        mine = [r for r in rows if r[0] == k]
        x = np.array([[r[2], np.nan if r[3] is None else r[3]] for r in mine])
        want = boosted_by_hand(x, np.array([r[4] for r in mine]), np.array([r[5] for r in mine]), p)
        assert np.allclose(want, [got[r[1]] for r in mine], atol=1e-9), k
    # The tables of nodes hold what the arrays hold; unknown groups have no prediction.
    nodes = forest.table(spark)
    assert nodes.where("feature IS NOT NULL").count() == int((forest.feature >= 0).sum())
    assert nodes.groupBy("_m", "tree").agg(F.count_if(F.col("feature").isNull()).alias("leaves"), F.count_if(F.col("feature").isNotNull()).alias("splits")).where("leaves <> splits + 1").isEmpty()
    other = spark.createDataFrame([("new", 1.0, 1.0), ("a", None, None)], "k string, x double, z double")
    assert [r.p is None for r in forest.predict(other, "p").collect()] == [True, False]
    assert forest.importance(spark).where("gain > 0").select("feature").distinct().count() == 2


def test_models_in_blocks_and_forests_do_not_depend_on_partitions(spark, points, monkeypatch):
    _, df = points
    params = B.TreeParams(trees=4, depth=3, average=True)
    first = B.fit_forest(df, ["k"], ["x", "z"], "y", params, row_id="i")
    monkeypatch.setattr(B, "STATE_BYTES", 1)
    again = B.fit_forest(df.repartition(2), ["k"], ["x", "z"], "y", params, row_id="i")
    assert np.array_equal(first.feature, again.feature) and np.allclose(first.value, again.value)
    got = again.predict(df, "p").select("i", "p").toPandas().set_index("i")["p"].sort_index()
    monkeypatch.undo()
    assert np.allclose(got, first.predict(df, "p").select("i", "p").toPandas().set_index("i")["p"].sort_index())
    draws = B.poisson(np.arange(20_000) * 7919, np.full(20_000, 42), 3)
    assert abs(draws.mean() - 1) < 0.03 and abs(draws.var() - 1) < 0.05


def test_no_rows_no_models(spark, points):
    _, df = points
    forest = B.fit_forest(df.limit(0), ["k"], ["x", "z"], "y")
    assert forest.n_models == 0 and forest.predict(df, "p").where("p IS NOT NULL").isEmpty()


def test_scoped_steps_equal_fitting_each_scope_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(["s", "t", None][i % 3], f"f{rng.integers(0, 3)}", f"m{rng.integers(0, 4) if i % 50 else 9}", float(rng.normal() * 10) if rng.random() > 0.4 * (i % 3 > 0) else None, i) for i in range(900)]
    df = spark.createDataFrame(rows, "s string, fundo string, formato string, v double, row_id int")
    steps = [
        lambda scope: RareCategoryGrouper(min_count=None, scope=scope),
        lambda scope: MedianImputer(["v"], 0.3, scope=scope),
        lambda scope: GroupMedianImputer(["v"], 0.3, scope=scope),
        lambda scope: OutlierCapper(["v"], group=["fundo", "formato"], scope=scope),
        lambda scope: OutlierCapper(["v"], "percentile", group=[], scope=scope),
        lambda scope: FrequencyEncoder(["fundo", "formato"], scope=scope),
    ]
    for build in steps:
        together = build(["s"]).fit(df).transform(df).toPandas().set_index("row_id").sort_index()
        alone = pd.concat([build([]).fit(p).transform(p).toPandas() for p in [df.where(F.col("s").eqNullSafe(F.lit(s))) for s in ("s", "t", None)]]).set_index("row_id").sort_index()
        pd.testing.assert_frame_equal(together[sorted(alone.columns)], alone[sorted(alone.columns)], check_dtype=False)


@pytest.fixture(scope="module")
def harvest(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(900):
        v, x = ["POP", "BIANCA", "STELLA"][i % 3], float(rng.normal())
        rows.append((f"{i:05d}", v, f"c{i % 2}", f"k{i % 3 if v == 'POP' else 0}", x if i % 11 else None, float(i % 7), float(20 + 6 * x + (i % 7) + 10 * (v == "POP") + rng.normal())))
    return spark.createDataFrame(rows, "row_id string, variedad string, fundo string, formato string, kg_ha double, dpc double, kg_jr_h double")


def test_every_row_is_predicted_once_by_a_model_of_other_folds(spark, harvest):
    candidates = {"gbt": (B.TreeParams(3, 2, 0.7), B.TreeParams(4, 3, 0.7)), "forest": (B.TreeParams(3, 4, average=True),)}
    features = ["kg_ha", "dpc", "fundo_freq", "formato_freq"]
    results, oof = V.cross_validate(harvest, features, candidates=candidates, outer=2, inner=2, preprocessor=lambda s: V.scoped_chain(s, ["kg_ha", "dpc"], rare_min=5))
    got = oof.toPandas()
    assert len(got) == 2 * 900 and not got.duplicated(["row_id", "model_type"]).any() and got["y_pred"].notna().all()
    table = results.toPandas()
    assert len(table) == 6 and (table["baseline_skill"] > 0.3).all() and (table["n"] == 300).all()
    # Changing a row's target changes no prediction of its own fold's models for it.
    fold = got[got["row_id"] == "00007"]["fold_id"].iloc[0]
    moved = harvest.withColumn("kg_jr_h", F.when(F.col("row_id") == "00007", F.lit(500.0)).otherwise(F.col("kg_jr_h")))
    _, other = V.cross_validate(moved, features, candidates=candidates, outer=2, inner=2, preprocessor=lambda s: V.scoped_chain(s, ["kg_ha", "dpc"], rare_min=5))
    both = got.merge(other.toPandas(), on=["row_id", "model_type"])
    same = both[(both["variedad_x"] != "BIANCA") | (both["fold_id_x"] == fold)]
    assert np.allclose(same["y_pred_x"], same["y_pred_y"]) and not np.allclose(both["y_pred_x"], both["y_pred_y"])


def test_final_models_are_searched_on_all_rows(spark, harvest):
    space = V.Space({"depth": ("int", 1, 4), "step": ("log", 0.05, 0.5), "ridge": ("float", 0.0, 1.0)}, given={"trees": 3}, when={"ridge": ("loss", "squared")})
    drawn = space.draw(4)
    assert drawn == space.draw(6)[:4] and drawn != space.draw(4, seed=1) and all(1 <= p.depth <= 4 and 0.05 <= p.step <= 0.5 for p in drawn)
    plain = V.Space({"ridge": ("float", 0.5, 1.0)}, given={"loss": "absolute"}, when={"ridge": ("loss", "squared")})
    assert plain.draw(1)[0].ridge == 0.0
    models = V.fit_varieties(harvest, ["kg_ha", "dpc"], candidates={"gbt": drawn}, inner=2, halving=((0.5, 0.5), (1.0, 1.0)))
    best = models.best.toPandas()
    assert len(best) == 3 and (best["rung"] == 1).all()
    scores = V.search(harvest, ["variedad"], ["kg_ha", "dpc"], {"gbt": drawn}, 2).toPandas()
    assert len(scores) == 12 and (scores[scores["rank"] == 1].set_index("variedad")["score"] == scores.groupby("variedad")["score"].min()).all()
    out = models.predict(harvest.withColumn("variedad", F.when(F.col("row_id") == "00000", "NEW").otherwise(F.col("variedad"))))
    assert out.where("y_pred IS NULL").count() == 1 and out.count() == 900 and out.columns == [*harvest.columns, "model_type", "y_pred"]


@pytest.mark.parametrize("hot", [1_000_000, 700])
def test_resampled_distances_equal_brute_force_on_exact_values(spark, hot):
    rng = np.random.default_rng(12)
    rows = [(f"{i:05d}", ["A", "B", "v1", "v2"][i % 4], float(rng.normal() + i % 4), float(rng.integers(0, 50)) if i % 5 else None) for i in range(8000)]
    df = spark.createDataFrame(rows, "row_id string, variedad string, p double, q double")
    spark.conf.set(HOT_ROWS_KEY, str(hot))
    try:
        got = bootstrap_distances(df, ["p", "q"], ["A", "B"], replicates=6).toPandas().set_index(["variedad", "_rep", "anchor"])["_w1"]
    finally:
        spark.conf.unset(HOT_ROWS_KEY)
    hashed = df.select("*", hash_bucket(F.col("row_id"), 42).alias("hx"), hash_bucket(F.col("row_id"), 43).alias("hy")).toPandas()
    weights = replicate_weights(hashed["hx"].to_numpy(), hashed["hy"].to_numpy(), 6)
    assert hashed["p"].nunique() > 1024 and len(got) == 2 * 6 * 2
    for v in ("v1", "v2"):
        for r in range(6):
            for a in ("A", "B"):
                total = []
                for c in ("p", "q"):
                    ok = hashed[c].notna()
                    mine, theirs = ok & (hashed["variedad"] == v), ok & (hashed["variedad"] == a)
                    axis = np.sort(hashed.loc[mine | theirs, c].unique())
                    cdf = [np.array([w[x <= t].sum() for t in axis]) / w.sum() for x, w in ((hashed.loc[mine, c].to_numpy(), weights[mine.to_numpy(), r]), (hashed.loc[theirs, c].to_numpy(), np.ones(theirs.sum())))]
                    total.append((np.abs(cdf[0] - cdf[1])[:-1] * np.diff(axis)).sum())
                assert got[(v, r + 1, a)] == pytest.approx(np.mean(total), rel=1e-9)


def test_resampling_writes_no_vector_of_replicates_for_each_row(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"{i:05d}", ["A", "B", "v1", "v2"][i % 4], float(rng.normal())) for i in range(6000)]
    monkeypatch.setattr("furrow.session.shared_root", lambda _: str(tmp_path))
    assert bootstrap_distances(spark.createDataFrame(rows, "row_id string, variedad string, p double"), ["p"], ["A", "B"]).count() == 2 * 100 * 2
    tables = [sum(x.stat().st_size for x in f.glob("*.parquet")) for f in tmp_path.glob("furrow/*/*")]
    assert tables and max(tables) < 6000 * 30


def test_sliding_medians_equal_sorting_each_band(spark):
    from furrow.operators import lags as L

    rng = np.random.default_rng(2)
    rows = [(["a", "b", None][int(rng.integers(0, 3))], f"2020-01-01", int(rng.integers(0, 900)), [None, float(rng.integers(0, 9)), float(rng.normal())][int(rng.choice(3, p=[0.002, 0.5, 0.498]))], i) for i in range(4000)]
    df = spark.createDataFrame(rows, "fundo string, base string, d int, v double, i int").withColumn("fecha", F.expr("date_add(to_date(base), d)"))
    df = df.withColumn("fecha", F.when(F.col("i") > 10, F.col("fecha"))).drop("base")
    got = L.seasonal_median(df, ["fundo"], {"s": ("v", 365), "t": ("v", 40)}, tol=10).toPandas()
    assert len(got) == 4000
    table = got[got["fecha"].notna()]
    for name, period in (("s", 365), ("t", 40)):
        for k, part in [("a", table[table["fundo"] == "a"]), ("n", table[table["fundo"].isna()])]:
            for row in part.iloc[:: 37].itertuples():
                band = part[(part["d"] >= row.d - period - 10) & (part["d"] <= row.d - period + 10)]["v"]
                want = band.median() if len(band) >= 3 and band.notna().all() else np.nan
                assert getattr(row, name) == pytest.approx(want, nan_ok=True), (k, name, row)
    assert got[got["fecha"].isna()][["s", "t"]].isna().all().all()


def test_a_window_costs_what_enters_and_leaves_it():
    import time

    from furrow.operators.lags import slide_medians

    rng = np.random.default_rng(3)

    def took(n):
        day = np.concatenate([np.sort(rng.integers(0, 2500, n)), np.arange(2500)])
        start = time.perf_counter()
        slide_medians(day, np.append(rng.normal(size=n), np.full(2500, np.nan)), np.append(np.ones(n, np.int64), np.zeros(2500, np.int64)), 15)
        return time.perf_counter() - start

    took(10_000)
    assert took(800_000) < 16 * max(took(100_000), 0.05)


def test_small_models_grow_in_their_own_task(spark, points, monkeypatch):
    """The number of jobs does not depend on the trees, and passes over large models give the same trees."""
    _, df = points
    uneven = df.where("k IS NOT NULL OR i < 60")  # two models of 134 and 133 rows, one of 20

    def jobs(trees):
        spark.sparkContext.setJobGroup(f"grow-{trees}", "")
        forest = B.fit_forest(uneven, ["k"], ["x", "z"], "y", B.TreeParams(trees=trees, depth=3, loss="absolute"), "w")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return forest, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"grow-{trees}"))

    jobs(1)
    (_, many), (forest, few) = jobs(6), jobs(2)
    assert many == few
    for limit in (0, 100 * (B.ROW_BYTES + 2)):  # all in passes, the two large ones in passes
        monkeypatch.setattr(B, "MODEL_BYTES", limit)
        passes, _ = jobs(2)
        assert (passes.feature == forest.feature).all() and (passes.threshold == forest.threshold).all()
        assert np.allclose(passes.value, forest.value) and np.allclose(passes.gain, forest.gain)
