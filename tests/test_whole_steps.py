"""Queries and operators run every step of their method."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.catalog import load_all
from furrow.operators import profiling as P

SF = "/root/testdata/sf0.001"


def test_acf_pacf_has_twenty_lags(spark):
    out = load_all()[0]["acf_pacf"](spark, SF)
    lags = out.groupBy("formato").agg(F.sort_array(F.collect_list("lag")).alias("l")).collect()
    assert lags and all(r["l"] == list(range(1, 21)) for r in lags)


def test_pacf_solves_the_yule_walker_equations(spark):
    x = np.random.default_rng(3).normal(size=200).cumsum() % 7
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    got = P.acf_pacf(df, "x", [F.col("i")], 20).orderBy("lag").collect()
    rho = [1.0, *[r["acf"] for r in got]]
    for k in (1, 2, 7, 20):
        m = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        assert got[k - 1]["pacf"] == pytest.approx(np.linalg.solve(m, rho[1 : k + 1])[-1])


def test_profile_of_many_levels_keeps_its_association_and_top_levels(spark):
    rows = [(f"{i % 250:03d}", float(i % 250 + i % 2)) for i in range(1000)] + [(None, 5.0)] * 6 + [("top", None)] * 9
    got = P.profile_categorical(spark.createDataFrame(rows, "farm string, y double"), "farm", "y").first()
    assert (got["cardinality"], got["n"], got["n_missing"]) == (252, 1015, 6) and got["miss_ratio"] == pytest.approx(6 / 1015)
    assert got["dof"] == 250 and got["cramers_v"] > 0.8 and got["chi2_p"] < 1e-6 and got["advice"] == "alta_cardinalidad"
    top = got["top_categories"]
    assert [(t["value"], t["count"]) for t in top[:3]] == [("top", 9), ("nan", 6), ("000", 4)] and len(top) == 10
    assert top[0]["target_mean"] is None and top[1]["target_mean"] == 5.0 and top[1]["cum_pct"] == pytest.approx(15 / 1015)
    assert top[2]["target_count"] == 4 and top[2]["target_mean"] is None


@pytest.mark.parametrize("name", ["nested_cv", "pick_final_params"])
def test_nested_queries_search_every_candidate_in_every_fold(spark, monkeypatch, name):
    """Five outer and three inner folds of all candidates with all trees; models are replaced by cheap ones."""
    import threading

    from furrow.plans import training as T

    fits, lock, real = [], threading.Lock(), T.train

    def cheap(df, features, backend="gbt", params=None, *rest, **kw):
        with lock:
            fits.append((backend, dict(params)))
        return real(df, features, "forest", {"numTrees": 1, "maxDepth": params["maxDepth"]}, *rest, **kw)

    monkeypatch.setattr(T, "train", cheap)
    out = load_all()[0][name](spark, SF).collect()
    backend = "gbt" if name == "nested_cv" else "forest"
    grid = [dict(p) for p in T.BACKENDS[backend].grid]
    # No parameter makes a fit smaller than the backend's own defaults, and each candidate meets 15 inner folds.
    assert len(grid) > 1 and len(fits) == 5 * (3 * len(grid) + 1) and {b for b, _ in fits} == {backend}
    assert all(sum(p == g for _, p in fits) >= 15 for g in grid)
    assert len(out) == (5 if name == "nested_cv" else 1)


def test_dummies_of_many_levels_are_one_vector(spark, monkeypatch, tmp_path):
    """The vector has an entry for each column there would be, is saved with its chain, and trains a model."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    from furrow.operators import features as FE
    from furrow.plans import training as T

    farm = F.when(F.col("id") % 11 != 7, F.format_string("f%03d", F.col("id") % 13))
    df = spark.range(600).select(
        F.format_string("r%03d", "id").alias("row_id"), farm.alias("fundo"), F.when(F.col("id") % 5 > 0, "A").otherwise("B").alias("formato"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("fecha"), (F.col("id") % 7 + 1).cast("double").alias("kg_ha"), (F.col("id") % 13 * 10.0).alias("kg_jr_h"),
    )
    train, new = df.where("fundo <> 'f003' OR fundo IS NULL"), df
    dense = FE.FeatureGenerator().fit(train).transform(new)
    assert "fundo__f001" in dense.columns
    monkeypatch.setattr(FE, "DENSE_LEVELS", 5)
    model = FE.FeatureGenerator().fit(train)
    PipelineModel([model]).write().save(str(tmp_path / "m"))
    for m in (model, PipelineModel.load(str(tmp_path / "m"))):
        out = m.transform(new)
        assert "formato__A" in out.columns and not any(c.startswith("fundo__f") for c in out.columns)
        for col, prefix in (("fundo__levels", "fundo__"), ("fundo_formato__levels", "fundo_formato__")):
            names = sorted(c for c in dense.columns if c.startswith(prefix))
            want = {r["row_id"]: [r[n] for n in names] for r in dense.select("row_id", *names).collect()}
            got = {r["row_id"]: [int(v) for v in r["v"]] for r in out.select("row_id", vector_to_array(col).alias("v")).collect()}
            assert len(names) > 5 and got == want
    fitted = T.train(model.transform(train), None, "forest", {"numTrees": 3, "maxDepth": 3})
    assert "fundo__levels" in fitted.features and any(n.startswith("fundo__levels[") and v > 0 for n, v in T.importances(fitted))
    assert fitted.predict(model.transform(new)).where("y_pred IS NULL").isEmpty()
