"""Training and streaming invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from furrow.operators.evaluation import fit_baseline, predict_baseline
from furrow.operators import folds as F_
from furrow.plans import training as T
from furrow.session import cut
from furrow.streaming import streams as ST


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(1200).select(
        F.format_string("%05d", "id").alias("row_id"), (F.col("id") % 3).cast("string").alias("fundo"), (F.col("id") % 2).cast("string").alias("formato"),
        F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 1400).cast("int")).alias("fecha"), (F.col("id") % 40 + 1).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"),
    )
    return df.withColumn("kg_jr_h", F.col("x") * 3 + F.col("z")).withColumn("variedad", F.when(F.col("x") > 20, "POP").otherwise("BIANCA")).cache()


def test_boosting_beats_the_group_baseline_and_repeats(spark, rows):
    params = {"maxIter": 15, "maxDepth": 4, "stepSize": 0.3}
    first = T.score_frame(T.train_gbt(rows, ["x", "z"], params).predict(rows))
    again = T.score_frame(T.train_gbt(rows, ["x", "z"], params).predict(rows))
    base = T.score_frame(predict_baseline(rows, fit_baseline(rows), "y_pred"))
    assert first < base * 0.5 and first == pytest.approx(again)


def test_nested_cv_covers_every_row_once(spark, rows):
    got = T.nested_cv(rows, ["x", "z"], "forest", ({"maxDepth": 5},), 3, 2, base={"numTrees": 3})
    assert got.oof.count() == rows.count() == got.oof.select("row_id").distinct().count()
    assert len(got.folds) == 3 and T.pick_final_params(got)["maxDepth"] == 5


def test_failures_become_rows(spark, rows):
    T.register_backend(T.Backend("broken", lambda p: 1 / 0, ({},), "x"))
    try:
        results, oof = T.train_all_varieties(rows, ["x", "z"], ("forest", "broken"), base={"numTrees": 2})
    finally:
        del T.BACKENDS["broken"]
    got = {(r["variedad"], r["model_type"]): r["error"] for r in results.collect()}
    assert got[("POP", "forest")] is None and got[("POP", "broken")] and oof is not None


def test_late_rows_are_dropped_and_a_restart_adds_nothing(spark, tmp_path):
    schema = "k string, at timestamp, pred_original double, real double"

    def put(name, items):
        rows = [(k, dt.datetime.fromisoformat(t), 2.0, 1.0) for k, t in items]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        s = ST.file_stream(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema)
        ST.run_available(ST.stream_weekly(s, "at", ["k"], "1 day"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        return {(r["k"], str(r["week_start"])): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    put("a", [("x", "2024-01-02T00:00:00"), ("x", "2024-01-03T00:00:00"), ("x", "2024-01-20T00:00:00")])
    assert run() == {("x", "2024-01-01"): 2}
    put("b", [("x", "2024-01-04T00:00:00"), ("x", "2024-01-30T00:00:00")])
    assert run() == {("x", "2024-01-01"): 2, ("x", "2024-01-15"): 1}
    assert run() == {("x", "2024-01-01"): 2, ("x", "2024-01-15"): 1}


def test_preprocessing_is_fitted_on_each_fold_and_leaks_no_target(spark):
    from furrow.catalog.base import harvest_full
    from pyspark.ml import Pipeline

    from furrow.operators.imputing import MedianImputer, OutlierCapper
    from furrow.plans.chain import LagStep

    df = harvest_full(spark, "/root/testdata/sf0.001").select("row_id", "fundo", "formato", "fecha", "kg_ha", "indus_pct", "dpc", "p_baya", "ha", "dia_cosecha", "kg_jr_h").where("fundo < '2'").dropDuplicates(["row_id"])
    df = cut(df)
    lagged = LagStep().fit(df).transform(df.select("*"))
    one = df.orderBy("fecha", "row_id").limit(40).collect()[-1].row_id
    changed = df.withColumn("kg_jr_h", F.when(F.col("row_id") == one, 9.9e6).otherwise(F.col("kg_jr_h")))
    other = LagStep().fit(changed).transform(changed.select("*"))
    names = [c for c in lagged.columns if "_lag_" in c]
    a, b = (x.where(F.col("row_id") == one).select(*names).first() for x in (lagged, other))
    assert names and a == b
    columns = ["kg_ha", "indus_pct", "dpc"]
    chain = Pipeline(stages=[MedianImputer(columns, 0.0), OutlierCapper(columns, group=["fundo"])])
    got = T.nested_cv(df, None, "gbt", ({"maxDepth": 2},), 2, 2, base={"maxIter": 1}, preprocessor=chain)
    assert sorted(r.row_id for r in got.oof.collect()) == sorted(r.row_id for r in df.collect())


def test_rows_without_a_model_or_group_stay(spark):
    from furrow.operators.isolation import isolation_scores

    rows = [(f"r{i}", "a" if i % 3 else None, float(i % 17), float(i % 5), 10.0 + i % 7) for i in range(90)] + [("z", "other", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "row_id string, variedad string, x double, w double, kg_jr_h double")
    model = T.train(df.where("variedad = 'a'"), ["x", "w"], "gbt", {"maxIter": 1, "maxDepth": 2})
    got = T.score_batch(df, {"a": model}).collect()
    assert len(got) == 91 and sum(r.y_pred is None and r.score_reason == "no model" for r in got) == 31
    scores = isolation_scores(df, ["x", "w"], "variedad", trees=5).collect()
    assert len(scores) == 91 and all(r.iso_score is not None for r in scores)


def test_folds_of_huge_groups_write_counts_alone(spark, monkeypatch, tmp_path):
    rows = [(None if i % 500 == 7 else f"r{i}", "ab"[i % 3 == 0], float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id string, g string, x double").repartition(7)
    for by in ([], ["g"]):
        plain = {r.x: r.fold_id for r in F_.kfold(df, 5, by=by).where("row_id IS NOT NULL").collect()}
        with monkeypatch.context() as m:
            m.setattr("furrow.operators.folds.hot_rows", lambda _: 300)
            m.setattr("furrow.operators.ordered.hot_rows", lambda _: 300)
            m.setattr("furrow.session.shared_root", lambda _: str(tmp_path))
            split = F_.kfold(df, 5, by=by).collect()
        assert len(split) == 3000 and plain == {r.x: r.fold_id for r in split if r.row_id is not None}
    assert all("x" not in spark.read.parquet(str(f)).columns for f in tmp_path.glob("furrow/*/*"))


def test_a_fold_is_prepared_once_for_all_candidates(spark, monkeypatch):
    rows = [(f"r{i}", float(i % 17), float(i % 5), float(i % 17 + i % 5), "wide") for i in range(300)]
    df = spark.createDataFrame(rows, "row_id string, a double, b double, kg_jr_h double, other string")
    written = []
    monkeypatch.setattr(T, "cut", lambda d, real=T.cut: written.append(d.columns) or real(d))
    grid = [{"maxDepth": d, "maxIter": 1} for d in (1, 2, 3)]
    got = T.inner_search(df, ["a", "b"], "gbt", grid, 2)
    assert len(written) == 3 and "other" not in written[0]
    # As each candidate fitted by itself on each fold.
    folds = F_.kfold(df, 2, 7, name="_inner")
    for g in got:
        each = [T.score_frame(T.train(folds.where(f"_inner <> {f}"), ["a", "b"], "gbt", g["params"]).predict(folds.where(f"_inner = {f}"))) for f in (0, 1)]
        assert g["score"] == pytest.approx(sum(each) / 2, rel=1e-9)
