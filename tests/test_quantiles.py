"""Exact quantiles of huge groups without sorting, holding or shuffling their values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import groups as G
from furrow.operators import imputing as I
from furrow.operators import ordered
from furrow.session import HOT_ROWS_KEY


@pytest.fixture
def rows(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 7 != 2, (F.col("id") % 7).cast("string")).alias("k"),
        F.when(F.col("id") % 5 != 0, F.hash("id") % 100 / 7).alias("x"),
        F.when((F.col("id") % 7 != 3) | (F.col("id") < 50), F.hash("id").cast("double")).alias("y"),
    )
    return df.unionByName(spark.createDataFrame([("few", 1.0, None), ("few", 4.0, None), ("none", None, None)], df.schema))


@pytest.fixture
def unsorted(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("all values of a group are sorted")

    spark.conf.set(HOT_ROWS_KEY, "200")
    monkeypatch.setattr(ordered, "sliced", refuse)
    yield
    spark.conf.unset(HOT_ROWS_KEY)


SPEC = {"a": ("x", 0.5), "b": ("x", 0.01), "c": ("y", 0.9), "d": ("y", 0.0), "e": ("y", 1.0), "again": ("x", 0.5)}


@pytest.mark.parametrize("keys", [["k"], []])
def test_brackets_give_the_exact_quantiles(rows, unsorted, keys):
    assert G.is_hot(rows, keys)
    plain = {r[0] if keys else None: r for r in G.quantiles(rows, keys, SPEC, hot=False).collect()}
    found = {r[0] if keys else None: r for r in G.quantiles(rows, keys, SPEC).collect()}
    assert len(plain) == (9 if keys else 1) and set(found) == set(plain)
    for k, want in plain.items():
        for name in SPEC:
            assert found[k][name] == (want[name] if want[name] is None else pytest.approx(want[name], rel=1e-12))


def test_outliers_of_huge_groups(spark, rows, unsorted):
    df = rows.withColumn("x", F.when(F.col("x") > 14, F.col("x") * 9).otherwise(F.col("x")))
    found = sorted(I.count_outliers(df, ["x", "y"], ["k"]).collect(), key=str)
    spark.conf.set(HOT_ROWS_KEY, "1000000")
    assert found == sorted(I.count_outliers(df, ["x", "y"], ["k"]).collect(), key=str) and found[0]["n_iqr"] > 0


def test_a_missed_bracket_falls_back(rows, monkeypatch):
    monkeypatch.setattr(G, "_bracketed_quantiles", lambda *_: None)
    assert G.quantiles(rows, [], {"q": ("x", 0.25)}, hot=True).first()["q"] == pytest.approx(G.quantiles(rows, [], {"q": ("x", 0.25)}, hot=False).first()["q"])


def test_pairs_copy_no_counts(spark, monkeypatch):
    """Statistics of all pairs come from one axis a feature: no count is copied for a pair."""
    from furrow.operators import routing as RO

    rows = spark.range(3000).select(
        F.when(F.col("id") % 9 != 2, F.concat(F.lit("v"), (F.col("id") % 9).cast("string"))).alias("variedad"),
        (F.hash("id") % 40).cast("double").alias("u"),
        F.when(F.col("id") % 11 == 0, float("nan")).when(F.col("id") % 13 != 0, F.hash(F.col("id") * 3) / 1e7).alias("v"),
    )
    sizes = []
    whole = RO.sliced

    def counted(df, *more):
        sizes.append(df.count())
        return whole(df, *more)

    monkeypatch.setattr(RO, "sliced", counted)
    anchors = ["v0", "v1", "absent"]
    sums = RO.pair_sums(rows, ["u", "v"], anchors)
    data = rows.where("variedad IS NOT NULL").toPandas()
    distinct = sum(data[[f, "variedad"]].dropna().drop_duplicates().shape[0] for f in ("u", "v"))
    assert sizes == [distinct]
    found = {(r["variedad"], r["anchor"], r["variable"]): r for r in RO.mann_whitney_pairs(rows, ["u", "v"], anchors, sums=sums).collect()}
    w1 = {(r["variedad"], r["anchor"], r["variable"]): r["w1"] for r in sums.collect()}
    assert len(found) == 6 * 3 * 2
    for (own, anchor, f), r in found.items():
        a, b = (data.loc[data.variedad == n, f].dropna().to_numpy() for n in (own, anchor))
        assert (r["n_a"], r["n_b"]) == (len(a), len(b))
        if not len(b):
            assert r["delta"] is None and r["p"] is None
            continue
        assert r["u"] == ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum())
        axis = np.unique(np.concatenate([a, b]))
        gap = np.abs(np.searchsorted(np.sort(a), axis, "right") / len(a) - np.searchsorted(np.sort(b), axis, "right") / len(b))
        assert w1[own, anchor, f] == pytest.approx((gap[:-1] * np.diff(axis)).sum())


def test_rows_are_not_dealt_out_by_a_small_state(spark):
    """Three huge groups would be three tasks: rows meet the states of their groups where they lie."""
    from furrow.operators import evaluation as E
    from furrow.operators import hypothesis as T

    df = spark.range(50_000).select("id", (F.col("id") % 3).cast("string").alias("formato"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    rows, fit = T.ols(df, "y", ["x"], ["formato"])
    levels = (("formato",),)
    predicted = E.predict_baseline(df, E.fit_baseline(df, "y", levels), levels=levels)
    for out in (rows, T._residual(rows, fit, "y", 1, ["formato"]), predicted):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert fit.count() == 3 and predicted.where("baseline_pred IS NULL").count() == 0
