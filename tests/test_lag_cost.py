"""Lag features: bands of many groups at once, chunks of whole days, sizes from the given rows."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow.operators import lags as L
from furrow.operators import routing as RO


def _groups(n_groups, n_days, seed=5):
    rng = np.random.default_rng(seed)
    group = np.repeat(np.arange(n_groups), 2 * n_days)
    day = np.sort(rng.integers(0, 400, (n_groups, n_days)), axis=1)
    day = np.concatenate([day, day], axis=1)
    value = np.concatenate([np.full((n_groups, n_days), np.nan), np.round(rng.normal(size=(n_groups, n_days)), 1)], axis=1)
    weight = np.concatenate([np.zeros((n_groups, n_days), np.int64), rng.integers(1, 4, (n_groups, n_days))], axis=1)
    value[:, -1] = np.nan  # a hole
    order = np.argsort(day, axis=1, kind="stable")
    return group, *(np.take_along_axis(x, order, 1).ravel() for x in (day, value, weight))


@pytest.mark.parametrize("limit", [0, 500])
def test_bands_of_many_groups_equal_sliding_each(monkeypatch, limit):
    monkeypatch.setattr(L, "SLIDE_BAND", limit)
    monkeypatch.setattr(L, "SLIDE_PAIRS", 64)
    group, day, value, weight = _groups(7, 60)
    at, days, medians, sizes = L.slide_groups(group, day, value, weight, 15)
    for g in range(7):
        here = group == g
        want = L.slide_medians(day[here], value[here], weight[here], 15)
        for got, expected in zip((days, medians, sizes), want, strict=True):
            np.testing.assert_array_equal(got[at == g], expected)


def test_many_sparse_groups_cost_little():
    rows = _groups(2000, 30)
    start = time.perf_counter()
    L.slide_groups(*rows, 15)
    assert time.perf_counter() - start < 2


@pytest.mark.parametrize("limit", ["9", "40"])
def test_lags_of_split_groups_equal_whole_ones(spark, limit):
    rng = np.random.default_rng(1)
    n = 300
    day = pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 120, n), unit="D")
    rows = pd.DataFrame({"row_id": [f"{i:04d}" for i in range(n)], "fundo": rng.choice(["a", "b", None], n), "formato": rng.choice(["x", "y"], n), "fecha": day.date, "kg_ha": rng.normal(50, 5, n), "kg_jr_h": rng.normal(9, 2, n)})
    rows["fundo"] = rows["fundo"].astype(object).where(rows["fundo"].notna(), None)
    df = spark.createDataFrame(rows, "row_id string, fundo string, formato string, fecha date, kg_ha double, kg_jr_h double")
    read = lambda: L.lag_features(df).orderBy("row_id").toPandas()
    want = read()
    spark.conf.set("spark.furrow.hotGroupRows", limit)
    try:
        got = read()
    finally:
        spark.conf.unset("spark.furrow.hotGroupRows")
    assert len(got) == n
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)


def test_growing_rows_are_not_computed_for_sizes(spark):
    """Counting sizes must not run what was added to the rows."""
    df = spark.createDataFrame([("1", "a", "x", "2020-01-01", 1.0, 2.0)], "row_id string, fundo string, formato string, fecha string, kg_ha double, kg_jr_h double").withColumn("fecha", F.to_date("fecha"))
    grown = df.withColumn("fundo", F.when(F.raise_error(F.lit("computed")).cast("string").isNull(), F.col("fundo")))
    L.rolling_medians(grown, ["fundo"], L.row_order(), {"m": ("kg_ha", 7)}, base=df)


def test_pair_counts_read_the_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def see(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("a", 1.0, 2.0), ("a", 2.0, None), ("b", 1.0, float("nan")), ("c", None, None), ("b", 3.0, 5.0)]
    df = spark.createDataFrame(rows, "variedad string, u double, v double")
    df = df.mapInArrow(see, df.schema)
    got = {(x["variedad"], x["anchor"]): x["w1"] for x in RO.pair_distances(df, ["u", "v"], ["a"]).collect()}
    assert seen.value == len(rows)
    assert set(got) == {("b", "a")} and got["b", "a"] == pytest.approx((0.5 + 3.0) / 2)


@pytest.mark.parametrize("limit", ["40", "1000000"])
def test_row_medians_cross_batches_without_an_array_a_row(spark, limit):
    rng = np.random.default_rng(3)
    n = 260
    value = np.round(rng.normal(size=n), 1)
    value[::9] = np.nan
    rows = pd.DataFrame({"row_id": [f"{i:04d}" for i in range(n)], "fundo": rng.choice(["a", "b", "b", "b"], n), "fecha": pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 90, n), unit="D"), "v": value})
    df = spark.createDataFrame(rows).selectExpr("row_id", "fundo", "cast(fecha AS date) AS fecha", "if(isnan(v), null, v) AS v")
    spec = {"m7": ("v", 7), "m30": ("v", 30)}
    spark.conf.set("spark.furrow.hotGroupRows", limit)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        out = L.rolling_medians(df, ["fundo"], L.row_order(), spec, first="fecha")
        assert "collect_list" not in out._jdf.queryExecution().toString()
        got = out.toPandas().set_index("row_id")
    finally:
        spark.conf.unset("spark.furrow.hotGroupRows")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for _, group in rows.sort_values(["fecha", "row_id"]).groupby("fundo"):
        for name, (_, k) in spec.items():
            want = group["v"].shift(1).rolling(k, min_periods=3).median()
            np.testing.assert_allclose(got.loc[group["row_id"], name].to_numpy(float), want.to_numpy(float))


def test_thin_seasonal_bands_join_nothing_and_equal_sliding_ones(spark):
    rng = np.random.default_rng(4)
    n = 500
    rows = pd.DataFrame({"row_id": [f"{i:04d}" for i in range(n)], "fundo": rng.choice(["a", "b"], n), "d": rng.integers(0, 800, n), "v": np.round(rng.normal(size=n), 1)})
    df = spark.createDataFrame(rows).selectExpr("row_id", "nullif(fundo, 'b') AS fundo", "if(d > 5, date_add(DATE'2020-01-01', cast(d AS int)), null) AS fecha", "if(row_id > '0490', null, if(row_id > '0480', double('nan'), v)) AS v")
    spec = {"year": ("v", 365), "near": ("v", 4), "again": ("v", 365)}
    thin = L.seasonal_median(df, ["fundo"], spec, tol=10)
    assert "Join" not in thin._jdf.queryExecution().optimizedPlan().toString()
    got, want = (x.orderBy("row_id").toPandas() for x in (thin, L.seasonal_median(df, ["fundo"], spec, tol=10, hot=True)))
    assert got["year"].notna().sum() > 50
    pd.testing.assert_frame_equal(got, want)


def test_flagship_computes_lags_and_baseline_once(spark, monkeypatch):
    from furrow.catalog import models as M

    written = []
    monkeypatch.setattr(M, "cut", lambda df, real=M.cut: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    out = M.flagship(spark, "/root/testdata/sf0.001")
    assert sum("Window" in plan for plan in written) == 1
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_profile_and_business_rows_are_written_once(spark, monkeypatch):
    from furrow.operators import evaluation as E
    from furrow.operators import ranks as R
    from furrow.plans import chain as CH

    rows = spark.createDataFrame([("a", float(i), float(i + 1), 2.0, "a" if i % 2 else "b", "wide") for i in range(80)], "g string, real double, p double, h double, side string, other string")
    seen = []
    for module in (E, R, CH):
        monkeypatch.setattr(module, "cut", lambda df, real=module.cut: seen.append(df.columns) or real(df))
    got = E.business_validation(rows, {"oof": "p"}, ["g"], "h", "real").collect()
    assert seen == [["g", "h", "real", "p"]] and got[0]["n"] == 80 and got[0]["n_dropped"] == 0
    seen.clear()
    got = R.ks_two_sample(rows, ["g"], "real", "side").collect()
    assert seen == [["g", "real", "side", "_w"]] and (got[0]["n_a"], got[0]["n_b"]) == (40, 40)
    assert abs(got[0]["ks"] - 1 / 40) < 1e-12
