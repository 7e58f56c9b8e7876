"""Hand-computed frames for the edge rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from furrow.functions import scalar as SC
from furrow.functions.stats import binomial_tail, chi2_tail, ks_tail, normal_two_sided
from furrow.operators import champion as C
from furrow.operators import cleaning as CL
from furrow.operators import evaluation as E
from furrow.operators import folds as FO
from furrow.operators import imputing as I
from furrow.operators import lags as L
from furrow.operators import tracking as T
from furrow.operators.groups import quantiles
from furrow.session import HOT_ROWS_KEY
from furrow.sources import store as ST
from furrow.sources.harvest import variety_config, with_variety_config

DAY = dt.date(2024, 1, 1)


def records(spark, values, days=None, farm="A9", fmt="GRANEL"):
    days = days or list(range(len(values)))
    rows = [(f"{i:04d}", farm, fmt, DAY + dt.timedelta(d), v, None if v is None else v * 2.0) for i, (v, d) in enumerate(zip(values, days))]
    return spark.createDataFrame(rows, "row_id string, fundo string, formato string, fecha date, kg_ha double, kg_jr_h double")


def by_row(df, col):
    return [r[col] for r in df.orderBy("row_id").collect()]


def test_rolling_needs_three_values_and_counts_null_rows(spark):
    df = records(spark, [1.0, 2.0, None, 3.0, 9.0, 5.0])
    out = by_row(L.rolling_median(df, ["fundo"], "kg_ha", 3, "m"), "m")
    assert out == [None, None, None, None, None, None]
    out = by_row(L.rolling_median(df, ["fundo"], "kg_ha", 4, "m"), "m")
    assert out == [None, None, None, None, 2.0, 3.0]


def test_exante_leaves_out_the_whole_day(spark):
    df = records(spark, [1.0, 2.0, 3.0, 100.0, 4.0], [0, 1, 2, 3, 3])
    now = by_row(L.rolling_median(df, ["fundo"], "kg_ha", 7, "m"), "m")
    ahead = by_row(L.rolling_medians_exante(df, ["fundo"], {"m": ("kg_ha", 7)}), "m")
    assert now[4] == 2.5 and ahead[3] == ahead[4] == 2.0


def test_exante_features_ignore_their_own_day(spark):
    flags = L.LagFlags(exante=True)
    base = records(spark, [float(i % 7 + 1) for i in range(40)], [i // 2 for i in range(40)])
    changed = base.withColumn("kg_ha", F.when(F.col("fecha") >= DAY + dt.timedelta(15), F.col("kg_ha") * 10).otherwise(F.col("kg_ha"))).withColumn(
        "kg_jr_h", F.when(F.col("fecha") >= DAY + dt.timedelta(15), F.lit(999.0)).otherwise(F.col("kg_jr_h"))
    )
    cols = [c for c in L.lag_columns(flags) if "_lag_" in c or "_std_" in c or "_slope_" in c]
    cut_day = DAY + dt.timedelta(15)
    a = L.lag_features(base, flags).where(F.col("fecha") <= cut_day).orderBy("row_id").select(*cols).collect()
    b = L.lag_features(changed, flags).where(F.col("fecha") <= cut_day).orderBy("row_id").select(*cols).collect()
    assert a == b


def test_cold_start_values(spark):
    out = L.lag_features(records(spark, [1.0, 2.0])).orderBy("row_id").collect()
    assert out[0]["kg_ha_lag_FF_7"] == -1.0 and out[1]["kg_ha_slope_FF_30"] == -99999.0
    assert len(L.lag_columns()) == 35


def test_seasonal_band_is_closed_and_null_spoils_it(spark):
    days = [0, 15, 30, 380, 381]
    df = records(spark, [1.0, 2.0, 3.0, 50.0, 60.0], days)
    assert by_row(L.seasonal_median(df, ["fundo"], {"s": ("kg_ha", 365)}), "s")[3:] == [2.0, None]
    holed = df.withColumn("kg_ha", F.when(F.col("row_id") != "0001", F.col("kg_ha")))
    for hot in (False, True):
        assert by_row(L.seasonal_median(holed, ["fundo"], {"s": ("kg_ha", 365)}, hot=hot), "s")[3] is None


def test_safe_ratio_and_week(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, -2.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(SC.safe_ratio(F.col("a"), F.col("b"))).collect()] == [None, None, 0.5]
    week = spark.createDataFrame([(dt.date(2026, 4, 10),)], "d date").select(SC.iso_week(F.col("d"))).first()[0]
    assert week == "2026-W15"


def test_cap_group_needs_thirty_rows(spark):
    small = records(spark, [float(i) for i in range(28)] + [1000.0], farm="C5")
    big = records(spark, [float(i) for i in range(29)] + [1000.0], farm="LN").withColumn("row_id", F.concat(F.lit("b"), "row_id"))
    both = small.unionByName(big)
    model = I.OutlierCapper(["kg_ha"], group=["fundo"], least=30).fit(both)
    top = {r["fundo"]: r["m"] for r in model.transform(both).groupBy("fundo").agg(F.max("kg_ha").alias("m")).collect()}
    whole = I.OutlierCapper(["kg_ha"]).fit(both).transform(both).agg(F.max("kg_ha")).first()[0]
    assert top["C5"] == pytest.approx(whole) and top["LN"] != pytest.approx(whole)


def test_rare_threshold_is_inclusive_and_unseen_goes_to_other(spark):
    df = spark.createDataFrame([("A",)] * 15 + [("B",)] * 14 + [(None,)], "formato string")
    model = I.RareCategoryGrouper(min_count=15).fit(df)
    new = spark.createDataFrame([("A",), ("B",), ("Z",), (None,)], "formato string")
    assert [r[0] for r in model.transform(new).collect()].count("OTROS") == 3
    assert I.rare_threshold(100) == 15 and I.rare_threshold(1000) == 30 and I.rare_threshold(10_000) == 50


def test_folds_partition_rows_and_weights_average_one(spark):
    df = records(spark, [float(i % 50 + 1) for i in range(503)])
    sizes = [r["count"] for r in FO.kfold(df, 5).groupBy("fold_id").count().collect()]
    assert sum(sizes) == 503 and max(sizes) - min(sizes) <= 1
    for out, name in ((FO.density_weights(df), "w_density"), (FO.inverse_target_weights(df), "w_inverse"), (FO.season_boost(df, [1, 2]), "w_season")):
        assert out.agg(F.avg(name)).first()[0] == pytest.approx(1.0)


def test_year_split_tests_the_last_years(spark):
    df = spark.createDataFrame([(dt.date(y, 5, 1),) for y in range(2022, 2027)], "fecha date")
    out = FO.temporal_year_split(df, 3, 2)
    assert sorted(r[0] for r in out.select("test_year").distinct().collect()) == [2024, 2025, 2026]
    assert FO.temporal_year_split(df.where("fecha < DATE'2024-01-01'"), 3, 2).count() == 0


def test_short_conformal_interval_is_zero(spark):
    for n, zero in ((19, True), (20, False)):
        df = spark.createDataFrame([(f"{i:03d}", float(i), 0.0) for i in range(n)], "row_id string, y_true double, y_pred double")
        width = E.conformal_interval(df).first()["half_width"]
        assert (width == 0.0) is zero


def test_mape_ignores_small_targets(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 9.0)], "y_true double, y_pred double")
    row = E.regression_metrics(df).first()
    assert row["mape"] == pytest.approx(10.0) and row["mape_n_excluded"] == 1


def test_tracking_fixture(spark):
    d = dt.date(2026, 1, 10)
    f = spark.createDataFrame([(1, "C5", "GRANEL", d, 1, 6.0, 5000.0), (2, "C5", "GRANEL", d, 2, 7.0, 5000.0)], "id int, fundo string, formato string, fecha date, created_at int, kghora_pred double, kg_ha double")
    a = spark.createDataFrame([(9, "C5", "GRANEL", d, 8.0, 5100.0)], "id int, fundo string, formato string, fecha date, kg_jr_h double, kg_ha double")
    p = T.coalesce_actual_inputs(T.accuracy_points(f, a))
    row = T.error_decomposition(p.withColumn("pred_on_real", F.lit(7.8))).first()
    assert row["error_total"] == -1.0 and row["kg_ha"] == 5100.0
    assert row["error_model"] == pytest.approx(-0.2) and row["error_data"] == pytest.approx(-0.8)


def test_champion_tie_goes_to_the_fastest_and_all_failing_still_choose(spark):
    cols = "variety string, model_type string, oof_mape double, mae_test double, mae_train double, gap double, elapsed_seconds double"
    tie = [("P", "a", 10.0, 1.0, 0.9, 0.1, 50.0), ("P", "b", 10.4, 1.0, 0.9, 0.1, 20.0), ("P", "c", 10.6, 1.0, 0.9, 0.1, 1.0)]
    fail = [("Q", "a", 12.0, 1.0, 0.1, 0.9, 5.0), ("Q", "b", 20.0, 1.0, 0.1, 0.9, 1.0)]
    got = {r["variety"]: r["model_type"] for r in C.select_champion(spark.createDataFrame(tie + fail, cols)).collect()}
    assert got == {"P": "b", "Q": "a"}


def test_oversize_batch_is_one_blocking_issue(spark):
    row = ("POP", "2026-01-10", 5000.0, 120.0, 10.0, 30, "GRANEL", "C5")
    cols = "variedad string, fecha string, kg_ha double, dpc double, ha double, dia_cosecha int, formato string, fundo string"
    df = spark.createDataFrame([row] * 1001, cols).withColumn("row_id", F.monotonically_increasing_id())
    issues = CL.validate_batch(df, max_rows=CL.MAX_BATCH_ROWS).collect()
    assert len(issues) == 1 and issues[0]["column"] == "variedad" and "exceed" in issues[0]["reason"]
    assert CL.validate_batch(df.limit(1000), max_rows=CL.MAX_BATCH_ROWS).count() == 0


def test_empty_replace_is_refused(spark, tmp_path):
    bad = records(spark, [0.0, -1.0])
    with pytest.raises(ValueError):
        ST.import_history(bad, str(tmp_path / "h"), "POP", replace=True)
    got = ST.import_history(records(spark, [1.0, 0.0]), str(tmp_path / "h"), "POP")
    assert got == {"inserted": 1, "skipped": 1}


def test_variety_settings(spark):
    df = spark.createDataFrame([("POP",), ("OTRA",)], "variedad string")
    rows = {r["variedad"]: r for r in with_variety_config(df, {"POP": {"rare_min_count": 9}}).collect()}
    assert rows["POP"]["rare_min_count"] == 9 and rows["OTRA"]["rare_min_count"] == 50
    with pytest.raises(ValueError):
        variety_config(spark, {"POP": {"nope": 1}})


def test_quantiles_of_a_hot_group_are_exact(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"k{i % 5}", float((i * 37) % 101), float(i % 4)) for i in range(900)], "k string, x double, y double")
    spec = {"a": ("x", 0.25), "b": ("x", 0.995), "c": ("y", 0.5)}
    plain = sorted(map(tuple, quantiles(df, ["k"], spec, hot=False).collect()))
    split = sorted(map(tuple, quantiles(df, ["k"], spec, hot=True).collect()))
    assert [r[0] for r in plain] == [r[0] for r in split]
    for p, s in zip(plain, split):
        assert p[1:] == pytest.approx(s[1:])


def test_group_limit_chooses_the_form(spark):
    from furrow.operators.groups import is_hot

    df = records(spark, [1.0] * 20)
    assert not is_hot(df, ["fundo"])
    spark.conf.set(HOT_ROWS_KEY, "10")
    try:
        assert is_hot(df, ["fundo"])
    finally:
        spark.conf.unset(HOT_ROWS_KEY)


def test_p_values(spark):
    df = spark.createDataFrame([(3.841458820694124, 1.0), (18.307038053275146, 10.0)], "x double, k double")
    assert [r[0] for r in df.select(chi2_tail("x", "k")).collect()] == pytest.approx([0.05, 0.05], abs=1e-9)
    one = spark.range(1)
    assert one.select(normal_two_sided(F.lit(1.959963984540054))).first()[0] == pytest.approx(0.05)
    assert one.select(ks_tail(F.lit(0.1358), F.lit(200.0), F.lit(200.0))).first()[0] == pytest.approx(0.05, abs=2e-3)
    assert one.select(binomial_tail(F.lit(2.0), F.lit(3.0), F.lit(0.5))).first()[0] == pytest.approx(0.5)
