"""Registered queries against their SQL on the smallest tables, plain and split forms."""

import duckdb
import pytest

import __spark_entry__ as entry
from furrow.session import HOT_ROWS_KEY
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
PLAIN = """rolling_median_30 rolling_median_exante seasonal_median rolling_slope lag_transform asof_prior_day seasonal_range_join
import_history delete_forecasts split_by_variety validate_batch quality_metrics with_variety_config
rare_category_grouper group_median_imputer cap_group_cascade count_outliers derive_season_months skew_profile one_hot log_target
stratify_label temporal_year_split purged_date_split density_weights regression_metrics business_validation subgroup_errors
calibration_bins conformal_bands apply_bands kpi_table hierarchical_median_baseline
select_champion rank_models quality_gate promotion_gate accuracy_points error_decomposition weekly_report
profile_numeric cramers_v correlation_spearman acf_pacf kpss mann_whitney kruskal_wallis holm year_drift row_drift psi_categorical
assign_to_anchor mann_whitney_holm routing_decisions stream_validate stream_weekly stream_match flagship""".split()
SPLIT = """rolling_median_30 seasonal_median rolling_slope relative_to_global centered_moving_average kfold temporal_tail_holdout
conformal_bands cap_group_cascade correlation_spearman seasonal_strength kpss ks_two_sample psi""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    c.execute("SET TimeZone='UTC'")
    return c


def compare(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    want, want_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got_cols == want_cols
    assert got == want


@pytest.mark.parametrize("name", PLAIN)
def test_query_matches_sql(spark, con, name):
    compare(spark, con, name)


@pytest.mark.parametrize("name", SPLIT)
def test_split_form_matches_sql(spark, con, name):
    """A group limit of 50 rows sends every group through the forms for huge groups."""
    spark.conf.set(HOT_ROWS_KEY, "50")
    try:
        compare(spark, con, name)
    finally:
        spark.conf.unset(HOT_ROWS_KEY)


def test_registry_is_consistent():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len(queries) > 200
