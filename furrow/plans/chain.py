"""Whole jobs: the preprocessing chain, the data profile of all varieties, the model report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.columns import DATE, FARM, FF, NUMERIC_FEATURES, ROW_ID, TARGET
from furrow.operators import drift as D
from furrow.operators import evaluation as E
from furrow.operators import hypothesis as T
from furrow.operators import profiling as P
from furrow.operators.cleaning import quality_metrics
from furrow.operators.features import ConcurrentDropper, FeatureGenerator
from furrow.operators.imputing import GroupMedianImputer, MedianImputer, MissingFlagger, OutlierCapper, RareCategoryGrouper, VarianceFilter
from furrow.operators.lags import LagFlags, LagState, fit_lags, transform_lags
from furrow.operators.neighbors import KnnImputer, LofScorer
from furrow.operators.saving import Saved
from furrow.session import cut


class LagStep(Saved, Estimator):
    """History features as a stage: fitted on training rows, served against them."""

    def __init__(self, flags: LagFlags | None = None, scope: Sequence[str] = ()):
        super().__init__()
        self.flags, self.scope = flags or LagFlags(), tuple(scope)

    def _fit(self, dataset):
        return LagModel(fit_lags(dataset, self.flags, self.scope))


class LagModel(Saved, Model):
    """Rows of the training history get their training features, other rows serving ones."""

    def __init__(self, state: LagState):
        super().__init__()
        self.state = state

    def _transform(self, dataset):
        if TARGET not in dataset.columns:
            return transform_lags(self.state, dataset)
        # The target travels under another name: nothing is joined back by row.
        out = transform_lags(self.state, dataset.withColumn("_target", F.col(TARGET)))
        added = [c for c in out.columns if c not in dataset.columns and c != "_target"]
        return cut(out.select(*[F.col("_target").alias(c) if c == TARGET else F.col(c) for c in dataset.columns], *added))


def preprocessing_chain(flags: LagFlags | None = None, exante: bool = False, knn: bool = True, lof: bool = True, lof_before_cap: bool = False, cascade: bool = False, group_median: bool = False, rare_min: int | None = None, knn_threshold: float = 0.30, high=None, low=None, scope: Sequence[str] = ()) -> Pipeline:
    """rare -> lags -> missing flags -> impute -> cap and LOF (either order) -> features -> forecast drop -> variance."""
    numeric = list(NUMERIC_FEATURES)
    impute: list = [GroupMedianImputer(numeric, knn_threshold)] if group_median else []
    impute.append(KnnImputer(numeric, threshold=knn_threshold) if knn else MedianImputer(numeric, 0.0))
    capper = [OutlierCapper(numeric, group=FF if cascade else [FARM])]
    scorer = [LofScorer(numeric)] if lof else []
    middle = scorer + capper if lof_before_cap else capper + scorer
    return Pipeline(stages=[
        RareCategoryGrouper(min_count=rare_min),
        LagStep(flags, scope),
        MissingFlagger(),
        *impute,
        *middle,
        FeatureGenerator(high=high, low=low),
        ConcurrentDropper(exante),
        VarianceFilter(keep=[TARGET]),
    ])


def run_eda(df: DataFrame, by: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], target: str = TARGET, date: str = DATE, order: Sequence | None = None) -> dict[str, DataFrame]:
    """All profile tables of every variety in one set of jobs, keyed by ``by``."""
    by = list(by)
    # Frames of huge groups are cut at whole days when the order begins with the day.
    first = date if order is None else None
    order = list(order or [F.col(date), F.col(ROW_ID)])
    cols = [*numeric, target]
    # Every table below reads the rows a few times; unless the order needs more, only these columns.
    if first is not None:
        df = df.select(*dict.fromkeys([*by, ROW_ID, date, *cols, *categorical]))
    df = cut(df)
    tables = {
        "quality": quality_metrics(df.select(*by, *cols, *categorical, date), categorical, date, by),
        "numeric": P.profile_numeric(df, cols, by),
        "boxcox": P.boxcox_grid(df, target, by),
        "acf": P.acf_pacf(df, target, order, 20, by, first=first),
        "seasonal": P.seasonal_strength(df, target, order, 12, by),
        "watson": T.durbin_watson(df, target, order, by, first=first),
        "ljung_box": T.ljung_box(df, target, order, 10, by, first=first),
        "kpss": T.kpss(df, target, order, 10, by, first=first),
        "adf": T.dickey_fuller(df, target, order, 1, by, first=first),
        "associations": P.category_associations(df, categorical, by),
        "top_variance": P.top_variance_columns(df, numeric, 3, by),
        "drift": D.year_drift(df, numeric, by, date),
    }
    s = tables["adf"].select(*by, F.col("rejects").alias("adf_rejects")).join(tables["kpss"].select(*by, F.col("rejects").alias("kpss_rejects")), by)
    drift = tables["drift"].select(*by, "variable", "severity").distinct()
    tables["findings"] = P.synthesize_findings(tables["numeric"], watson=tables["watson"], stationarity=s, drift=drift, by=by)
    tables["drift_summary"] = D.drift_summary(tables["drift"], tables["findings"], by)
    return tables


def evaluation_report(df: DataFrame, abs_gap: float, y: str = "y_true", p: str = "y_pred", replicates: int = 1000) -> dict[str, DataFrame]:
    """Every evaluation table of a champion; intervals and calibration need 20 rows."""
    m = E.regression_metrics(df, (), y, p)
    tables = {
        "metrics": m,
        "kpis": E.kpi_table(df, (), y, p),
        "verdict": m.select("mape", F.lit(abs_gap).alias("abs_gap"), E.verdict(F.col("mape"), F.lit(abs_gap)).alias("verdict")),
        "actions": E.recommended_actions(df, abs_gap, y=y, p=p),
        "bias": E.group_bias(df, FARM, y, p),
        "percentiles": E.error_percentiles(df, (), y, p),
        "context": E.training_context(df),
    }
    enough = m.select("n").scalar() >= 20
    tables["intervals"] = E.bootstrap_ci(df, replicates=replicates, y=y, p=p).where(enough)
    tables["heteroscedasticity"] = T.breusch_pagan_residuals(df.withColumn("_e", F.col(p) - F.col(y)), "_e", p).where(enough)
    tables["calibration"] = E.calibration_bins(df, 10, y, p)
    return tables
