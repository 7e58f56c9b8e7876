"""Model training and scoring with Spark ML: the driver submits fits, executors train."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.columns import DATE, FARM, FORMAT, MAX_GAP_REL, ROW_ID, TARGET, VARIETY
from furrow.functions.metrics import metric_columns
from furrow.functions.scalar import daily_kilos
from furrow.operators.evaluation import fit_baseline, predict_baseline, relative_floor_metrics
from furrow.operators.features import log_target, log_target_state, unlog_target
from furrow.operators.folds import kfold, temporal_year_split
from furrow.operators.groups import attach, quantiles
from furrow.session import cut, hot_rows

MAX_TREES = 1200
DEPTH_MAX, LEAVES_MAX = 8, 64


@dataclass(frozen=True)
class Backend:
    """A learner: builder from parameters, default grid, and the parameter that names it."""

    name: str
    build: Callable[[dict], object]
    grid: tuple[dict, ...]
    signature: str


def _gbt(p: dict):
    return GBTRegressor(
        lossType="absolute", maxIter=int(p.get("maxIter", 50)), maxDepth=int(p.get("maxDepth", 4)), stepSize=float(p.get("stepSize", 0.1)),
        minInstancesPerNode=int(p.get("minInstancesPerNode", 5)), subsamplingRate=float(p.get("subsamplingRate", 1.0)), maxBins=int(p.get("maxBins", 32)),
        validationTol=float(p.get("validationTol", 0.001)), seed=int(p.get("seed", 42)),
    )


def _forest(p: dict):
    return RandomForestRegressor(
        numTrees=int(p.get("numTrees", 20)), maxDepth=int(p.get("maxDepth", 6)), minInstancesPerNode=int(p.get("minInstancesPerNode", 5)),
        subsamplingRate=float(p.get("subsamplingRate", 0.8)), maxBins=int(p.get("maxBins", 32)), seed=int(p.get("seed", 42)),
    )


# The registry: add an entry to make a further learner available everywhere.
BACKENDS: dict[str, Backend] = {
    "gbt": Backend("gbt", _gbt, ({"maxDepth": 3}, {"maxDepth": 5}), "stepSize"),
    "forest": Backend("forest", _forest, ({"maxDepth": 5}, {"maxDepth": 8}), "numTrees"),
    "hybrid": Backend("hybrid", _gbt, ({"alpha": 10.0, "maxDepth": 3},), "alpha"),
}


def register_backend(backend: Backend) -> None:
    BACKENDS[backend.name] = backend


@dataclass
class Trained:
    """Fitted model with its feature list, target transform and fitted preprocessing."""

    features: list[str]
    model: object
    log: bool
    linear: object | None = None
    scaler: object | None = None
    n_train: int = 0
    chain: object | None = None
    # Names of the entries of the feature vector, where some feature is itself a vector.
    entries: list[str] | None = None

    def predict(self, df: DataFrame, name: str = "y_pred") -> DataFrame:
        columns = df.columns
        if self.chain is not None:
            # The rows as they came travel along, since the chain changes values.
            df = self.chain.transform(df.withColumn("_given", F.struct(*columns)))
        out = _assemble(df, self.features)
        if self.linear is not None:
            out = self.linear.transform(self.scaler.transform(out)).withColumnRenamed("_linear", "_base")
            total = self.model.transform(out).withColumn("_z", F.col("_base") + F.col("_p"))
        else:
            total = self.model.transform(out).withColumn("_z", F.col("_p"))
        z = F.col("_z")
        given = columns if self.chain is None else ["_given.*"]
        return total.select(*given, (F.greatest(unlog_target(z), F.lit(0.0)) if self.log else z).alias(name))

    @property
    def n_trees(self) -> int:
        return int(self.model.getNumTrees)


def _assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    wide = _wide(df, features)
    numeric = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in features if c not in wide})
    return VectorAssembler(inputCols=[c if c in wide else f"_f_{c}" for c in features], outputCol="_x").transform(numeric)


def _wide(df: DataFrame, features: Sequence[str]) -> dict[str, int]:
    """Features that are vectors, such as the dummies of many levels, and their sizes."""
    return {c: df.schema[c].metadata.get("ml_attr", {}).get("num_attrs", 0) for c, kind in df.dtypes if kind == "vector" and c in features}


def _numeric(df: DataFrame, but: Sequence[str]) -> list[str]:
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint", "vector")
    return [c for c, kind in df.dtypes if (kind in kinds or kind.startswith("decimal")) and c not in but and not c.startswith("_")]


@dataclass
class Prepared:
    """Training rows as vectors, written once, for any number of fits."""

    data: DataFrame
    n: int
    features: list[str]
    keep: list[str]
    weight: str | None
    val: str | None
    log: bool
    chain: object | None
    entries: list[str] | None = None


def prepare(df: DataFrame, features: Sequence[str] | None, y: str = TARGET, weight: str | None = None, val: str | None = None, log: bool = True, preprocessor: Pipeline | None = None) -> Prepared:
    """The rows a model is fitted on; arguments as in :func:`train`."""
    chain = None
    if preprocessor is not None:
        df = cut(df)
        chain = preprocessor.fit(df)
        df = cut(chain.transform(df))
        # A constant weight may be dropped as a constant column; it has no effect then.
        weight = weight if weight in df.columns else None
    if features is None:
        features = _numeric(df, [y, weight, val])
    rows = df.where(F.col(y).isNotNull())
    if log:
        rows = attach(rows, log_target_state(rows, y)).withColumn("_y", log_target(F.col(y), F.col("y_cap")))
    else:
        rows = rows.withColumn("_y", F.col(y).cast("double"))
    keep = ["_x", "_y", *[c for c in (weight, val) if c]]
    data = cut(_assemble(rows, features).select(*keep))
    wide = _wide(rows, features)
    entries = [e for c in features for e in ([f"{c}[{i}]" for i in range(wide[c])] if c in wide else [c])] if wide else None
    return Prepared(data, data.count(), list(features), keep, weight, val, log, chain, entries)


def train(df: DataFrame | Prepared, features: Sequence[str] | None, backend: str = "gbt", params: dict | None = None, y: str = TARGET, weight: str | None = None, val: str | None = None, log: bool = True, preprocessor: Pipeline | None = None) -> Trained:
    """Fit one model; ``weight`` and the validation marker ``val`` are optional columns.

    An unfitted ``preprocessor`` is fitted on these rows alone and belongs to the model, so a
    fold's medians, caps and lags never see its test rows. ``features`` may then name columns
    it makes; None takes every numeric column that comes out of it. ``df`` may be
    prepared rows, which say all but the backend and its parameters.
    """
    params = dict(params or {})
    got = df if isinstance(df, Prepared) else prepare(df, features, y, weight, val, log, preprocessor)
    data, n, weight, val = got.data, got.n, got.weight, got.val
    linear = scaler = None
    if backend == "hybrid":
        scaler = StandardScaler(inputCol="_x", outputCol="_sx", withMean=True, withStd=True).fit(data)
        ridge = LinearRegression(featuresCol="_sx", labelCol="_y", predictionCol="_linear", regParam=float(params.get("alpha", 10.0)) / max(n, 1), elasticNetParam=0.0)
        if weight:
            ridge = ridge.setWeightCol(weight)
        linear = ridge.fit(scaler.transform(data))
        data = linear.transform(scaler.transform(data)).withColumn("_y", F.col("_y") - F.col("_linear")).select(*got.keep)
    est = BACKENDS[backend].build(params)
    est = est.setFeaturesCol("_x").setLabelCol("_y").setPredictionCol("_p")
    if weight:
        est = est.setWeightCol(weight)
    if val and isinstance(est, GBTRegressor):
        est = est.setValidationIndicatorCol(val)
    return Trained(got.features, est.fit(data), got.log, linear, scaler, n, got.chain, got.entries)


def train_gbt(df, features, params=None, **kw) -> Trained:
    return train(df, features, "gbt", params, **kw)


def train_second_backend(df, features, params=None, **kw) -> Trained:
    return train(df, features, "forest", params, **kw)


def train_residual_hybrid(df, features, params=None, **kw) -> Trained:
    """Ridge on scaled features, boosting on what it leaves."""
    return train(df, features, "hybrid", params, **kw)


def score_frame(df: DataFrame, y: str = TARGET, p: str = "y_pred", metric: str = "mae") -> float:
    """One number that a search minimises: MAE, MAPE with a relative floor, or log MAE."""
    if metric == "mape":
        got = relative_floor_metrics(df, (), y, p).first()
        return float("inf") if got is None or got["mape"] is None else float(got["mape"])
    a, b = F.col(y), F.col(p)
    if metric == "mae_log":
        a, b = F.log1p(F.greatest(a, F.lit(0.0))), F.log1p(F.greatest(b, F.lit(0.0)))
    got = df.agg(F.avg(F.abs(a - b))).first()[0]
    return float("inf") if got is None else float(got)


def inner_search(df: DataFrame, features: Sequence[str], backend: str = "gbt", grid: Sequence[dict] | None = None, k: int = 3, metric: str = "mae", y: str = TARGET, weight: str | None = None, std_penalty: float = 0.0, gap_penalty: float = 0.0, base: dict | None = None, seed: int = 7, preprocessor: Pipeline | None = None) -> list[dict]:
    """Mean inner-fold score of every candidate, best first."""
    folds = cut(kfold(_needed(df, [ROW_ID, features, y, weight], preprocessor), k, seed, name="_inner"))
    options = [{**(base or {}), **params} for params in grid or BACKENDS[backend].grid]
    scores: list[list[float]] = [[] for _ in options]
    gaps: list[list[float]] = [[] for _ in options]
    for f in range(k):
        fit_rows, test = folds.where(F.col("_inner") != f).drop("_inner"), folds.where(F.col("_inner") == f).drop("_inner")
        # A fold's rows are the same for every candidate.
        ready = prepare(fit_rows, features, y, weight, preprocessor=preprocessor)
        for i, params in enumerate(options):
            model = train(ready, features, backend, params)
            scores[i].append(score_frame(model.predict(test), y, "y_pred", metric))
            if gap_penalty:
                gaps[i].append(max(0.0, scores[i][-1] - score_frame(model.predict(fit_rows), y, "y_pred", metric)))
    out = []
    for params, own, gap in zip(options, scores, gaps, strict=True):
        mean = sum(own) / k
        sd = (sum((s - mean) ** 2 for s in own) / k) ** 0.5
        out.append({"params": params, "score": mean + std_penalty * sd + gap_penalty * (sum(gap) / len(gap) if gap else 0.0)})
    return sorted(out, key=lambda r: r["score"])


def _needed(df: DataFrame, names: Sequence, preprocessor: Pipeline | None = None) -> DataFrame:
    """The columns of ``df`` that a job needs, which are all where preprocessing or features are open."""
    if preprocessor is not None or None in names[:3]:
        return df
    flat = [c for n in names if n is not None for c in ([n] if isinstance(n, str) else n)]
    return df.select(*[c for c in dict.fromkeys(flat) if c in df.columns])


@dataclass
class NestedResult:
    folds: list[dict] = field(default_factory=list)
    oof: DataFrame | None = None


def nested_cv(df: DataFrame, features: Sequence[str], backend: str = "gbt", grid: Sequence[dict] | None = None, outer: int = 5, inner: int = 3, y: str = TARGET, weight: str | None = None, fold: str | None = None, base: dict | None = None, metric: str = "mae", preprocessor: Pipeline | None = None) -> NestedResult:
    """Outer folds: search inside, refit, test and train MAE, R2, gap, baseline, OOF rows."""
    df = _needed(df, [ROW_ID, features, y, weight, fold, FARM, FORMAT], preprocessor)
    rows = cut(df if fold else kfold(df, outer, 42, name="fold_id"))
    fold = fold or "fold_id"
    options = list(grid or BACKENDS[backend].grid)

    def one(f):
        fit_rows, test = rows.where(F.col(fold) != f).drop(fold), rows.where(F.col(fold) == f).drop(fold)
        best = {**(base or {}), **options[0]} if len(options) == 1 else inner_search(fit_rows, features, backend, options, inner, metric, y, weight, base=base, preprocessor=preprocessor)[0]["params"]
        model = train(fit_rows, features, backend, best, y, weight, preprocessor=preprocessor)
        tested = predict_baseline(model.predict(test), fit_baseline(fit_rows, y), "baseline_y_pred")
        tested = cut(tested.select(ROW_ID, F.col(y).alias("y_true"), "y_pred", F.lit(f).cast("int").alias("fold_id"), "baseline_y_pred"))
        m = metric_columns(F.col("y_true"), F.col("y_pred"))
        got = tested.agg(m["mae"].alias("mae"), m["r2"].alias("r2"), F.avg(F.abs(F.col("y_true") - F.col("baseline_y_pred"))).alias("base")).first()
        train_mae = score_frame(model.predict(fit_rows), y)
        return {"fold_id": f, "mae_test": got["mae"], "mae_train": train_mae, "r2": got["r2"], "gap": got["mae"] - train_mae, "baseline_mae": got["base"], "params": best}, tested

    # Fits of few rows wait for the driver, not for cores; larger ones fill the cores by themselves.
    with ThreadPoolExecutor(max_workers=outer if rows.count() <= hot_rows(df.sparkSession) else 1) as pool:
        done = list(pool.map(one, range(outer)))
    oof = done[0][1]
    for _, tested in done[1:]:
        oof = oof.unionByName(tested)
    return NestedResult([f for f, _ in done], oof)


def fold_table(df: DataFrame, result: NestedResult) -> DataFrame:
    rows = [(r["fold_id"], r["mae_test"], r["mae_train"], r["r2"], r["gap"], r["baseline_mae"], str(sorted(r["params"].items()))) for r in result.folds]
    return df.sparkSession.createDataFrame(rows, "fold_id int, mae_test double, mae_train double, r2 double, gap double, baseline_mae double, params string")


def pick_final_params(result: NestedResult) -> dict:
    """Parameters of the median fold by test MAE."""
    order = sorted(result.folds, key=lambda r: r["mae_test"])
    return order[len(order) // 2]["params"]


def temporal_honesty_check(df: DataFrame, features: Sequence[str], backend: str = "gbt", params: dict | None = None, k: int = 3, min_train_years: int = 2, window_days: int | None = None, y: str = TARGET, weight: str | None = None, date: str = DATE, preprocessor: Pipeline | None = None) -> DataFrame:
    """Fixed parameters on expanding years: pooled error, skill over the baseline, last year."""
    rows = cut(temporal_year_split(df, k, min_train_years, date=date))
    years = [r[0] for r in rows.select("test_year").distinct().orderBy("test_year").collect()]
    oof, maes, bases = None, [], []
    for year in years:
        part = rows.where(F.col("test_year") == year)
        fit_rows, test = part.where("role = 'train'").drop("role"), part.where("role = 'test'").drop("role")
        if window_days is not None:
            first = test.agg(F.min(date).alias("d")).scalar()
            fit_rows = fit_rows.where(F.col(date) >= F.date_sub(first, window_days))
        model = train(fit_rows.drop("test_year"), features, backend, params, y, weight, preprocessor=preprocessor)
        tested = predict_baseline(model.predict(test.drop("test_year")), fit_baseline(fit_rows, y), "_base").withColumn("test_year", F.lit(year))
        tested = cut(tested.select(ROW_ID, "test_year", F.col(y).alias("y_true"), "y_pred", "_base"))
        got = tested.agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))), F.avg(F.abs(F.col("y_true") - F.col("_base")))).first()
        maes.append(got[0])
        bases.append(got[1])
        oof = tested if oof is None else oof.unionByName(tested)
    spark = df.sparkSession
    schema = "temporal_mape double, temporal_r2 double, temporal_mae double, temporal_skill double, temporal_folds int, holdout_year int, holdout_mae double, holdout_mape double, holdout_skill double"
    if oof is None:
        return spark.createDataFrame([], schema)
    pooled = relative_floor_metrics(oof).first()
    last = relative_floor_metrics(oof.where(F.col("test_year") == years[-1])).first()

    def skill(model_mae, base):
        return 1 - model_mae / base if base and base > 0 else None

    row = (pooled["mape"], pooled["r2"], sum(maes) / len(maes), skill(sum(maes), sum(bases)), len(years), years[-1], last["mae"], last["mape"], skill(maes[-1], bases[-1]))
    return spark.createDataFrame([row], schema)


@dataclass
class Ensemble:
    members: list[Trained]

    def predict(self, df: DataFrame, name: str = "y_pred") -> DataFrame:
        """Mean and sample deviation of the members."""
        out = df
        cols = []
        for i, m in enumerate(self.members):
            out = m.predict(out, f"_m{i}")
            cols.append(F.col(f"_m{i}"))
        k = len(cols)
        mean = sum(cols[1:], cols[0]) / k
        out = out.withColumn(name, mean)
        spread = F.sqrt(sum((F.pow(c - F.col(name), 2) for c in cols), F.lit(0.0)) / (k - 1)) if k > 1 else F.lit(0.0)
        return out.withColumn(f"{name}_std", spread).select(*df.columns, name, f"{name}_std")


def ensemble_fit(df: DataFrame, features: Sequence[str], k: int = 5, backend: str = "gbt", params: dict | None = None, y: str = TARGET, weight: str | None = None, preprocessor: Pipeline | None = None) -> Ensemble:
    """k refits, each without one fold."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if k == 1:
        return Ensemble([train(df, features, backend, params, y, weight, preprocessor=preprocessor)])
    folds = cut(kfold(df, k, 42, name="_fold"))
    return Ensemble([train(folds.where(F.col("_fold") != f).drop("_fold"), features, backend, params, y, weight, preprocessor=preprocessor) for f in range(k)])


def final_refit(df: DataFrame, features: Sequence[str], stopped: Trained, params: dict | None = None, y: str = TARGET, weight: str | None = None, preprocessor: Pipeline | None = None) -> Trained:
    """Refit on all rows with the trees found, scaled by the extra rows and capped."""
    n = df.where(F.col(y).isNotNull()).count()
    trees = max(1, min(round(stopped.n_trees * n / max(stopped.n_train, 1)), MAX_TREES))
    return train(df, features, "gbt", {**(params or {}), "maxIter": trees}, y, weight, log=stopped.log, preprocessor=preprocessor)


def capacity_caps(n: Column) -> dict[str, Column]:
    """Depth, leaves and smallest leaf by row count."""
    full = n.isNull() | (n >= 900)
    small = n < 400
    return {
        "max_depth": F.when(full, F.lit(DEPTH_MAX)).when(small, F.lit(min(5, DEPTH_MAX))).otherwise(F.lit(min(6, DEPTH_MAX))),
        "max_leaves": F.when(full, F.lit(LEAVES_MAX)).when(small, F.lit(24)).otherwise(F.lit(32)),
        "min_child": F.when(full, F.lit(5)).otherwise(F.greatest(F.lit(5), F.bround(F.when(small, n * 0.02).otherwise(n * 0.015)).cast("int"))),
    }


def train_all_varieties(df: DataFrame, features: Sequence[str], backends: Sequence[str] = ("gbt", "forest"), key: str = VARIETY, outer: int = 2, base: dict | None = None, parallel: int = 4, y: str = TARGET) -> tuple[DataFrame, DataFrame]:
    """(results, oof) of every variety and backend; a failure becomes a row, not a stop.

    Fits of several varieties run at the same time on one session; each is a Spark job.
    """
    import time

    data = cut(df)
    names = [r[0] for r in data.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).collect()]

    def one(job):
        name, backend = job
        start = time.time()
        try:
            rows = data.where(F.col(key) == name)
            got = nested_cv(rows, features, backend, BACKENDS[backend].grid[:1], outer, y=y, base=base)
            mean = {k: sum(f[k] for f in got.folds) / len(got.folds) for k in ("mae_test", "mae_train", "gap", "r2", "baseline_mae")}
            mape = got.oof.agg(metric_columns(F.col("y_true"), F.col("y_pred"))["mape"]).first()[0]
            skill = 1 - mean["mae_test"] / mean["baseline_mae"] if mean["baseline_mae"] else None
            row = (name, backend, mape, mean["mae_test"], mean["mae_train"], mean["gap"], mean["r2"], skill, time.time() - start, None)
            return row, got.oof.withColumn(key, F.lit(name)).withColumn("model_type", F.lit(backend))
        except Exception as exc:  # noqa: BLE001
            return (name, backend, None, None, None, None, None, None, time.time() - start, str(exc)[:500]), None

    jobs = [(n, b) for n in names for b in backends]
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        done = list(pool.map(one, jobs))
    schema = f"{key} string, model_type string, oof_mape double, mae_test double, mae_train double, gap double, r2 double, baseline_skill double, elapsed_seconds double, error string"
    results = df.sparkSession.createDataFrame([r for r, _ in done], schema)
    oof = None
    for _, part in done:
        if part is not None:
            oof = part if oof is None else oof.unionByName(part)
    return results, oof


def score_batch(df: DataFrame, models: dict[str, Trained | Ensemble], key: str = VARIETY, hours: str | None = None, bands: dict | None = None, baseline: dict | None = None) -> DataFrame:
    """Predictions of every variety's own model, with daily kilos, bands and row drift.

    Rows of a variety without a model, or of none, stay with a null prediction; their
    ``score_reason`` says so.
    """
    from furrow.operators.drift import row_drift
    from furrow.operators.evaluation import apply_bands

    out = None
    for name, model in models.items():
        part = model.predict(df.where(F.col(key) == name), "y_pred")
        if "y_pred_std" not in part.columns:
            part = part.withColumn("y_pred_std", F.lit(None).cast("double"))
        part = part.withColumn("score_reason", F.lit(None).cast("string"))
        out = part if out is None else out.unionByName(part)
    rest = df.where(~F.coalesce(F.col(key).isin(list(models)), F.lit(False)))
    null = F.lit(None).cast("double")
    rest = rest.select("*", null.alias("y_pred"), null.alias("y_pred_std"), F.lit("no model").alias("score_reason"))
    out = rest if out is None else out.unionByName(rest, allowMissingColumns=True)
    if hours:
        out = out.withColumn("kgjn_pred", daily_kilos(F.col("y_pred"), F.col(hours)))
    if bands:
        out = apply_bands(out, bands, "y_pred")
    if baseline:
        out = row_drift(out, baseline, by=key)
    return out


def rescore_changed(old: DataFrame, new: DataFrame, inputs: Sequence[str], score: Callable[[DataFrame], DataFrame], key: str = ROW_ID, pred: str = "y_pred") -> DataFrame:
    """Predict only rows whose model inputs changed; the rest keep their prediction."""
    before = old.select(F.col(key), F.xxhash64(*inputs).alias("_h"), F.col(pred).alias("_old"))
    joined = attach(new, before, [key]).withColumn("_same", F.coalesce(F.col("_h") == F.xxhash64(*inputs), F.lit(False)))
    kept = joined.where("_same").select(*new.columns, F.col("_old").alias(pred), F.lit(False).alias("rescored"))
    fresh = score(joined.where("NOT _same").select(*new.columns)).select(*new.columns, pred, F.lit(True).alias("rescored"))
    return kept.unionByName(fresh)


def warm_start(requests: DataFrame, last: DataFrame, key: str = VARIETY) -> DataFrame:
    """Seed parameters from the last champion of the same backend unless it was overfit.

    ``last`` has ``backend, depth, leaves, gap, mae_test``; limits come from the grid.
    """
    prev = last.select(key, F.col("backend").alias("_b"), F.col("depth").alias("_d"), F.col("leaves").alias("_l"), (F.abs("gap") / F.when(F.col("mae_test") > 0, F.col("mae_test"))).alias("_g"))
    out = attach(requests, prev, [key])
    usable = (F.col("_b") == F.col("backend")) & ~F.coalesce(F.col("_g") > MAX_GAP_REL, F.lit(False))
    depth = F.least(F.greatest(F.col("_d"), F.lit(3)), F.lit(DEPTH_MAX))
    leaves = F.least(F.greatest(F.col("_l"), F.lit(8)), F.lit(LEAVES_MAX))
    why = F.when(F.col("_b").isNull(), "no_model").when(F.col("_b") != F.col("backend"), "other_backend").when(F.col("_g") > MAX_GAP_REL, "overfit").otherwise("seeded")
    return out.select(*requests.columns, F.when(usable, depth).alias("seed_depth"), F.when(usable, leaves).alias("seed_leaves"), why.alias("start"))


def importances(model: Trained) -> list[tuple[str, float]]:
    values = model.model.featureImportances.toArray()
    return sorted(zip(model.entries or model.features, (float(v) for v in values)), key=lambda t: -t[1])


def partial_dependence(model: Trained, df: DataFrame, top: int = 5, grid: int = 30) -> DataFrame:
    """Mean prediction per grid value of the most important features."""
    chosen = [n for n, _ in importances(model) if n in model.features][:top]
    spec = {f"{c}__{s}": (c, p) for c in chosen for s, p in (("lo", 0.05), ("hi", 0.95))}
    limits = quantiles(df, [], spec).first()
    out = None
    for c in chosen:
        lo, hi = limits[f"{c}__lo"], limits[f"{c}__hi"]
        points = [lo + (hi - lo) * i / (grid - 1) for i in range(grid)]
        moved = df.select(*[x for x in model.features if x != c], F.explode(F.array(*[F.lit(float(v)) for v in points])).alias(c))
        part = model.predict(moved).groupBy(F.lit(c).alias("feature"), F.col(c).alias("value")).agg(F.avg("y_pred").alias("mean_pred"))
        out = part if out is None else out.unionByName(part)
    return out


def route_predictive(df: DataFrame, anchors: Sequence[str], features: Sequence[str], key: str = VARIETY, y: str = TARGET, params: dict | None = None, own_folds: int = 5, parallel: int = 4, row_id: str = ROW_ID) -> DataFrame:
    """A model per anchor scores every row once; routed varieties get their own k-fold error."""
    from furrow.operators.routing import MIN_OWN, routing_decisions

    rows = cut(df.select(row_id, key, y, *features).dropna().where(F.col(y) > 0))
    models = {a: train(rows.where(F.col(key) == a), features, "gbt", params, y, log=False) for a in anchors}
    scored = rows
    for i, a in enumerate(anchors):
        scored = models[a].predict(scored, f"_p{i}")
    pairs = F.array(*[F.struct(F.lit(a).alias("anchor"), F.col(f"_p{i}").alias("_p")) for i, a in enumerate(anchors)])
    long = scored.select(key, F.col(y).alias("_y"), F.explode(pairs).alias("_e"))
    ape = F.abs((F.col("_y") - F.col("_e._p")) / F.col("_y"))
    errors = cut(long.groupBy(key, F.col("_e.anchor").alias("anchor")).agg((F.avg(ape) * 100).alias("mape"), F.count(F.lit(1)).alias("n")))

    folds = cut(kfold(rows, own_folds, 42, [key], row_id, "_fold"))
    # One row per variety.
    names = [r[0] for r in rows.groupBy(key).count().where((F.col("count") >= MIN_OWN) & ~F.col(key).isin(list(anchors))).orderBy(key).collect()]

    def own_error(name):
        mine = folds.where(F.col(key) == name)
        scores = []
        for f in range(own_folds):
            model = train(mine.where(F.col("_fold") != f), features, "gbt", params, y, log=False)
            got = model.predict(mine.where(F.col("_fold") == f)).agg(F.avg(F.abs((F.col(y) - F.col("y_pred")) / F.col(y))) * 100).first()[0]
            scores.append(got)
        return name, sum(scores) / len(scores)

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        own = list(pool.map(own_error, names))
    table = df.sparkSession.createDataFrame(own, f"{key} string, mape double")
    return routing_decisions(errors, table, anchors, key)
