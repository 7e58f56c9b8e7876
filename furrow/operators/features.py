"""Engineered features fitted on training rows: season, skew, dummies, frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.columns import DATE, FARM, FORMAT, HIGH_SEASON, LOW_SEASON, NUMERIC_FEATURES, TARGET
from furrow.functions.scalar import cyclic_date, season_flags, structural_ratios, trend_index
from furrow.functions.stats import kurtosis_corrected, skew_corrected
from furrow.operators.groups import attach, quantiles
from furrow.operators.saving import Saved
from furrow.session import cut

SKEW_LIMIT, KURT_LIMIT, SKEW_MIN_ROWS = 1.5, 50.0, 30
SEASON_MIN_OBS, SEASON_HIGH, SEASON_LOW = 5, 0.66, 0.33


def fill_date_with_median(df: DataFrame, date: str = DATE) -> DataFrame:
    """Null dates become the median date of the frame."""
    med = quantiles(df.select(F.unix_date(F.col(date)).cast("double").alias("_d")), [], {"_med": ("_d", 0.5)})
    out = attach(df, med)
    return out.withColumn(date, F.coalesce(F.col(date), F.date_from_unix_date(F.floor("_med").cast("int")))).drop("_med")


def derive_season_months(df: DataFrame, date: str = DATE, y: str = TARGET, by: Sequence[str] = ()) -> DataFrame:
    """Months of high and low target; null when fewer than three months have 5 rows.

    Works on at most twelve rows per group after the first aggregate.
    """
    by = list(by)
    monthly = (
        df.where(F.col(date).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.month(date).alias("_month"))
        .agg(F.avg(y).alias("_mean"), F.count(y).alias("_n"))
        .where(F.col("_n") >= SEASON_MIN_OBS)
    )
    limits = monthly.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_months"),
        F.percentile("_mean", F.lit(SEASON_HIGH)).alias("_hi"),
        F.percentile("_mean", F.lit(SEASON_LOW)).alias("_lo"),
    )
    rows = attach(monthly, limits, by)
    enough = F.col("_months") >= 3

    def months(test: Column) -> Column:
        return F.sort_array(F.collect_set(F.when(enough & test, F.col("_month"))))

    found = rows.groupBy(*by).agg(months(F.col("_mean") >= F.col("_hi")).alias("high"), months(F.col("_mean") <= F.col("_lo")).alias("low"))
    return found.select(*by, *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("high", "low")])


def skew_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: rows, skewness, kurtosis, shift and the transform they call for."""
    aggs, items = [], []
    for c in cols:
        v = F.col(c).cast("double")
        aggs += [
            F.count(v).alias(f"{c}__n"),
            F.stddev_samp(v).alias(f"{c}__sd"),
            skew_corrected(v).alias(f"{c}__skew"),
            kurtosis_corrected(v).alias(f"{c}__kurt"),
            F.greatest(-F.min(v), F.lit(0.0)).alias(f"{c}__shift"),
        ]
        items.append(F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{k}").alias(k) for k in ("n", "sd", "skew", "kurt", "shift")]))
    rows = df.agg(*aggs).select(F.inline(F.array(*items)))
    usable = (F.col("n") >= SKEW_MIN_ROWS) & (F.col("sd") > 0)
    kind = F.when(usable & (F.abs("kurt") > KURT_LIMIT), "sqrt").when(usable & (F.abs("skew") > SKEW_LIMIT), "log1p")
    return rows.select("column", "n", "skew", "kurt", "shift", kind.alias("transform"))


def skew_column(col: str, shift: float, kind: str) -> Column:
    moved = F.when(F.col(col).isNotNull(), F.greatest(F.col(col) + F.lit(float(shift)), F.lit(0.0)))
    return F.log1p(moved) if kind == "log1p" else F.sqrt(moved)


class SkewTransformer(Saved, Estimator):
    """log1p or sqrt of skewed columns with the shift of the training rows."""

    def __init__(self, cols: Sequence[str] = tuple(NUMERIC_FEATURES), drop_raw: bool = False):
        super().__init__()
        self.cols, self.drop_raw = list(cols), drop_raw

    def _fit(self, dataset):
        # One row per column.
        rows = skew_profile(dataset, self.cols).where(F.col("transform").isNotNull()).collect()
        return SkewModel([(r["column"], r["shift"], r["transform"]) for r in rows], self.drop_raw)


class SkewModel(Saved, Model):
    def __init__(self, plan, drop_raw=False):
        super().__init__()
        self.plan, self.drop_raw = plan, drop_raw

    def _transform(self, dataset):
        out = dataset.withColumns({f"{c}_{kind}": skew_column(c, s, kind) for c, s, kind in self.plan}) if self.plan else dataset
        return out.drop(*[c for c, _, _ in self.plan]) if self.drop_raw else out


class OneHot(Saved, Estimator):
    """0/1 columns of the training levels in sorted order; unseen levels are all 0.

    Several columns joined by ``__`` make the interaction form.
    """

    def __init__(self, col: str | Sequence[str], prefix: str | None = None):
        super().__init__()
        self.cols = [col] if isinstance(col, str) else list(col)
        self.prefix = prefix or "_".join(self.cols)

    def key(self) -> Column:
        return F.concat_ws("__", *self.cols) if len(self.cols) > 1 else F.col(self.cols[0]).cast("string")

    def _fit(self, dataset):
        # The levels become output columns, so they are few by nature (rare ones are grouped first).
        levels = [r[0] for r in dataset.select(self.key().alias("k")).where("k IS NOT NULL").distinct().orderBy("k").collect()]
        return OneHotModel(self, levels)


class OneHotModel(Saved, Model):
    def __init__(self, parent: OneHot, levels: list[str]):
        super().__init__()
        self.how, self.levels = parent, levels

    def names(self) -> list[str]:
        return [f"{self.how.prefix}__{v}" for v in self.levels]

    def _transform(self, dataset):
        key = self.how.key()
        flags = [F.coalesce((key == v).cast("int"), F.lit(0)).alias(n) for v, n in zip(self.levels, self.names())]
        return dataset.select("*", *flags)


class SparseOneHot(Saved, Estimator):
    """One sparse vector column of the training levels, for columns with any number of them.

    Levels (several columns joined by ``__`` make the interaction form) are numbered in sorted
    order in a table that is joined to the rows; none of them passes the driver. Unseen levels
    and nulls have an empty vector. ``least`` leaves out levels with fewer training rows.
    ``skip_null`` joins what is not null of several columns, as ``OneHot`` does.
    """

    def __init__(self, col: str | Sequence[str], output: str | None = None, least: int = 1, skip_null: bool = False):
        super().__init__()
        self.cols = [col] if isinstance(col, str) else list(col)
        self.output, self.least, self.skip_null = output or "_".join(self.cols) + "__levels", least, skip_null

    def key(self) -> Column:
        if self.skip_null and len(self.cols) > 1:
            return F.concat_ws("__", *self.cols)
        parts = [F.col(c).cast("string") for c in self.cols]
        return F.concat(*[x for c in parts for x in (F.lit("__"), c)][1:])

    def _fit(self, dataset):
        from furrow.operators.ordered import position

        levels = dataset.select(self.key().alias("_level")).where("_level IS NOT NULL").groupBy("_level").count().where(F.col("count") >= self.least)
        numbered = cut(position(levels.select("_level"), [], [F.col("_level")], "_at").withColumn("_at", F.col("_at") - 1))
        return SparseOneHotModel(self, numbered, numbered.count())


class SparseOneHotModel(Saved, Model):
    def __init__(self, how: SparseOneHot, levels: DataFrame, size: int):
        super().__init__()
        self.how, self.levels, self.size = how, levels, size

    def names(self) -> DataFrame:
        """(place, name) of every entry of the vector."""
        return self.levels.select(F.col("_at").alias("place"), F.concat(F.lit("_".join(self.how.cols) + "__"), F.col("_level")).alias("name"))

    def _transform(self, dataset):
        spark = dataset.sparkSession
        placed = attach(dataset.withColumn("_level", self.how.key()), self.levels, ["_level"])
        placed = placed.withColumn("_at", F.coalesce(F.col("_at"), F.lit(self.size)).cast("double"))
        # An index beyond the last level is the invalid one, which has no entry.
        encoder = OneHotEncoder(inputCols=["_at"], outputCols=[self.how.output], handleInvalid="keep")
        fitted = encoder.fit(spark.range(1).select(F.lit(float(max(self.size - 1, 0))).alias("_at")))
        return fitted.transform(placed).drop("_level", "_at")


# Levels up to which each has a column of its own; beyond that they are entries of one sparse vector.
DENSE_LEVELS = 200


def fit_levels(dataset: DataFrame, col: str | Sequence[str], prefix: str | None = None) -> Model:
    """Dummies of every training level: columns where these are few, otherwise a sparse vector.

    Thousands of columns take the planner longer than the job, and each is read for every row.
    """
    dense = OneHot(col, prefix)
    found = dataset.select(dense.key().alias("k")).where("k IS NOT NULL").distinct().limit(DENSE_LEVELS + 1).count()
    return dense.fit(dataset) if found <= DENSE_LEVELS else SparseOneHot(col, f"{dense.prefix}__levels", skip_null=True).fit(dataset)


class FrequencyEncoder(Saved, Estimator):
    """Training share of each level; unseen levels 0. With ``scope``, shares within its columns."""

    def __init__(self, cols: Sequence[str] = (FARM, FORMAT), scope: Sequence[str] = ()):
        super().__init__()
        self.cols, self.scope = list(cols), list(scope)

    def _fit(self, dataset):
        from furrow.session import cut

        sizes = dataset.groupBy(*self.scope).agg(F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double").alias("_all"))
        states = {}
        for c in self.cols:
            n = attach(dataset.groupBy(*dict.fromkeys([*self.scope, c])).agg(F.count(F.lit(1)).alias("_n")), sizes, self.scope)
            states[c] = cut(n.select(*dict.fromkeys([*self.scope, c]), (F.col("_n") / F.col("_all")).alias(f"{c}_freq")))
        return FrequencyModel(states, self.scope)


class FrequencyModel(Saved, Model):
    def __init__(self, states, scope: Sequence[str] = ()):
        super().__init__()
        self.states, self.scope = states, list(scope)

    def _transform(self, dataset):
        for c, state in self.states.items():
            dataset = attach(dataset, state, list(dict.fromkeys([*self.scope, c]))).withColumn(f"{c}_freq", F.coalesce(f"{c}_freq", F.lit(0.0)))
        return dataset


# Features known only on the day itself.
SAME_DAY_EXACT = {"kg_ha", "indus_pct", "indus_pct__miss"}
SAME_DAY_PREFIXES = (
    "kg_ha_log1p", "kg_ha_sqrt", "indus_pct", "kg_total", "indus_kg_ha", "kg_per_baya", "kg_ha_per_dpc",
    "kg_ha_ratio_FF_", "kg_ha_rel_global_",
)


def is_same_day(col: str) -> bool:
    return col in SAME_DAY_EXACT or col.startswith(SAME_DAY_PREFIXES)


def drop_concurrent(df: DataFrame) -> DataFrame:
    """Forecast mode: no feature of the harvest day itself."""
    return df.drop(*[c for c in df.columns if is_same_day(c)])


class ConcurrentDropper(Saved, Transformer):
    def __init__(self, active: bool = False):
        super().__init__()
        self.active = active

    def _transform(self, dataset):
        return drop_concurrent(dataset) if self.active else dataset


def log_target_state(df: DataFrame, y: str = TARGET, cap: float = 0.995) -> DataFrame:
    return quantiles(df, [], {"y_cap": (y, cap)})


def log_target(y: Column, cap: Column) -> Column:
    """log1p of the target clipped to [0, training cap]."""
    return F.when(y.isNotNull(), F.log1p(F.least(F.greatest(y, F.lit(0.0)), cap)))


def unlog_target(z: Column) -> Column:
    return F.expm1(z)


class FeatureGenerator(Saved, Estimator):
    """Ratios, skew columns, calendar, trend, frequencies and dummies with a fixed column list.

    Dummies of a column with more than ``DENSE_LEVELS`` levels are one sparse vector.
    """

    def __init__(self, date: str = DATE, target: str = TARGET, interaction: bool = True, calendar_extra: bool = False,
                 drop_raw_skew: bool = False, high=None, low=None, categorical: Sequence[str] = (FORMAT, FARM)):
        super().__init__()
        self.date, self.target, self.interaction, self.extra = date, target, interaction, calendar_extra
        self.drop_raw, self.high, self.low, self.categorical = drop_raw_skew, high, low, list(categorical)

    def _fit(self, dataset):
        numeric = [c for c in NUMERIC_FEATURES if c in dataset.columns]
        stages = [SkewTransformer(numeric, False).fit(dataset)]
        if self.extra:
            stages.append(FrequencyEncoder(self.categorical).fit(dataset))
        stages += [fit_levels(dataset, c) for c in self.categorical]
        if self.interaction:
            stages.append(fit_levels(dataset, [FARM, FORMAT], "fundo_formato"))
        anchor = dataset.agg(F.min(self.date)).first()[0]
        high, low = self.high, self.low
        if (high is None or low is None) and self.target in dataset.columns:
            found = derive_season_months(dataset, self.date, self.target).first()
            high = high or (found and found["high"])
            low = low or (found and found["low"])
        return FeatureModel(self, stages, anchor, list(high or HIGH_SEASON), list(low or LOW_SEASON))


class FeatureModel(Saved, Model):
    def __init__(self, how: FeatureGenerator, stages, anchor, high, low):
        super().__init__()
        self.how, self.stages, self.anchor, self.high, self.low = how, stages, anchor, high, low

    def _transform(self, dataset):
        d = F.col(self.how.date)
        have = set(dataset.columns)
        needs = {"kg_total": {"kg_ha", "ha"}, "indus_kg_ha": {"indus_pct", "kg_ha"}, "kg_per_baya": {"kg_ha", "p_baya"}, "kg_ha_per_dpc": {"kg_ha", "dpc"}}
        ratios = {n: e for n, e in structural_ratios().items() if needs[n] <= have}
        out = fill_date_with_median(dataset, self.how.date)
        out = out.withColumns({**ratios, **cyclic_date(d, self.how.extra), **season_flags(d, self.high, self.low)})
        if self.anchor is not None:
            out = out.withColumns(trend_index(d, F.lit(self.anchor)))
        for stage in self.stages:
            out = stage.transform(out)
        drop = [c for c, _, _ in self.stages[0].plan] if self.how.drop_raw else []
        return out.drop(*drop)
