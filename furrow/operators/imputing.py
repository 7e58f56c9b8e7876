"""Cleaning steps fitted on training rows and applied anywhere, as Spark ML stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.columns import FARM, FF, MISSING_FLAG_COLUMNS, NUMERIC_FEATURES, OTHER
from furrow.operators.groups import attach, is_hot, quantiles
from furrow.operators.saving import Saved
from furrow.session import cut

RARE_MOST, RARE_LEAST, RARE_SHARE = 50, 15, 0.03


def rare_threshold(n: int, min_count: int | None = None) -> int:
    """Fixed count, or 3 % of rows within 15..50."""
    if min_count is not None:
        return max(1, int(min_count))
    return min(RARE_MOST, max(RARE_LEAST, round(RARE_SHARE * n)))


class RareCategoryGrouper(Saved, Estimator):
    """Levels under the threshold, nulls and unseen levels become ``other``.

    With ``scope`` every combination of those columns has a threshold and levels of its own.
    """

    def __init__(self, cols: Sequence[str] = ("formato",), min_count: int | None = None, other: str = OTHER, scope: Sequence[str] = ()):
        super().__init__()
        self.cols, self.min_count, self.other, self.scope = [c for c in cols if c not in scope], min_count, other, list(scope)

    def _fit(self, dataset):
        states = {}
        if self.scope:
            n = F.col("_n")
            share = F.greatest(F.least(F.bround(n * RARE_SHARE), F.lit(RARE_MOST)), F.lit(RARE_LEAST))
            least = F.lit(max(1, int(self.min_count))) if self.min_count is not None else share
            sizes = dataset.groupBy(*self.scope).agg(F.count(F.lit(1)).alias("_n"))
            for c in self.cols:
                level = F.coalesce(F.col(c).cast("string"), F.lit(self.other)).alias(c)
                counts = attach(dataset.groupBy(*self.scope, level).count(), sizes, self.scope)
                states[c] = cut(counts.where(F.col("count") >= least).select(*self.scope, c))
            return RareCategoryModel(states, self.other, None, self.scope)
        least = rare_threshold(dataset.count(), self.min_count)
        for c in self.cols:
            level = F.coalesce(F.col(c).cast("string"), F.lit(self.other)).alias(c)
            states[c] = cut(dataset.groupBy(level).count().where(F.col("count") >= least).select(c))
        return RareCategoryModel(states, self.other, least)


class RareCategoryModel(Saved, Model):
    def __init__(self, states: dict[str, DataFrame], other: str, least: int | None, scope: Sequence[str] = ()):
        super().__init__()
        self.states, self.other, self.least, self.scope = states, other, least, list(scope)

    def _transform(self, dataset):
        for c, levels in self.states.items():
            filled = dataset.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(self.other)))
            known = levels.withColumn("_known", F.lit(True))
            joined = attach(filled, known, [*self.scope, c])
            dataset = joined.withColumn(c, F.when(F.col("_known"), F.col(c)).otherwise(self.other)).drop("_known")
        return dataset


def collapse_rare(df: DataFrame, col: str, min_count: int, other: str = OTHER) -> DataFrame:
    """Whole-table form: rare levels of this table to ``other``, nulls kept."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    out = attach(df, counts, [col])
    return out.withColumn(col, F.when(F.col(col).isNotNull() & (F.col("_n") < min_count), other).otherwise(F.col(col))).drop("_n")


class MissingFlagger(Saved, Transformer):
    """``<col>__miss`` flags and their sum ``n_miss_raw``."""

    def __init__(self, cols: Sequence[str] = tuple(MISSING_FLAG_COLUMNS)):
        super().__init__()
        self.cols = list(cols)

    def _transform(self, dataset):
        present = [c for c in self.cols if c in dataset.columns]
        flags = {f"{c}__miss": F.col(c).isNull().cast("int") for c in present}
        total = sum(flags.values(), F.lit(0)).cast("int")
        return dataset.withColumns({**flags, "n_miss_raw": total})


class MedianImputer(Saved, Estimator):
    """Training median for columns missing in more than ``threshold`` of rows.

    With ``scope`` shares and medians are those of each combination of its columns.
    """

    def __init__(self, cols: Sequence[str] = tuple(NUMERIC_FEATURES), threshold: float = 0.30, scope: Sequence[str] = ()):
        super().__init__()
        self.cols, self.threshold, self.scope = list(cols), threshold, list(scope)

    def chosen(self, dataset) -> list[str]:
        share = dataset.groupBy(*self.scope).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in self.cols])
        most = share.agg(*[F.max(c).alias(c) for c in self.cols]).first()
        return [c for c in self.cols if (most[c] or 0.0) > self.threshold]

    def overall(self, dataset, cols):
        """Medians of the scope; null where the column is filled well enough there."""
        q = quantiles(dataset, self.scope, {f"_m_{c}": (c, 0.5) for c in cols})
        if not self.scope:
            return q
        share = dataset.groupBy(*self.scope).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"_s_{c}") for c in cols])
        own = [F.when(F.col(f"_s_{c}") > self.threshold, F.col(f"_m_{c}")).alias(f"_m_{c}") for c in cols]
        return attach(q, share, self.scope).select(*self.scope, *own)

    def _fit(self, dataset):
        cols = self.chosen(dataset)
        return CascadeImputerModel(cols, [], cut(self.overall(dataset, cols)) if cols else None, self.scope)


class GroupMedianImputer(MedianImputer):
    """Median of farm and format (10 values or more), then of the farm, then overall."""

    def __init__(self, cols=tuple(NUMERIC_FEATURES), threshold: float = 0.30, levels=(tuple(FF), (FARM,)), least: int = 10, scope: Sequence[str] = ()):
        super().__init__(cols, threshold, scope)
        self.levels, self.least = [list(x) for x in levels], least

    def _fit(self, dataset):
        cols = self.chosen(dataset)
        if not cols:
            return CascadeImputerModel([], [], None, self.scope)
        states = []
        for i, level in enumerate(self.levels):
            keys = list(dict.fromkeys([*self.scope, *level]))
            q = quantiles(dataset, keys, {f"_{i}_{c}": (c, 0.5) for c in cols})
            n = dataset.groupBy(*keys).agg(*[F.count(c).alias(f"_n_{c}") for c in cols])
            both = attach(q, n, keys)
            kept = [F.when(F.col(f"_n_{c}") >= self.least, F.col(f"_{i}_{c}")).alias(f"_{i}_{c}") for c in cols]
            states.append((keys, cut(both.select(*keys, *kept))))
        return CascadeImputerModel(cols, states, cut(self.overall(dataset, cols)), self.scope)


class CascadeImputerModel(Saved, Model):
    def __init__(self, cols, states, overall, scope: Sequence[str] = ()):
        super().__init__()
        self.cols, self.states, self.overall, self.scope = cols, states, overall, list(scope)

    def _transform(self, dataset):
        if not self.cols:
            return dataset
        out = dataset
        for keys, state in self.states:
            out = attach(out, state, keys)
        out = attach(out, self.overall, self.scope)
        # In a scope the overall median is null where the column isn't to be filled.
        fill = lambda c: [*[F.col(f"_{i}_{c}") for i in range(len(self.states))], F.col(f"_m_{c}")]
        if self.scope:
            filled = {c: F.when(F.col(c).isNull() & F.col(f"_m_{c}").isNotNull(), F.coalesce(*fill(c))).otherwise(F.col(c)) for c in self.cols}
        else:
            filled = {c: F.coalesce(F.col(c), *fill(c)) for c in self.cols}
        return out.withColumns(filled).select(*dataset.columns)


class OutlierCapper(Saved, Estimator):
    """Clip to IQR fences or to quantiles, by the most specific group that is big enough.

    With ``scope`` groups lie inside each combination of its columns, which has bounds of its own.
    """

    def __init__(self, cols=tuple(NUMERIC_FEATURES), method: str = "iqr", factor: float = 1.5, low: float = 0.01, high: float = 0.99, group: Sequence[str] = (), least: int = 30, scope: Sequence[str] = ()):
        super().__init__()
        self.scope = list(scope)
        if method not in ("iqr", "percentile"):
            raise ValueError(f"unknown method {method}")
        self.cols, self.method, self.factor = list(cols), method, factor
        self.low, self.high, self.group, self.least = low, high, [c for c in group if c not in scope], least

    def bounds(self, dataset: DataFrame, keys: Sequence[str], tag: str) -> DataFrame:
        lo, hi = (0.25, 0.75) if self.method == "iqr" else (self.low, self.high)
        spec = {}
        for c in self.cols:
            spec.update({f"_a_{c}": (c, lo), f"_b_{c}": (c, hi)})
        q = quantiles(dataset, keys, spec)
        out = []
        for c in self.cols:
            a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
            pad = (b - a) * self.factor if self.method == "iqr" else F.lit(0.0)
            out += [(a - pad).alias(f"_lo{tag}_{c}"), (b + pad).alias(f"_hi{tag}_{c}")]
        q = q.select(*keys, *out)
        if len(keys) > len(self.scope):
            big = dataset.groupBy(*keys).count().where(F.col("count") >= self.least).drop("count")
            q = attach(big, q, keys)
        return q

    def _fit(self, dataset):
        states = []
        for size in range(len(self.group), 0, -1):
            keys = [*self.scope, *self.group[:size]]
            states.append((keys, cut(self.bounds(dataset, keys, str(size)))))
        return OutlierCapperModel(self.cols, states, cut(self.bounds(dataset, self.scope, "0")), self.scope)


class OutlierCapperModel(Saved, Model):
    def __init__(self, cols, states, overall, scope: Sequence[str] = ()):
        super().__init__()
        self.cols, self.states, self.overall, self.scope = cols, states, overall, list(scope)

    def with_bounds(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for keys, state in self.states:
            out = attach(out, state, keys)
        return attach(out, self.overall, self.scope)

    def _transform(self, dataset):
        out = self.with_bounds(dataset)
        tags = [str(len(keys) - len(self.scope)) for keys, _ in self.states] + ["0"]
        clipped = {}
        for c in self.cols:
            low = F.coalesce(*[F.col(f"_lo{t}_{c}") for t in tags])
            high = F.coalesce(*[F.col(f"_hi{t}_{c}") for t in tags])
            clipped[c] = F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), low), high))
        return out.withColumns(clipped).select(*dataset.columns)


def count_outliers(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts outside 1.5 IQR, |z| > 3 and robust z > 3.5, per column (and group)."""
    from furrow.functions.stats import melt

    by = list(by)
    long = melt(df, by, cols)
    keys = [*by, "variable"]
    hot = is_hot(long, keys)
    q = quantiles(long, keys, {"q1": ("value", 0.25), "med": ("value", 0.5), "q3": ("value", 0.75)}, hot=hot)
    s = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    state = cut(attach(q, s, keys)) if hot else attach(q, s, keys)
    with_state = attach(long, state, keys).withColumn("dev", F.abs(F.col("value") - F.col("med")))
    mad = quantiles(with_state, keys, {"mad": ("dev", 0.5)}, hot=hot)
    full = attach(with_state, mad, keys)
    iqr = F.col("q3") - F.col("q1")
    fence = (F.col("value") < F.col("q1") - 1.5 * iqr) | (F.col("value") > F.col("q3") + 1.5 * iqr)
    z = F.abs(F.try_divide(F.col("value") - F.col("mean"), F.col("sd"))) > 3.0
    m = F.abs(F.try_divide(0.6745 * (F.col("value") - F.col("med")), F.col("mad"))) > 3.5
    return full.groupBy(*keys).agg(
        F.count_if(fence).alias("n_iqr"), F.count_if(z).alias("n_zscore"), F.count_if(m).alias("n_mad")
    )


class VarianceFilter(Saved, Estimator):
    """Drop numeric columns whose value never changes."""

    def __init__(self, keep: Sequence[str] = ()):
        super().__init__()
        self.keep = list(keep)

    def _fit(self, dataset):
        numeric = [n for n, t in dataset.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") and n not in self.keep]
        if not numeric:
            return ColumnDropper([])
        row = dataset.agg(*[(F.min(c) < F.max(c)).alias(c) for c in numeric]).first()
        return ColumnDropper([c for c in numeric if not row[c]])


class ColumnDropper(Saved, Model):
    def __init__(self, drop: Sequence[str]):
        super().__init__()
        self.dropped = list(drop)

    def _transform(self, dataset):
        return dataset.drop(*self.dropped)
