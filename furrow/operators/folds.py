"""Fold assignment and sample weights; repeatable by hash, independent of partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.columns import DATE, FARM, FORMAT, MISSING, RARE, ROW_ID, TARGET
from furrow.functions.scalar import hash_order, width_bin_right
from furrow.operators.features import derive_season_months
from furrow.operators.groups import attach, quantiles
from furrow.operators.ordered import position
from furrow.session import cut, hot_rows

# Peak months used when a variety declares and shows none.
PEAK_MONTHS = (8, 9, 10)
# Hexadecimal digits of the hash by which rows are dealt to buckets.
HASH_DIGITS = 3


def kfold(df: DataFrame, k: int = 5, seed: int = 42, by: Sequence[str] = (), row_id: str = ROW_ID, name: str = "fold_id") -> DataFrame:
    """Shuffled folds of equal size (to one row) in every group of ``by``.

    Rows are counted by the first digits of their hash. In a huge group these buckets are
    ordered each by itself, and a row's place is that in its bucket after the rows of lower ones.
    """
    by = list(by)
    digits = F.substring(hash_order(F.col(row_id), seed), 1, HASH_DIGITS)
    # At most 16 ** HASH_DIGITS buckets a group, and one of rows without an id.
    counts = cut(df.groupBy(*by, digits.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")))
    biggest, bucket = counts.groupBy(*by).agg(F.sum("_n").alias("n"), F.max("_n").alias("b")).agg(F.max("n"), F.max("b")).first()
    limit, order = hot_rows(df.sparkSession), [hash_order(F.col(row_id), seed), F.col(row_id)]
    if (biggest or 0) <= limit or bucket > limit:
        shuffled = position(df, by, order, "_pos", hot=(biggest or 0) > limit)
    else:
        lower = (Window.partitionBy(*by) if by else Window).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        before = cut(counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before")))
        inside = position(df.withColumn("_bucket", digits), [*by, "_bucket"], order, "_pos", hot=False)
        shuffled = attach(inside, before, [*by, "_bucket"]).withColumn("_pos", F.col("_pos") + F.col("_before")).drop("_bucket", "_before")
    return shuffled.withColumn(name, ((F.col("_pos") - 1) % k).cast("int")).drop("_pos")


def stratified_kfold(df: DataFrame, label: str, k: int = 5, seed: int = 42, by: Sequence[str] = (), row_id: str = ROW_ID, name: str = "fold_id") -> DataFrame:
    """Folds balanced per label."""
    return kfold(df, k, seed, [*by, label], row_id, name)


def stratify_label(df: DataFrame, min_count: int, by: Sequence[str] = (), farm: str = FARM, fmt: str = FORMAT) -> DataFrame:
    """Adds ``strat_label`` and ``strategy``: farm_format, farm, format, or none.

    Rare classes merge into ``RARE``; a candidate is valid with at least two classes that
    all reach ``min_count``. Everything is decided from counts per farm and format.
    """
    by = list(by)
    a, b = (F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in (farm, fmt))
    candidates = {"farm_format": F.concat_ws("_", a, b), "farm": a, "format": b}
    marked = df.withColumns({f"_l_{n}": e for n, e in candidates.items()})
    pairs = marked.groupBy(*by, *[f"_l_{n}" for n in candidates]).agg(F.count(F.lit(1)).alias("_c"))
    for n in candidates:
        level = pairs.groupBy(*by, f"_l_{n}").agg(F.sum("_c").alias(f"_c_{n}"))
        rare = F.col(f"_c_{n}") < min_count
        test = level.groupBy(*by).agg(
            F.count_if(~rare).alias("_big"), F.coalesce(F.sum(F.when(rare, F.col(f"_c_{n}"))), F.lit(0)).alias("_rare")
        )
        classes = F.col("_big") + (F.col("_rare") > 0).cast("int")
        ok = (classes >= 2) & ((F.col("_rare") == 0) | (F.col("_rare") >= min_count))
        test = test.select(*by, ok.alias(f"_ok_{n}"))
        marked = attach(attach(marked, level, [*by, f"_l_{n}"]), test, by)
        marked = marked.withColumn(f"_l_{n}", F.when(F.col(f"_c_{n}") < min_count, RARE).otherwise(F.col(f"_l_{n}")))

    def pick(values: dict[str, Column]) -> Column:
        out = None
        for n in candidates:
            out = F.when(F.col(f"_ok_{n}"), values[n]) if out is None else out.when(F.col(f"_ok_{n}"), values[n])
        return out

    return marked.select(
        *df.columns,
        pick({n: F.col(f"_l_{n}") for n in candidates}).alias("strat_label"),
        F.coalesce(pick({n: F.lit(n) for n in candidates}), F.lit("none")).alias("strategy"),
    )


def temporal_year_split(df: DataFrame, k: int = 3, min_train_years: int = 2, by: Sequence[str] = (), date: str = DATE) -> DataFrame:
    """Expanding window by year: one copy of a row per fold where it trains or tests."""
    by = list(by)
    years = df.select(*by, F.year(date).alias("_y")).distinct().groupBy(*by).agg(F.sort_array(F.collect_list("_y")).alias("_years"))
    out = attach(df, years, by)
    n = F.size("_years")
    folds = F.least(F.lit(k), F.greatest(n - min_train_years, F.lit(0)))
    tests = F.when(folds > 0, F.slice(F.col("_years"), n - folds + 1, folds)).otherwise(F.array().cast("array<int>"))
    out = out.select(*df.columns, F.posexplode(tests).alias("fold", "test_year"))
    year = F.year(date)
    role = F.when(year < F.col("test_year"), "train").when(year == F.col("test_year"), "test")
    return out.withColumn("role", role).where(F.col("role").isNotNull())


def purged_date_split(df: DataFrame, k: int = 3, gap: int = 1, min_train: int = 30, min_test: int = 10, by: Sequence[str] = (), date: str = DATE) -> DataFrame:
    """Expanding window over distinct dates with a purged gap; a date is never split."""
    by = list(by)
    days = df.select(*by, date).distinct()
    # One row per calendar day and group bounds this window.
    w = Window.partitionBy(*by).orderBy(date) if by else Window.orderBy(date)
    ranked = days.withColumn("_i", F.row_number().over(w) - 1)
    total = days.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    out = attach(attach(df, ranked, [*by, date]), total, by)
    room = F.col("_n") - min_train - gap
    folds = F.least(F.lit(k), F.greatest(F.floor(room / min_test), F.lit(0))).cast("int")
    size = F.greatest(F.lit(min_test), F.floor(F.try_divide(room, folds))).cast("int")
    out = out.withColumn("_k", folds).withColumn("_size", F.when(folds > 0, size).otherwise(0))
    every = F.when(F.col("_k") > 0, F.sequence(F.lit(0), F.col("_k") - 1)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("fold", F.explode(every))
    start = F.col("_n") - F.col("_k") * F.col("_size") + F.col("fold") * F.col("_size")
    end = F.when(F.col("fold") == F.col("_k") - 1, F.col("_n")).otherwise(start + F.col("_size"))
    train_end = start - gap
    role = F.when(F.col("_i") < train_end, "train").when((F.col("_i") >= start) & (F.col("_i") < end), "test")
    out = out.withColumn("role", F.when(train_end >= min_train, role)).where(F.col("role").isNotNull())
    return out.select(*df.columns, "fold", "role")


def recent_window(df: DataFrame, days: int | None, reference: Column, date: str = DATE) -> DataFrame:
    """Rows on or after ``reference - days``; None keeps everything."""
    return df if days is None else df.where(F.col(date) >= F.date_sub(reference, days))


def temporal_tail_holdout(df: DataFrame, by: Sequence[str] = (), date: str = DATE, row_id: str = ROW_ID, share: float = 0.10, least: int = 12, name: str = "is_val") -> DataFrame:
    """Marks the last max(10 %, 12) rows, at most a third, as validation."""
    by = list(by)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    out = attach(position(df, by, [F.col(date), F.col(row_id)], "_pos"), n, by)
    val = F.greatest(F.least(F.greatest(F.floor(F.col("_n") * share), F.lit(least)), F.floor(F.col("_n") / 3)), F.lit(1))
    return out.withColumn(name, F.col("_pos") > F.col("_n") - val).drop("_pos", "_n")


def adapt_folds(n: Column, outer: int, inner: int, rows_outer: int = 120, rows_inner: int = 150) -> dict[str, Column]:
    """Outer and inner fold counts, reduced for small n, never below 2."""
    o = F.greatest(F.lit(2), F.least(F.lit(outer), F.floor(n / rows_outer)))
    left = F.floor(n * (o - 1) / o)
    i = F.greatest(F.lit(2), F.least(F.lit(inner), F.floor(left / rows_inner)))
    keep = n <= 0
    return {
        "outer_folds": F.when(keep, F.lit(outer)).otherwise(o).cast("int"),
        "inner_folds": F.when(keep, F.lit(inner)).otherwise(i).cast("int"),
    }


def mean_one(df: DataFrame, col: str, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Weights scaled to mean 1 in every group."""
    by = list(by)
    mean = df.groupBy(*by).agg(F.avg(col).alias("_mean"))
    return attach(df, mean, by).withColumn(name or col, F.col(col) / F.col("_mean")).drop("_mean")


def density_weights(df: DataFrame, y: str = TARGET, bins: int = 20, cap: float = 5.0, per_bin: int = 40, by: Sequence[str] = (), name: str = "w_density") -> DataFrame:
    """Inverse count of the equal-width target bin, capped, square-rooted, mean 1.

    Weights are worked out on the bin table (at most ``bins`` rows per group).
    """
    by = list(by)
    span = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(y).alias("_lo"), F.max(y).alias("_hi"))
    marked = attach(df, span, by)
    used = F.least(F.lit(bins), F.greatest(F.lit(3), F.floor(F.col("_n") / per_bin)))
    bin_no = F.coalesce(width_bin_right(F.col(y), F.col("_lo"), F.col("_hi"), used), F.lit(-1))
    marked = marked.withColumn("_bin", bin_no)
    table = marked.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    table = table.withColumn("_w", F.when(F.col("_bin") == -1, F.lit(1.0)).otherwise(1.0 / F.col("_c")))
    mean = table.groupBy(*by).agg((F.sum(F.col("_w") * F.col("_c")) / F.sum("_c")).alias("_m"))
    table = attach(table, mean, by).withColumn("_w", F.sqrt(F.least(F.col("_w"), F.col("_m") * cap)))
    final = table.groupBy(*by).agg((F.sum(F.col("_w") * F.col("_c")) / F.sum("_c")).alias("_f"))
    table = attach(table, final, by).select(*by, "_bin", (F.col("_w") / F.col("_f")).alias(name))
    return attach(marked, table, [*by, "_bin"]).select(*df.columns, name)


def inverse_target_weights(df: DataFrame, y: str = TARGET, cap: float = 5.0, by: Sequence[str] = (), name: str = "w_inverse") -> DataFrame:
    """median / y clipped to [1/cap, cap]; no positive target gives 1; mean 1."""
    by = list(by)
    valid = F.when(F.col(y) > 0, F.col(y).cast("double"))
    marked = df.withColumn("_y", valid)
    med = quantiles(marked, by, {"_ref": ("_y", 0.5)})
    raw = F.coalesce(F.col("_ref") / F.col("_y"), F.lit(1.0))
    out = attach(marked, med, by).withColumn(name, F.least(F.greatest(raw, F.lit(1.0 / cap)), F.lit(cap)))
    return mean_one(out, name, by).select(*df.columns, name)


def season_boost(df: DataFrame, months: Sequence[int] | None = None, factor: float = 1.5, y: str = TARGET, by: Sequence[str] = (), date: str = DATE, name: str = "w_season") -> DataFrame:
    """Heavier peak months, given or derived from the target; mean 1."""
    by = list(by)
    month = F.month(date)
    if months is None:
        peak = derive_season_months(df, date, y, by).select(*by, F.col("high").alias("_peak"))
        marked = attach(df, peak, by)
        months_of = F.coalesce(F.col("_peak"), F.array(*[F.lit(m) for m in PEAK_MONTHS]))
        hit = F.array_contains(months_of, month)
    else:
        marked, hit = df, month.isin(list(months))
    marked = marked.withColumn(name, F.when(hit, F.lit(float(factor))).otherwise(F.lit(1.0)))
    return mean_one(marked, name, by).select(*df.columns, name)


def combine_weights(df: DataFrame, layers: Sequence[str], by: Sequence[str] = (), name: str = "sample_weight") -> DataFrame:
    """Product of the layers, mean 1."""
    product = F.lit(1.0)
    for layer in layers:
        product = product * F.coalesce(F.col(layer), F.lit(1.0))
    return mean_one(df.withColumn(name, product), name, by)
