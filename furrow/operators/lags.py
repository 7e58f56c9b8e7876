"""Leak-safe history features: every frame ends before the current row or day."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from furrow.columns import COLD, DATE, FARM, FF, FORMAT, ROW_ID, SLOPE_COLD, TARGET, VALUE
from furrow.functions.scalar import log_positive, log_signed, safe_ratio
from furrow.operators.groups import attach, is_hot, quantiles
from furrow.operators.ordered import row_frames
from furrow.session import hot_rows

# Window lengths, minimum history, season band.
WINDOWS = (7, 14, 30, 90)
MIN_PERIODS = 3
MOMENTUM = 30
PERIOD, TOLERANCE = 365, 15
LEVELS = {"FF": [FARM, FORMAT], "F": [FARM], "FMT": [FORMAT]}

DAY_MICROS = 86_400_000_000


def row_order(date: str = DATE, row_id: str = ROW_ID) -> list[Column]:
    return [F.col(date), F.col(row_id)]


def rolling_medians(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    columns: dict[str, tuple[str, int]],
    extra: dict | None = None,
    extra_back: int = 0,
    hot: bool | None = None,
    first: str | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Medians of the previous k rows, ``{name: (value column, k)}``; at least 3 non-null.

    One window numbers the rows of a group; frames of all lengths are sorted in blocks of
    rows, as Arrow batches. ``extra`` adds window columns that share the same partitioning
    and sort; ``first`` and ``base`` are those of ``row_frames``.
    """
    # Positions and values go to the tasks' Python in batches, in order; the last rows of a
    # batch are kept for the next, so a group of any size streams through.
    values = list(dict.fromkeys(v for v, _ in columns.values()))
    slots = {pair: i for i, pair in enumerate(dict.fromkeys(columns.values()))}
    back = max([*(k for _, k in slots), extra_back, 1])
    jobs = [(values.index(v), k) for v, k in slots]
    found = _frame_medians(jobs)(F.col("_p"), *[F.col(f"`{v}`").cast("double") for v in values]).alias("_m")

    def finish(rows):
        return rows.select("*", found).select("*", *[F.col("_m")[f"m{slots[pair]}"].alias(name) for name, pair in columns.items()])

    frames = {"_p": lambda w: F.row_number().over(w), **(extra or {})}
    framed = row_frames(df, keys, order, back, frames, hot=hot, first=first, base=base, finish=finish, added=columns)
    return framed.select(*df.columns, *(extra or {}), *columns)


# Rows whose frames are sorted at a time.
FRAME_ROWS = 4_096


def _frame_medians(jobs: Sequence[tuple[int, int]]):
    """Medians of the previous k rows for each (value, k) of ``jobs``, of rows in window order.

    The first argument is the position in the group, from 1. What follows depends on the rows
    before, so the result is declared nondeterministic: no filter moves below it.
    """
    kind = pa.struct([(f"m{i}", pa.float64()) for i in range(len(jobs))])
    longest = max(k for _, k in jobs)

    def run(batches):
        kept = None
        for position, *values in batches:
            before = np.minimum(position.to_numpy(zero_copy_only=False).astype(np.int64) - 1, longest)
            # Nulls are NaN, which sort last; given NaN count as values, nulls do not.
            x = [np.asarray(v.to_numpy(zero_copy_only=False), np.float64) for v in values]
            null = [v.is_null().to_numpy(zero_copy_only=False) if v.null_count else np.zeros(len(v), bool) for v in values]
            if kept is None:
                kept = [(np.full(longest, np.nan), np.ones(longest, bool)) for _ in values]
            x = [np.concatenate([k[0], v]) for k, v in zip(kept, x, strict=True)]
            null = [np.concatenate([k[1], v]) for k, v in zip(kept, null, strict=True)]
            kept = [(v[-longest:], n[-longest:]) for v, n in zip(x, null, strict=True)]
            yield pa.StructArray.from_arrays([frame_medians(x[i][longest - k :], null[i][longest - k :], np.minimum(before, k), k) for i, k in jobs], fields=list(kind))

    def typed(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return run(batches)

    return F.arrow_udf(typed, ", ".join(f"m{i} double" for i in range(len(jobs)))).asNondeterministic()


def frame_medians(x: np.ndarray, null: np.ndarray, before: np.ndarray, k: int) -> pa.Array:
    """Median of the ``before`` values, at most k, in front of each place from k on; null below three."""
    n_rows = len(before)
    windows = np.lib.stride_tricks.sliding_window_view(x, k)[:n_rows] if n_rows else np.empty((0, k))
    holes = np.append(0, np.cumsum(null))
    end = np.arange(n_rows) + k
    n = before - (holes[end] - holes[end - before])
    out = np.full(n_rows, np.nan)
    for start in range(0, n_rows, FRAME_ROWS):
        stop = min(start + FRAME_ROWS, n_rows)
        some, size = np.array(windows[start:stop]), n[start:stop]
        short = np.flatnonzero(before[start:stop] < k)
        if len(short):
            # Rows of the group before are not in the frame.
            some[short] = np.where(np.arange(k) >= k - before[start:stop][short][:, None], some[short], np.nan)
        some.sort(axis=1)
        at = np.arange(stop - start)
        low, high = np.maximum((size - 1) // 2, 0), np.minimum(size // 2, k - 1)
        out[start:stop] = (some[at, low] + some[at, high]) / 2
    return pa.array(out, mask=n < MIN_PERIODS)


def rolling_median(df, keys, value=VALUE, k=30, name=None, order=None) -> DataFrame:
    return rolling_medians(df, keys, order or row_order(), {name or f"{value}_lag_{k}": (value, k)}, first=None if order else DATE)


def daily_median(df: DataFrame, keys: Sequence[str], values: Sequence[str], date: str = DATE) -> DataFrame:
    """One point per group and day."""
    return quantiles(df, [*keys, date], {v: (v, 0.5) for v in values})


def join_daily(df: DataFrame, daily: DataFrame, keys: Sequence[str], date: str = DATE) -> DataFrame:
    """Bring per-day columns to the rows of that group and day."""
    return attach(df, daily, [*keys, date])


def rolling_medians_exante(df, keys, columns: dict[str, tuple[str, int]], date: str = DATE, base: DataFrame | None = None) -> DataFrame:
    """Frames over previous *days*: the whole current day stays out.

    ``base`` holds the same rows without the columns added since.
    """
    values = sorted({v for v, _ in columns.values()})
    daily = daily_median(df if base is None else base, keys, values, date)
    # A group has one point per calendar day, which bounds its window.
    lagged = rolling_medians(daily, keys, [F.col(date)], columns, hot=False)
    return join_daily(df, lagged.drop(*values), keys, date)


def _std(value: str, k: int):
    def build(w):
        f = w.rowsBetween(-k, -1)
        return F.when(F.count(value).over(f) >= MIN_PERIODS, F.stddev_samp(value).over(f))

    return build


def rolling_std(df, keys, value=VALUE, k=MOMENTUM, name=None, order=None) -> DataFrame:
    return row_frames(df, keys, order or row_order(), k, {name or f"{value}_std_{k}": _std(value, k)}, first=None if order else DATE)


def rolling_slope(df, keys, value=VALUE, k=MOMENTUM, name=None, order=None, hot=None, first=None, base=None) -> DataFrame:
    """OLS slope of the previous k rows against their position; nulls keep their place."""
    order = order or row_order()
    name = name or f"{value}_slope_{k}"
    # The slope does not change when positions shift, so the row number of the group
    # (or of the chunk, in a huge group) serves as the position.
    y = F.col(value).cast("double")
    y = F.when(~F.isnan(y), y)

    def slope(w):
        f = w.rowsBetween(-k, -1)
        return F.when(F.count(y).over(f) >= MIN_PERIODS, F.regr_slope(y, F.col("_x").cast("double")).over(f))

    return row_frames(df, keys, order, k, {name: slope}, hot=hot, first=first, base=base, number="_x")


def days_since_last(df, keys, name="days_since_last", date=DATE, row_id=ROW_ID) -> DataFrame:
    gap = {name: lambda w: F.datediff(F.col(date), F.lag(date, 1).over(w)).cast("double")}
    return row_frames(df, keys, row_order(date, row_id), 1, gap, first=date)


def tenure_days(df, keys, name="tenure_days", date=DATE, base: DataFrame | None = None) -> DataFrame:
    """Days since the first date of the group (an aggregate, no window)."""
    first = (df if base is None else base).groupBy(*keys).agg(F.min(date).alias("_first"))
    return attach(df, first, keys).select(
        *df.columns, F.datediff(F.col(date), F.col("_first")).cast("double").alias(name)
    )


def serving_tenure(new, first_seen, key: str | Sequence[str] = FARM, name="tenure_days", date=DATE) -> DataFrame:
    """Tenure from the fitted first-seen table; unseen groups get 0."""
    return attach(new, first_seen, [key] if isinstance(key, str) else list(key)).select(
        *new.columns,
        F.coalesce(F.datediff(F.col(date), F.col("first_seen")).cast("double"), F.lit(0.0)).alias(name),
    )


def simple_lags(df, keys, value=TARGET, prefix=None, order=None) -> DataFrame:
    """Previous two values and their difference."""
    p = prefix or value
    out = row_frames(
        df,
        keys,
        order or row_order(),
        2,
        {f"{p}_lag_1": lambda w: F.lag(value, 1).over(w), f"{p}_lag_2": lambda w: F.lag(value, 2).over(w)},
    )
    return out.withColumn(f"{p}_diff_1", F.col(f"{p}_lag_1") - F.col(f"{p}_lag_2"))


def seasonal_median(
    df, keys, columns: dict[str, tuple[str, int]], tol: int = TOLERANCE, date=DATE, hot=None, base: DataFrame | None = None
) -> DataFrame:
    """Median in the band ``[date - period - tol, date - period + tol]``.

    ``{name: (value column, period in days)}``. Rows are counted, at least three; a null
    value inside the band makes the result null, as does a null date. Where bands hold few
    rows, a range window collects each, and rows are shuffled once by their group; otherwise
    values are counted and a window slides over days (``hot`` forces this form). ``base``
    holds the same rows without the columns added since.
    """
    base = df if base is None else base
    if not hot and _thin_bands(base, keys, 2 * tol + 1, date):
        return _collected_bands(df, keys, columns, tol, date)
    return join_daily(df, band_medians(base, base, keys, columns, tol, date), keys, date)


# Rows of the largest group, and of the mean band, up to which bands are collected row by row.
THIN_ROWS, THIN_BAND = 20_000, 200


def _thin_bands(base: DataFrame, keys: Sequence[str], width: int, date=DATE) -> bool:
    """Whether groups are small and ``width`` days of them hold few rows on average."""
    day = F.unix_date(F.col(date))
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), (F.max(day) - F.min(day) + 1).alias("_span"))
    n = F.col("_n").cast("double")
    share = F.least(F.lit(1.0), F.lit(float(width)) / F.col("_span"))
    got = sizes.agg(F.max("_n"), F.sum(n * n * F.coalesce(share, F.lit(1.0))) / F.sum(n)).first()
    return (got[0] or 0) <= min(THIN_ROWS, hot_rows(base.sparkSession)) and (got[1] or 0.0) <= THIN_BAND


def _collected_bands(df: DataFrame, keys: Sequence[str], columns: dict[str, tuple[str, int]], tol: int, date=DATE) -> DataFrame:
    """Each row's band as a sorted array of a range window; nulls are NaN, which sort last."""
    by_day = Window.partitionBy(*keys).orderBy(F.unix_date(F.col(date)))
    slots = {pair: i for i, pair in enumerate(dict.fromkeys(columns.values()))}
    bands = [F.collect_list(F.coalesce(F.col(v).cast("double"), F.lit(float("nan")))).over(by_day.rangeBetween(-(p + tol), -(p - tol))).alias(f"_b{i}") for (v, p), i in slots.items()]
    # Sorted bands are columns of their own, so that each is sorted once.
    out = df.select("*", *bands).select(*df.columns, *[F.sort_array(f"_b{i}").alias(f"_b{i}") for i in slots.values()])

    def middle(i):
        band = F.col(f"_b{i}")
        n = F.size(band)
        low, high = (F.get(band, F.floor(at).cast("int")) for at in ((n - 1) / 2, n / 2))
        whole = F.col(date).isNotNull() & (n >= MIN_PERIODS) & ~F.isnan(F.get(band, n - 1))
        return F.when(whole, F.when(low == high, low).otherwise((low + high) / 2))

    return out.select(*df.columns, *[middle(slots[pair]).alias(name) for name, pair in columns.items()])


def seasonal_range_join(
    new, history, keys, value=VALUE, period=PERIOD, tol=TOLERANCE, name="seasonal", date=DATE
) -> DataFrame:
    """Band median of ``history`` for each distinct (keys, day) of ``new`` whose band has a row."""
    days = band_medians(new, history, keys, {name: (value, period)}, tol, date, counts=True)
    return days.where("_n > 0").drop("_n")


# Days of targets that are handled together; history is copied to the next chunk where bands cross.
CHUNK_DAYS = 186


def band_medians(new, history, keys, columns: dict[str, tuple[str, int]], tol=TOLERANCE, date=DATE, counts=False) -> DataFrame:
    """(keys, date, names): the band median of ``history`` for each distinct (keys, day) of ``new``.

    History is counted by (keys, day, value). A window slides over the days of a group,
    adding the counts of days that enter the band and taking those that leave it, so every
    count is touched twice whatever the band's width; groups with narrow bands have them
    sorted, many groups at once. A group is cut into chunks of days; a task holds the
    distinct values of one chunk, or of a bounded number of rows of smaller ones. ``counts`` adds ``_n``, the rows of the band.
    """
    keys, names = list(keys), list(columns)
    day = F.unix_date(F.col(date))
    width = max(CHUNK_DAYS, 2 * tol + 1)
    none = lambda t: F.lit(None).cast(t)
    targets = new.where(F.col(date).isNotNull()).select(*keys, day.alias("_day")).distinct()
    tables = []
    for i, (value, period) in enumerate(columns.values()):
        low, high = F.col("_day") + (period - tol), F.col("_day") + (period + tol)
        seen = history.where(F.col(date).isNotNull()).groupBy(*keys, day.alias("_day"), F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_w"))
        at = F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
        tables.append(seen.select(*keys, F.lit(i).alias("_c"), at.alias("_chunk"), (F.col("_day") + period).alias("_day"), "_v", "_w"))
        tables.append(targets.select(*keys, F.lit(i).alias("_c"), F.floor(F.col("_day") / width).alias("_chunk"), "_day", none("double").alias("_v"), F.lit(0).cast("bigint").alias("_w")))
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    group = [*keys, "_c", "_chunk"]
    # Days are moved to the band's middle; targets have weight 0 and come first on their day.
    rows = rows.repartition(*group).sortWithinPartitions(*group, "_day", "_w")
    k = len(keys)
    schema = StructType([*[StructField(f"k{i}", new.schema[c].dataType) for i, c in enumerate(keys)], StructField("_c", IntegerType()), StructField("_day", IntegerType()), StructField("_m", DoubleType()), StructField("_n", LongType())])

    def same(a, b):
        return all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))

    def run(batches):
        # Labels and rows of the groups at hand; all but the last are complete.
        labels, held, n, last = [], [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            codes = [b.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for i in range(k + 2)]
            change = np.zeros(b.num_rows, bool)
            for c in codes:
                change[1:] |= c[1:] != c[:-1]
            change[0] = last is None or not same(last, [b.column(i)[0].as_py() for i in range(k + 2)])
            if n >= SLIDE_ROWS and change.any():
                stop = int(np.argmax(change))
                held.append(part(b, change, 0, stop, len(labels)))
                yield out(labels, held)
                labels, held, n = [], [], 0
                b, change = b.slice(stop), change[stop:]
            held.append(part(b, change, 0, b.num_rows, len(labels)))
            labels += b.select(list(range(k + 1))).take(pa.array(np.flatnonzero(change))).to_pylist()
            n += b.num_rows
            last = [b.column(i)[b.num_rows - 1].as_py() for i in range(k + 2)]
        if labels:
            yield out(labels, held)

    def part(b, change, start, end, n_labels):
        group = n_labels - 1 + np.cumsum(change[start:end])
        return (group, *(b.column(k + i).slice(start, end - start).to_numpy(zero_copy_only=False) for i in (2, 3, 4)))

    kinds = [to_arrow_type(new.schema[c].dataType) for c in keys]

    def out(labels, held):
        group, days, medians, sizes = slide_groups(*(np.concatenate(x) for x in zip(*held, strict=True)), tol)
        columns = [list(x) for x in zip(*(row.values() for row in labels), strict=True)]
        arrays = [pa.array(columns[i], kinds[i]).take(pa.array(group)) for i in range(k)]
        arrays += [pa.array(np.array(columns[k], np.int32)[group]), pa.array(days.astype(np.int32)), pa.array(medians, mask=(sizes < MIN_PERIODS) | np.isnan(medians)), pa.array(sizes)]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    found = rows.mapInArrow(run, schema).toDF(*keys, "_c", "_day", "_m", "_n")
    wide = found.groupBy(*keys, "_day").agg(*[F.max(F.when(F.col("_c") == i, F.col("_m"))).alias(n) for i, n in enumerate(names)], F.max("_n").alias("_n"))
    return wide.select(*keys, F.date_from_unix_date("_day").alias(date), *names, *(["_n"] if counts else []))


# Rows of groups that are handled together, pairs of days and values sorted together, and the
# mean size of a band from which sliding costs less than sorting each band.
SLIDE_ROWS, SLIDE_PAIRS, SLIDE_BAND = 200_000, 2_000_000, 500


def slide_groups(group: np.ndarray, day: np.ndarray, value: np.ndarray, weight: np.ndarray, tol: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, target day, median, rows in the band) of many groups' counts, sorted by group and day.

    The bands of all sparse groups are sorted in one go; a dense group slides by itself.
    """
    is_target = weight == 0
    first = int(day.min())
    span = int(day.max()) - first + 2 * tol + 2
    place = group.astype(np.int64) * span + (day.astype(np.int64) - first)
    targets = np.unique(place[is_target])
    order = np.argsort(place[~is_target], kind="stable")
    axis, v, w = (x[~is_target][order] for x in (place, value, weight))
    low, high = np.searchsorted(axis, targets - tol, side="left"), np.searchsorted(axis, targets + tol, side="right")
    at, empty = targets // span, np.isnan(v)
    run_w, run_e = np.append(0, np.cumsum(w)), np.append(0, np.cumsum(empty))
    medians, sizes = np.full(len(targets), np.nan), (run_w[high] - run_w[low]).astype(np.int64)
    full = (sizes > 0) & (run_e[high] == run_e[low])
    band = np.where(full, high - low, 0)
    n_groups = int(group.max()) + 1
    wide = np.bincount(at, band, n_groups) > SLIDE_BAND * np.maximum(np.bincount(at, full, n_groups), 1)
    for g in np.flatnonzero(wide):
        a, b = np.searchsorted(group, [g, g + 1])
        here = at == g
        medians[here] = slide_medians(day[a:b], value[a:b], weight[a:b], tol)[1]
    todo = np.flatnonzero(full & ~wide[at])
    ends = np.cumsum(band[todo])
    begin = 0
    while begin < len(todo):
        end = max(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLIDE_PAIRS, side="right")), begin + 1)
        some = todo[begin:end]
        m = band[some]
        offset = np.append(0, np.cumsum(m))
        owner = np.repeat(np.arange(len(some)), m)
        index = np.arange(offset[-1]) - np.repeat(offset[:-1] - low[some], m)
        index = index[np.lexsort((v[index], owner))]
        x, run = v[index], np.append(0, np.cumsum(w[index]))
        before, n = run[offset[:-1]], sizes[some]
        lower, upper = (x[np.searchsorted(run[1:], before + i, side="right")] for i in ((n - 1) // 2, n // 2))
        with np.errstate(invalid="ignore"):
            medians[some] = np.where(lower != upper, (lower + upper) / 2, lower)
        begin = end
    return at, targets - at * span + first, medians, sizes


def slide_medians(day: np.ndarray, value: np.ndarray, weight: np.ndarray, tol: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target days, medians, rows in the band) of one group's counts; weight 0 marks a target.

    Values are places in a sorted axis; counts are kept by place and by blocks of places, so
    a day costs what enters and leaves and one look at about the square root of the axis.
    """
    is_target = weight == 0
    targets = np.unique(day[is_target])
    order = np.argsort(day[~is_target], kind="stable")
    day, value, weight = (x[~is_target][order] for x in (day, value, weight))
    empty = np.isnan(value)
    axis, place = np.unique(value[~empty], return_inverse=True)
    place_all = np.full(len(value), -1)
    place_all[~empty] = place
    size = max(1, int(np.sqrt(len(axis))))
    cells, blocks = np.zeros(len(axis), np.int64), np.zeros(len(axis) // size + 1, np.int64)
    holes = total = 0
    medians, sizes = np.full(len(targets), np.nan), np.zeros(len(targets), np.int64)
    enter, leave = np.searchsorted(day, targets + tol, side="right"), np.searchsorted(day, targets - tol, side="left")
    first = last = 0

    def at(k):
        c = np.cumsum(blocks)
        b = int(np.searchsorted(c, k, side="right"))
        inside = np.cumsum(cells[b * size : (b + 1) * size])
        return axis[b * size + int(np.searchsorted(inside, k - (c[b - 1] if b else 0), side="right"))]

    for i in range(len(targets)):
        for a, b, sign in ((last, enter[i], 1), (first, leave[i], -1)):
            if b > a:
                p, w = place_all[a:b], sign * weight[a:b]
                ok = p >= 0
                np.add.at(cells, p[ok], w[ok])
                np.add.at(blocks, p[ok] // size, w[ok])
                total += int(w.sum())
                holes += int(w[~ok].sum())
        last, first = max(last, enter[i]), max(first, leave[i])
        sizes[i] = total
        if total and not holes:
            low, high = at((total - 1) // 2), at(total // 2)
            medians[i] = (low + high) / 2 if low != high else low
    return targets, medians, sizes


def asof_prior_day(new, state, keys, columns: Sequence[str], date=DATE) -> DataFrame:
    """Newest state strictly before each row's day.

    Runs at the grain of one row per group and day, which bounds the window.
    """
    marks = new.select(*keys, date).distinct().select(*keys, date, F.lit(None).alias("_s"))
    facts = state.select(*keys, date, F.struct(*columns).alias("_s"))
    marks = marks.withColumn("_s", F.lit(None).cast(facts.schema["_s"].dataType))
    days = marks.unionByName(facts).groupBy(*keys, date).agg(F.max("_s").alias("_s"))
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    found = days.select(*keys, date, F.last("_s", ignorenulls=True).over(w).alias("_s"))
    joined = attach(new, found, [*keys, date])
    return joined.select(*new.columns, *[F.col(f"_s.{c}").alias(f"prior_{c}") for c in columns])


def relative_to_global(df, value=VALUE, k=30, within: Sequence[str] = (), name=None, order=None, base=None) -> DataFrame:
    """Value over the median of the previous k rows of *all* groups in date order."""
    name = name or f"{value}_rel_global_{k}"
    out = rolling_medians(df, list(within), order or row_order(), {"_g": (value, k)}, first=None if order else DATE, base=base)
    return out.select(*df.columns, safe_ratio(F.col(value), F.col("_g")).alias(name))


def rolling_time_mean(df, keys, value, days=30, min_rows=5, name="rolling_mean", date=DATE) -> DataFrame:
    """Mean over the last ``days`` days including today, from per-day sums and counts."""
    daily = df.groupBy(*keys, date).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(F.unix_date(F.col(date))).rangeBetween(-(days - 1), 0)
    n = F.sum("_c").over(w)
    mean = daily.select(*keys, date, F.when(n >= min_rows, F.sum("_s").over(w) / n).alias(name))
    return join_daily(df, mean, keys, date)


def centered_moving_average(df, keys, order, value, k=7, name="centered_mean") -> DataFrame:
    """Mean of the k/2 rows on both sides, shrinking at the ends."""
    half = k // 2
    return row_frames(
        df, keys, order, half, {name: lambda w: F.avg(value).over(w.rowsBetween(-half, half))}, ahead=half
    )


@dataclass
class LagFlags:
    """Optional feature blocks, frozen when the state is fitted."""

    simple_lags: bool = False
    target_volatility: bool = False
    feature_lags: bool = False
    seasonal_2y: bool = False
    log_derived: bool = False
    exante: bool = False
    feature_columns: tuple[str, ...] = ("p_baya", "dpc")


def lag_columns(flags: LagFlags | None = None) -> list[str]:
    """Columns that :func:`lag_features` adds, in order."""
    f = flags or LagFlags()
    cols = [f"{v}_lag_{a}_{k}" for a in LEVELS for v in (TARGET, VALUE) for k in WINDOWS]
    if f.simple_lags:
        cols += [f"{TARGET}_lag_FF_simple_1", f"{TARGET}_lag_FF_simple_2", f"{TARGET}_diff_1_FF"]
    cols += [f"{TARGET}_lag_FF_seasonal", f"{VALUE}_lag_FF_seasonal"]
    if f.seasonal_2y:
        cols += [f"{TARGET}_lag_FF_seasonal_2y"]
    cols += [f"{VALUE}_std_FF_30", f"{VALUE}_slope_FF_30", "days_since_last_FF", "tenure_fundo_days"]
    if f.target_volatility:
        cols += [f"{TARGET}_std_FF_30"]
    if f.feature_lags:
        cols += [f"{c}_lag_FF_{k}" for c in f.feature_columns for k in (7, 30)]
    return cols + [
        f"{VALUE}_ratio_FF_30",
        f"{VALUE}_ratio_FF_90",
        f"{VALUE}_rel_global_30",
        f"delta_{TARGET}_30_90",
        f"{VALUE}_rel_formato_30",
    ]


def log_derived(df: DataFrame) -> DataFrame:
    """log1p of ratios and positive columns, signed log of the slope; before cold filling."""
    positive = [
        f"{VALUE}_ratio_FF_30",
        f"{VALUE}_ratio_FF_90",
        f"{VALUE}_rel_global_30",
        f"{VALUE}_rel_formato_30",
        "days_since_last_FF",
        f"{VALUE}_std_FF_30",
        f"{TARGET}_std_FF_30",
    ]
    signed = [f"{VALUE}_slope_FF_30"]
    new = {c: log_positive(F.col(c)) for c in positive if c in df.columns}
    new.update({c: log_signed(F.col(c)) for c in signed if c in df.columns})
    return df.withColumns(new)


def fill_cold_start(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null history becomes -1, a null slope -99999."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(SLOPE_COLD if "_slope" in c else COLD)) for c in columns}
    )


def cold_counts(df: DataFrame, lag_cols: Sequence[str], seasonal_cols: Sequence[str]) -> DataFrame:
    """Rows whose lags (or seasonal lags) are all missing; run before filling."""

    def none_of(cols):
        return F.coalesce(*[F.col(c).cast("double") for c in cols]).isNull()

    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(none_of(lag_cols)).alias("cold_lags"),
        F.count_if(none_of(seasonal_cols)).alias("cold_seasonal"),
    )


def lag_features(df: DataFrame, flags: LagFlags | None = None, fill: bool = True, scope: Sequence[str] = ()) -> DataFrame:
    """All history features: one sort per group level, blocks chosen by ``flags``.

    ``scope`` adds keys (the variety) in front of every level, so that one job serves
    all varieties.
    """
    f = flags or LagFlags()
    scope = list(scope)
    original, base = df.columns, df
    seasonal = {f"{TARGET}_lag_FF_seasonal": (TARGET, PERIOD), f"{VALUE}_lag_FF_seasonal": (VALUE, PERIOD)}
    if f.seasonal_2y:
        seasonal[f"{TARGET}_lag_FF_seasonal_2y"] = (TARGET, 2 * PERIOD)
    # What is joined or may be split comes first, while rows are narrow; sizes, days and bands
    # are always taken from the given rows.
    df = seasonal_median(df, [*scope, *FF], seasonal, base=base)
    df = relative_to_global(df, VALUE, 30, scope, f"{VALUE}_rel_global_30", base=base)
    for alias in reversed(LEVELS):
        keys = [*scope, *LEVELS[alias]]
        columns = {f"{v}_lag_{alias}_{k}": (v, k) for v in (TARGET, VALUE) for k in WINDOWS}
        if f.exante:
            df = rolling_medians_exante(df, keys, columns, base=base)
        if alias != "FF":
            if alias == "F":
                df = tenure_days(df, keys, "tenure_fundo_days", base=base)
            if not f.exante:
                df = rolling_medians(df, keys, row_order(), columns, first=DATE, base=base)
            continue
        hot = is_hot(base, keys)
        extra = {} if f.exante else {f"{VALUE}_std_FF_30": _std(VALUE, MOMENTUM)}
        extra["days_since_last_FF"] = lambda w: F.datediff(F.col(DATE), F.lag(DATE, 1).over(w)).cast("double")
        if f.simple_lags:
            extra[f"{TARGET}_lag_FF_simple_1"] = lambda w: F.lag(TARGET, 1).over(w)
            extra[f"{TARGET}_lag_FF_simple_2"] = lambda w: F.lag(TARGET, 2).over(w)
        if f.target_volatility:
            extra[f"{TARGET}_std_FF_30"] = _std(TARGET, MOMENTUM)
        lagged = {} if f.exante else dict(columns)
        if f.feature_lags:
            lagged.update({f"{c}_lag_FF_{k}": (c, k) for c in f.feature_columns for k in (7, 30)})
        if lagged:
            df = rolling_medians(df, keys, row_order(), lagged, extra, MOMENTUM, hot, DATE, base)
        else:
            df = row_frames(df, keys, row_order(), MOMENTUM, extra, hot=hot, first=DATE, base=base)
        if f.simple_lags:
            df = df.withColumn(
                f"{TARGET}_diff_1_FF", F.col(f"{TARGET}_lag_FF_simple_1") - F.col(f"{TARGET}_lag_FF_simple_2")
            )
        if f.exante:
            df = _exante_momentum(df, keys, base)
        else:
            df = rolling_slope(df, keys, VALUE, MOMENTUM, f"{VALUE}_slope_FF_30", None, hot, DATE, base)
    c = F.col
    df = df.withColumns(
        {
            f"{VALUE}_ratio_FF_30": safe_ratio(c(VALUE), c(f"{VALUE}_lag_FF_30")),
            f"{VALUE}_ratio_FF_90": safe_ratio(c(VALUE), c(f"{VALUE}_lag_FF_90")),
            f"delta_{TARGET}_30_90": safe_ratio(c(f"{TARGET}_lag_FF_30"), c(f"{TARGET}_lag_FF_90")),
            f"{VALUE}_rel_formato_30": safe_ratio(c(f"{VALUE}_lag_F_30"), c(f"{VALUE}_lag_FMT_30")),
        }
    )
    if f.log_derived:
        df = log_derived(df)
    names = lag_columns(f)
    df = df.select(*original, *names)
    return fill_cold_start(df, names) if fill else df


def _exante_momentum(df: DataFrame, keys: Sequence[str], base: DataFrame | None = None) -> DataFrame:
    daily = daily_median(df if base is None else base, keys, [VALUE])
    order = [F.col(DATE)]
    # Day grain: bounded by the calendar.
    daily = row_frames(daily, keys, order, MOMENTUM, {f"{VALUE}_std_FF_30": _std(VALUE, MOMENTUM)}, hot=False)
    daily = rolling_slope(daily, keys, VALUE, MOMENTUM, f"{VALUE}_slope_FF_30", order, hot=False)
    return join_daily(df, daily.drop(VALUE), keys)


@dataclass
class LagState:
    """Fitted history: the columns the frames need, first-seen dates and the flags."""

    history: DataFrame
    first_seen: DataFrame
    flags: LagFlags = field(default_factory=LagFlags)
    scope: tuple[str, ...] = ()


def fit_lags(train: DataFrame, flags: LagFlags | None = None, scope: Sequence[str] = ()) -> LagState:
    f = flags or LagFlags()
    cols = [*scope, ROW_ID, FARM, FORMAT, DATE, VALUE, TARGET]
    if f.feature_lags:
        cols += [c for c in f.feature_columns if c not in cols]
    first = train.groupBy(*scope, FARM).agg(F.min(DATE).alias("first_seen"))
    return LagState(train.select(*cols), first, f, tuple(scope))


def transform_lags(state: LagState, new: DataFrame) -> DataFrame:
    """Lags of new rows against the fitted history; their own target is never used.

    A row whose id and date are in the history is not new: it gets the features it had in
    training, so that it never sees itself among earlier rows. Rows without an id are new.
    """
    key = [*state.scope, ROW_ID, DATE]
    ids = state.history.select(*[F.col(c).alias(f"_known_{c}") for c in key]).distinct()
    alike = lambda df, c: df[c].eqNullSafe(F.col(f"_known_{c}")) if c in state.scope else df[c] == F.col(f"_known_{c}")
    same = [alike(new, c) for c in key]
    known = new.join(ids, same, "left_semi")
    keep = [c for c in new.columns if c != TARGET]
    names = lag_columns(state.flags)
    if not known.take(1):
        return _serve(state, new)
    fresh = new.join(ids, same, "left_anti")
    own = lag_features(state.history, state.flags, scope=state.scope).dropDuplicates(key)
    own = own.select(*[F.col(c).alias(f"_known_{c}") for c in key], *names)
    known = known.drop(*[n for n in names if n in known.columns])
    served = known.join(own, [alike(known, c) for c in key]).select(*keep, *names)
    # Without other rows, no history is walked for them.
    return _serve(state, fresh).unionByName(served) if fresh.take(1) else served


def _serve(state: LagState, new: DataFrame) -> DataFrame:
    hidden = new.withColumn(TARGET, F.lit(None).cast("double")).withColumn("_is_new", F.lit(True))
    past = state.history.withColumn("_is_new", F.lit(False))
    # On one day history comes before new rows.
    both = hidden.unionByName(past, allowMissingColumns=True).withColumn(
        ROW_ID, F.concat(F.when(F.col("_is_new"), "1|").otherwise("0|"), F.col(ROW_ID))
    )
    out = lag_features(both, state.flags, scope=state.scope).where("_is_new")
    out = out.withColumn(ROW_ID, F.expr(f"substr({ROW_ID}, 3)")).drop("_is_new", "tenure_fundo_days")
    out = serving_tenure(out, state.first_seen, [*state.scope, FARM], "tenure_fundo_days")
    keep = [c for c in new.columns if c != TARGET]
    return out.select(*keep, *lag_columns(state.flags))
