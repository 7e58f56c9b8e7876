"""Group sizes, state joins and exact quantiles that hold when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import cut, hot_rows

# Ranks told apart by the sketch that brackets a quantile of a huge group.
SKETCH = 1_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the biggest group: map-side combined counts, one number returned."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def is_hot(df: DataFrame, keys: Sequence[str]) -> bool:
    """True when some group is too big for one task."""
    return largest_group(df, keys) > hot_rows(df.sparkSession)


def attach(df: DataFrame, state: DataFrame, keys: Sequence[str] = (), how: str = "left") -> DataFrame:
    """Add the columns of a fitted state to ``df``.

    With keys it is a null-safe equi-join without a hint: the engine broadcasts the
    state when its measured size allows and otherwise sorts and merges, splitting
    skewed partitions. Without keys the one-row state is a scalar subquery.
    """
    if not keys:
        row = state.select(F.struct(*[F.col(f"`{c}`") for c in state.columns]).alias("s")).scalar()
        return df.select("*", *[row[c].alias(c) for c in state.columns])
    renamed = state
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_k_{k}")
    cond = None
    for k in keys:
        eq = df[k].eqNullSafe(renamed[f"_k_{k}"])
        cond = eq if cond is None else cond & eq
    return df.join(renamed, cond, how).drop(*[f"_k_{k}" for k in keys])


def measured(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A small keyed state, written before it is attached.

    The engine takes a state that is still to be computed for large and deals the rows out
    by its keys, a task for each huge group; once written it is seen to be small, and the
    rows stay where they are.
    """
    return cut(state) if keys else state


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    spec: dict[str, tuple[str, float]],
    weight: str | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per group, ``{name: (column, p)}``.

    Groups that fit a task use the built-in ``percentile``. For larger ones a sketch
    brackets each position, the rows below the bracket are counted and only the values
    inside it are looked at, so no task ever holds, and no shuffle carries, the values of
    a whole group. Should a bracket miss its position, or where rows have weights, values
    are counted and their running counts taken over range slices.
    """
    keys = list(keys)
    if hot is None:
        hot = is_hot(df, keys)
    if not hot:
        by_col: dict[str, list[float]] = {}
        for col, p in spec.values():
            by_col.setdefault(col, [])
            if p not in by_col[col]:
                by_col[col].append(p)
        freq = (F.col(weight),) if weight else ()
        aggs = [
            F.percentile(F.col(c), F.array(*[F.lit(p) for p in ps]), *freq).alias(f"_q_{i}")
            for i, (c, ps) in enumerate(by_col.items())
        ]
        index = {c: i for i, c in enumerate(by_col)}
        return (df.groupBy(*keys).agg(*aggs)).select(
            *keys,
            *[F.col(f"_q_{index[c]}")[by_col[c].index(p)].alias(name) for name, (c, p) in spec.items()],
        )
    if weight is None:
        found = _bracketed_quantiles(df, keys, spec)
        if found is not None:
            return found
    return _split_quantiles(df, keys, spec, weight)


def _bracketed_quantiles(df, keys, spec) -> DataFrame | None:
    """The same quantiles by brackets; None when some bracket misses its position."""
    limit = hot_rows(df.sparkSession)
    cols = list(dict.fromkeys(c for c, _ in spec.values()))
    at = {(c, p): i for i, (c, p) in enumerate(dict.fromkeys(spec.values()))}
    n_of = {c: f"_n{j}" for j, c in enumerate(cols)}
    # Of each group and column: the values, and whether they are too many for one task.
    sizes = cut(df.groupBy(*keys).agg(*[F.count(c).alias(n) for c, n in n_of.items()]))
    rows = attach(df.select(*keys, *cols), sizes, keys).select(*keys, *n_of.values(), *[F.col(c).cast("double").alias(f"_v{j}") for j, c in enumerate(cols)])
    value_of = {c: F.when(F.col(n) > limit, F.col(f"_v{j}")) for j, (c, n) in enumerate(n_of.items())}
    is_big = [F.col(n) > limit for n in n_of.values()]
    big = rows.where(F.greatest(*is_big, F.lit(False)))

    # One row a big group, and for each position the ends of its bracket.
    margin = 2.0 / SKETCH + 2.0 / limit
    ends = {c: [e for (k, p) in at if k == c for e in (max(p - margin, 0.0), min(p + margin, 1.0))] for c in cols}
    sketch = big.groupBy(*keys).agg(*[F.percentile_approx(v, F.array(*[F.lit(e) for e in ends[c]]), F.lit(SKETCH)).alias(f"_s{j}") for j, (c, v) in enumerate(value_of.items())])
    place = {i: (cols.index(c), [q for (k, q) in at if k == c].index(p)) for (c, p), i in at.items()}
    brackets = cut(sketch.select(*keys, *[F.get(f"_s{j}", F.lit(2 * m + e)).alias(f"_{name}{i}") for i, (j, m) in place.items() for e, name in ((0, "lo"), (1, "hi"))]))
    placed = attach(big, brackets, keys)
    value = {i: value_of[c] for (c, _), i in at.items()}
    below = placed.groupBy(*keys).agg(*[F.count_if(value[i] < F.col(f"_lo{i}")).alias(f"_b{i}") for i in at.values()])
    inside = F.array(*[F.when((value[i] >= F.col(f"_lo{i}")) & (value[i] <= F.col(f"_hi{i}")), F.struct(F.lit(i).alias("i"), value[i].alias("v"))) for i in at.values()])
    near = placed.select(*keys, F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("_e")).select(*keys, "_e.*").groupBy(*keys, "i", "v").agg(F.count(F.lit(1)).alias("_c"))
    # Less than a hundredth of a group.
    run = Window.partitionBy(*keys, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = attach(attach(near.withColumn("_cum", F.sum("_c").over(run)), sizes, keys), below, keys)
    picks = []
    for (c, p), i in at.items():
        here = F.col("i") == i
        pos = F.lit(float(p)) * (F.col(n_of[c]) - 1)
        upto = F.col("_cum") + F.col(f"_b{i}")
        low, high = (F.min(F.when(here & (upto > r), F.col("v"))) for r in (F.floor(pos), F.ceil(pos)))
        met = F.max(F.when(here, F.col(f"_b{i}") <= F.floor(pos))) & (F.max(F.when(here, upto - 1 - F.ceil(pos))) >= 0)
        picks += [(low + (high - low) * F.max(F.when(here, pos - F.floor(pos)))).alias(f"_q{i}"), F.coalesce(met, F.lit(False)).alias(f"_ok{i}")]
    found = cut(ranked.groupBy(*keys).agg(*picks))
    judged = attach(sizes, found, keys)
    missed = [(F.col(n_of[c]) > limit) & ~F.coalesce(F.col(f"_ok{i}"), F.lit(False)) for (c, _), i in at.items()]
    if not judged.where(F.greatest(*missed, F.lit(False))).isEmpty():
        return None

    # What fits a task, of the other groups and of columns with few values.
    result = judged
    few = [F.col(n).between(1, limit) for n in n_of.values()]
    if not sizes.where(F.greatest(*few, F.lit(False))).isEmpty():
        aggs = []
        for j, c in enumerate(cols):
            ps = [p for (k, p) in at if k == c]
            aggs.append(F.percentile(F.when(few[j], F.col(f"_v{j}")), F.array(*[F.lit(float(p)) for p in ps])).alias(f"_p{j}"))
        result = attach(judged, rows.where(F.greatest(*few, F.lit(False))).groupBy(*keys).agg(*aggs), keys)
        plain = {i: F.get(f"_p{j}", F.lit(m)) for i, (j, m) in place.items()}
    else:
        plain = dict.fromkeys(place, F.lit(None).cast("double"))
    # Written, so that the engine knows how small it is and the rows it is joined to stay where they are.
    return cut(result.select(*keys, *[F.coalesce(F.col(f"_q{at[cp]}"), plain[at[cp]]).alias(name) for name, cp in spec.items()]))


def _split_quantiles(df, keys, spec, weight) -> DataFrame:
    from furrow.operators.ordered import running

    cols = sorted({c for c, _ in spec.values()})
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_value")) for c in cols])
        ).alias("_e"),
        (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"),
    ).select(*keys, "_e.*", "_w")
    counts = (
        long.where(F.col("_value").isNotNull())
        .groupBy(*keys, "_name", "_value")
        .agg(F.sum("_w").alias("_w"))
    )
    cum = running(counts, [*keys, "_name"], ["_value"], {"_cum": F.col("_w")}, hot=True)
    total = counts.groupBy(*keys, "_name").agg(F.sum("_w").alias("_n"))
    ranked = attach(cum, total, [*keys, "_name"])

    picks = []
    for name, (c, p) in spec.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        here = F.col("_name") == c
        low = F.min(F.when(here & (F.col("_cum") > F.floor(pos)), F.col("_value")))
        high = F.min(F.when(here & (F.col("_cum") > F.ceil(pos)), F.col("_value")))
        frac = F.max(F.when(here, pos - F.floor(pos)))
        picks.append((low + (high - low) * frac).alias(name))
    found = ranked.groupBy(*keys).agg(*picks)
    if not keys:
        return found
    # Groups without any value keep a row of nulls, as the aggregate form gives.
    return attach(df.select(*keys).distinct(), found, keys)


def median(df: DataFrame, keys: Sequence[str], col: str, name: str = "median") -> DataFrame:
    return quantiles(df, keys, {name: (col, 0.5)})


def safe(column: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(column) | (F.abs(column) == float("inf")), F.lit(None)).otherwise(column)
