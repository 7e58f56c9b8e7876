"""Error tables, uncertainty bands and business reports over stored predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.columns import DATE, FARM, FF, FORMAT, HOURS, MIN_DENOM, MISSING, REAL, REL_FLOOR, ROW_ID, TARGET
from furrow.functions.metrics import metric_columns
from furrow.functions.scalar import edge_bin_right, half_even, hash_bucket, poisson_one, replicate_uniform, replicate_weights, width_bin_left
from furrow.operators.groups import attach, measured, quantiles
from furrow.operators.ordered import position
from furrow.session import cut

# Limits of reports and bands.
VERDICTS = [("alta_confianza", 15.0, 0.10), ("confianza_aceptable", 22.0, 0.18), ("confianza_limitada", 35.0, 0.30)]
R2_GREEN, R2_AMBER, MAE_GREEN, MAE_AMBER_RATIO = 0.90, 0.70, 0.20, 2.0
BAND_MIN_GROUP, BAND_MIN_KNOWN, COLD_FACTOR, RECENT_SHARE, BAND_MIN_RECENT = 100, 10, 2.0, 0.25, 100


def regression_metrics(df: DataFrame, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred", min_denom: float | str = MIN_DENOM, hot: bool | None = None) -> DataFrame:
    """All error metrics per group; a column name as ``min_denom`` gives a per-row floor."""
    by = list(by)
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    floor = F.col(min_denom) if isinstance(min_denom, str) else min_denom
    cols = metric_columns(F.col(y).cast("double"), F.col(p).cast("double"), floor)
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in cols.items()])
    med = quantiles(rows.withColumn("_ae", F.abs(F.col(y) - F.col(p))), by, {"median_ae": ("_ae", 0.5)}, hot=hot)
    return attach(out, med, by)


def relative_floor_metrics(df: DataFrame, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred", share: float = REL_FLOOR) -> DataFrame:
    """Metrics whose MAPE ignores targets under 5 % of the median size."""
    by = list(by)
    sized = df.withColumn("_size", F.abs(y))
    floor = quantiles(sized, by, {"_med": ("_size", 0.5)})
    out = attach(df, floor, by).withColumn("_floor", F.greatest(F.lit(1e-9), F.col("_med") * share))
    return regression_metrics(out, by, y, p, "_floor")


def fold_summary(folds: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over folds."""
    return folds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_folds"),
        *[a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))],
    )


def business_rows(df: DataFrame, p: str = "y_pred", hours: str = HOURS, real: str = REAL) -> DataFrame:
    """Predicted kilos per day; rows without finite values are flagged, not lost."""
    pred = F.col(p) * F.col(hours)
    ok = F.coalesce(~F.isnan(pred) & (F.abs(pred) < float("inf")) & ~F.isnan(real), F.lit(False))
    return df.withColumn("kg_jr_pred", pred).withColumn("_finite", ok & F.col(real).isNotNull())


def business_validation(df: DataFrame, preds: dict[str, str], by: Sequence[str] = (), hours: str = HOURS, real: str = REAL) -> DataFrame:
    """Metrics in business units for each prediction set, e.g. ``{"oof": ..., "insample": ...}``."""
    by = list(by)
    parts = []
    # Read several times by each set, so written once with only the columns they need.
    df = cut(df.select(*dict.fromkeys([*by, hours, real, *preds.values()])))
    for name, p in preds.items():
        rows = business_rows(df, p, hours, real)
        good = rows.where("_finite")
        out = regression_metrics(good, by, real, "kg_jr_pred")
        lost = rows.groupBy(*by).agg(F.count_if(~F.col("_finite")).alias("n_dropped"))
        parts.append(attach(lost, out, by).withColumn("set", F.lit(name)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def prediction_table(df: DataFrame, p: str = "y_pred", y: str = TARGET, half_width: str | None = None, keep: Sequence[str] = (ROW_ID,), hours: str = HOURS, real: str = REAL) -> DataFrame:
    """Row export: real, predicted, absolute and percent error, optional low and high band."""
    rows = business_rows(df, p, hours, real).where("_finite")
    err = F.abs(F.col("kg_jr_pred") - F.col(real))
    cols = [
        F.col(y).alias("kg_jr_h_real"),
        F.col(p).alias("kg_jr_h_pred"),
        F.col(hours).alias("h_ef"),
        F.col(real).alias("kg_jr_real"),
        "kg_jr_pred",
        err.alias("error_abs"),
        F.try_divide(err * 100.0, F.abs(real)).alias("error_pct"),
    ]
    if half_width:
        cols += [((F.col(p) - F.col(half_width)) * F.col(hours)).alias("low"), ((F.col(p) + F.col(half_width)) * F.col(hours)).alias("high")]
    return rows.select(*keep, *cols, *[c for c in ("fold_id",) if c in df.columns and c not in keep])


def subgroup_summary(table: DataFrame, col: str) -> DataFrame:
    """Errors per group of a prediction table, ranked worst first."""
    out = table.groupBy(col).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("kg_jr_real").alias("mean_real"),
        F.avg("kg_jr_pred").alias("mean_pred"),
        F.avg("error_abs").alias("mae"),
        F.avg("error_pct").alias("mean_pct"),
        F.max("error_abs").alias("max_error"),
    )
    # One row per group value.
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("mean_pct"), col)))


def grouping_dimensions(df: DataFrame, farm=FARM, fmt=FORMAT, date=DATE, area="ha", quartiles: Sequence[str] = ("kg_ha", "indus_pct")) -> DataFrame:
    """Long form ``(dimension, level)``: format, farm, year, month, area bands, quartiles."""
    dims: list[tuple[str, Column]] = []
    if fmt in df.columns:
        dims.append(("formato", F.col(fmt).cast("string")))
    if farm in df.columns:
        dims.append(("fundo", F.col(farm).cast("string")))
    if date in df.columns:
        names = "Ene Feb Mar Abr May Jun Jul Ago Sep Oct Nov Dic".split()
        month = F.month(date)
        name = F.element_at(F.array(*[F.lit(n) for n in names]), month)
        dims += [("anio", F.year(date).cast("string")), ("mes", F.concat(F.lpad(month.cast("string"), 2, "0"), F.lit("-"), name))]
    if area in df.columns:
        a = F.col(area)
        band = F.when(a <= 1, "<=1 ha").when(a <= 3, "1-3 ha").when(a <= 6, "3-6 ha").when(a.isNotNull(), ">6 ha")
        dims.append(("ha", band))
    present = [c for c in quartiles if c in df.columns]
    out = df
    if present:
        spec = {f"_e_{c}_{i}": (c, i / 4) for c in present for i in range(5)}
        out = attach(df, quantiles(df, [], spec))
        labels = F.array(*[F.lit(v) for v in ("Q1 bajo", "Q2", "Q3", "Q4 alto")])
        for c in present:
            edges = F.array_distinct(F.array(*[F.col(f"_e_{c}_{i}") for i in range(5)]))
            dims.append((c, F.when(F.size(edges) == 5, F.get(labels, edge_bin_right(F.col(c), edges)))))
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), e.alias("level")) for n, e in dims])
    long = out.select(*df.columns, F.explode(pairs).alias("_d")).select(*df.columns, "_d.*")
    return long.where(F.col("level").isNotNull() & (F.col("level") != ""))


def subgroup_errors(long: DataFrame, y: str = "y_true", p: str = "y_pred", least: int = 5) -> DataFrame:
    """p50, p90, MAE, MAPE and ratio to global per (dimension, level), with a global row.

    The global row uses one copy of each row: pass rows of one dimension's worth, or the
    long form, in which every dimension repeats all rows and leaves the shares unchanged.
    """
    rows = long.withColumn("_ae", F.abs(F.col(y) - F.col(p))).withColumn("_pe", F.try_divide(F.abs(F.col(y) - F.col(p)), F.abs(y)))

    def table(keys):
        spec = {"p50": ("_ae", 0.5), "p90": ("_ae", 0.9)}
        m = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_ae").alias("mae"), (F.avg("_pe") * 100).alias("mape"))
        return attach(m, quantiles(rows, keys, spec), keys)

    groups = table(["dimension", "level"]).where(F.col("n") >= least)
    whole = table(["dimension"])
    base = whole.select("dimension", F.col("mape").alias("_g"))
    groups = attach(groups, base, ["dimension"]).withColumn("ratio", F.when(F.col("_g") > 0, F.col("mape") / F.col("_g"))).drop("_g")
    return groups.unionByName(whole.withColumn("level", F.lit("GLOBAL")).withColumn("ratio", F.lit(1.0)))


def group_bias(df: DataFrame, col: str = FARM, y: str = "y_true", p: str = "y_pred", least: int = 10, pct: float = 5.0) -> DataFrame:
    """Groups whose mean signed error is at least ``pct`` of the mean target."""
    out = df.groupBy(F.col(col).cast("string").alias("group_value")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(p) - F.col(y)).alias("bias"), F.avg(y).alias("_real")
    )
    out = out.where((F.col("n") >= least) & (F.abs("_real") >= 1e-9) & (F.col("group_value") != ""))
    out = out.withColumn("bias_pct", F.col("bias") / F.col("_real") * 100.0).where(F.abs("bias_pct") >= pct)
    way = F.when(F.col("bias_pct") > 0, "sobreestima").otherwise("subestima")
    return out.select("group_value", "n", "bias", "bias_pct", way.alias("direction")).orderBy(F.desc(F.abs("bias_pct")), "group_value")


def error_percentiles(df: DataFrame, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    rows = df.withColumn("_ae", F.abs(F.col(y) - F.col(p)))
    return quantiles(rows, list(by), {f"p{int(q * 100)}": ("_ae", q) for q in (0.5, 0.8, 0.9, 0.99)})


def top_errors(df: DataFrame, n: int = 20, y: str = "y_true", p: str = "y_pred", keep: Sequence[str] = (ROW_ID, DATE, FARM, FORMAT)) -> DataFrame:
    """The n worst rows with their context (the feature is the top list)."""
    err = F.abs(F.col(y) - F.col(p))
    way = F.when(F.col(p) > F.col(y), "sobreestima").otherwise("subestima")
    out = df.select(*keep, y, p, err.alias("error_abs"), F.try_divide(err * 100, F.abs(y)).alias("error_pct"), way.alias("direction"))
    return out.orderBy(F.desc("error_abs"), ROW_ID).limit(n)


def histogram(df: DataFrame, col: str, bins: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts, left-closed, last bin closed; empty bins are absent."""
    by = list(by)
    span = df.groupBy(*by).agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"))
    out = attach(df.where(F.col(col).isNotNull()), span, by)
    binned = out.withColumn("bin", width_bin_left(F.col(col).cast("double"), F.col("_lo"), F.col("_hi"), F.lit(bins)))
    step = (F.col("_hi") - F.col("_lo")) / bins
    return binned.groupBy(*by, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n")).select(
        *by, "bin", (F.col("_lo") + step * F.col("bin")).alias("bin_low"), (F.col("_lo") + step * (F.col("bin") + 1)).alias("bin_high"), "n"
    )


def error_histogram(df: DataFrame, bins: int = 60, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    return histogram(df.withColumn("_ae", F.abs(F.col(y) - F.col(p))), "_ae", bins, by)


def calibration_bins(df: DataFrame, bins: int = 10, y: str = "y_true", p: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """Quantile bins of the prediction: means, count and percent difference."""
    by = list(by)
    spec = {f"_e{i}": (p, i / bins) for i in range(bins + 1)}
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    out = attach(attach(df, quantiles(df, by, spec), by), n, by).where(F.col("_n") >= 2 * bins)
    edges = F.array_distinct(F.array(*[F.col(f"_e{i}") for i in range(bins + 1)]))
    out = out.withColumn("bin_idx", edge_bin_right(F.col(p), edges))
    table = out.groupBy(*by, "bin_idx").agg(
        F.avg(p).alias("bin_pred_mean"), F.avg(y).alias("bin_real_mean"), F.count(F.lit(1)).alias("bin_count")
    )
    diff = F.try_divide((F.col("bin_real_mean") - F.col("bin_pred_mean")) * 100.0, F.col("bin_pred_mean"))
    return table.withColumn("bin_diff_pct", diff)


# Sums behind the named metrics of a resample, and groups whose sums one task holds at once.
BOOT_SUMS = ("n", "ae", "ape", "na", "se", "sy", "syy")
BOOT_GROUPS = 100


def _replicate_sums(rows: DataFrame, by: Sequence[str], replicates: int) -> DataFrame:
    """(by, _b, sums): weighted sums of each replicate, added up inside the tasks.

    A task keeps replicates x 7 numbers per group and sends them on when it has met enough
    groups, so rows are not repeated for the replicates.
    """
    width = len(by)

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def out():
            names = list(held)
            arrays = [pa.array([g[i] for g in names for _ in range(replicates)], type=kinds[i]) for i in range(width)]
            numbers = np.concatenate(list(held.values()))
            arrays.append(pa.array(np.tile(np.arange(1, replicates + 1, dtype=np.int32), len(names))))
            arrays += [pa.array(numbers[:, k]) for k in range(len(BOOT_SUMS))]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*by, "_b", *[f"_{k}" for k in BOOT_SUMS]])

        kinds: list = []
        for batch in batches:
            kinds = [batch.column(i).type for i in range(width)]
            x, y = (batch.column(width + i).to_numpy(zero_copy_only=False) for i in range(2))
            values = np.column_stack([batch.column(width + 2 + k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(len(BOOT_SUMS))])
            labels = list(zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True)) if width else [()] * len(x)
            places: dict[tuple, list[int]] = {}
            for i, g in enumerate(labels):
                places.setdefault(g, []).append(i)
            for g, at in places.items():
                total = held.setdefault(g, np.zeros((replicates, len(BOOT_SUMS))))
                for k in range(0, len(at), 2048):
                    part = np.array(at[k : k + 2048])
                    total += replicate_weights(x[part], y[part], replicates).T @ values[part]
                if len(held) >= BOOT_GROUPS:
                    yield out()
        if held:
            yield out()

    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    sums = rows.mapInArrow(run, fields + "_b int, " + ", ".join(f"_{k} double" for k in BOOT_SUMS))
    return sums.groupBy(*by, "_b").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in BOOT_SUMS])


def bootstrap_ci(
    df: DataFrame,
    metrics: dict[str, Callable[[Column, Column, Column], Column]] | Sequence[str] = ("mae", "mape", "r2"),
    replicates: int = 1000,
    alpha: float = 0.05,
    by: Sequence[str] = (),
    y: str = "y_true",
    p: str = "y_pred",
    row_id: str = ROW_ID,
    seed: int = 42,
) -> DataFrame:
    """Percentile interval per metric; every row gets a Poisson(1) weight in each replicate.

    ``metrics`` may be names, whose sums are added up inside the tasks, or builders of a
    weighted aggregate ``f(y, p, weight)``; for these each row is repeated per replicate
    inside a partial aggregate.
    """
    by = list(by)
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    rows = rows.withColumns({"_hx": hash_bucket(F.col(row_id), seed), "_hy": hash_bucket(F.col(row_id), seed + 1)})
    if isinstance(metrics, dict):
        names = list(metrics)
        base = rows.withColumns({"_y": F.col(y).cast("double"), "_p": F.col(p).cast("double")})

        def build(w):
            return {k: f(F.col("_y"), F.col("_p"), w) for k, f in metrics.items()}

        point = base.groupBy(*by).agg(*[c.alias(f"{k}_point") for k, c in build(F.lit(1.0)).items()])
        drawn = base.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        drawn = drawn.withColumn("_w", poisson_one(replicate_uniform(F.col("_hx"), F.col("_hy"), F.col("_b"))).cast("double")).where("_w > 0")
        each = drawn.groupBy(*by, "_b").agg(*[c.alias(k) for k, c in build(F.col("_w")).items()])
    else:
        names = list(metrics)
        err = F.abs(F.col(y) - F.col(p)).cast("double")
        real = F.col(y).cast("double")
        ok = F.abs(y) >= MIN_DENOM
        values = {"n": F.lit(1.0), "ae": err, "ape": F.when(ok, err / F.nullif(F.abs(y), F.lit(0.0))), "na": ok.cast("double"), "se": err * err, "sy": real, "syy": real * real}
        base = rows.select(*by, "_hx", "_hy", *[F.coalesce(values[k].cast("double"), F.lit(0.0)).alias(f"_{k}") for k in BOOT_SUMS])

        def known(s):
            sst = s["syy"] - F.try_divide(s["sy"] * s["sy"], s["n"])
            found = {
                "mae": F.try_divide(s["ae"], s["n"]),
                "mape": F.try_divide(s["ape"], s["na"]) * 100.0,
                "r2": 1.0 - F.try_divide(s["se"], sst),
                "rmse": F.sqrt(F.try_divide(s["se"], s["n"])),
            }
            return {k: found[k] for k in names}

        point = base.groupBy(*by).agg(*[c.alias(f"{k}_point") for k, c in known({k: F.sum(f"_{k}") for k in BOOT_SUMS}).items()])
        each = _replicate_sums(base, by, replicates).where("_n > 0")
        each = each.select(*by, "_b", *[c.alias(k) for k, c in known({k: F.col(f"_{k}") for k in BOOT_SUMS}).items()])
    # One row per replicate and group.
    spec = {f"{k}_{side}": (k, q) for k in names for side, q in (("low", alpha / 2), ("high", 1 - alpha / 2))}
    limits = quantiles(each, by, spec, hot=False)
    wide = attach(point, limits, by)
    items = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"{k}_point").alias("point"), F.col(f"{k}_low").alias("ci_low"), F.col(f"{k}_high").alias("ci_high")) for k in names])
    return wide.select(*by, F.inline(items))


def rank_quantile(df: DataFrame, keys: Sequence[str], col: str, level: Callable[[Column], Column], name: str = "q", order: str = ROW_ID) -> DataFrame:
    """Quantile whose level depends on the group's size: interpolated order statistics."""
    keys = list(keys)
    rows = df.where(F.col(col).isNotNull())
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ranked = attach(position(rows.select(*keys, col, order), keys, [F.col(col), F.col(order)], "_pos"), n, keys)
    at = (F.col("n") - 1) * level(F.col("n").cast("double"))
    low = F.max(F.when(F.col("_pos") == F.floor(at) + 1, F.col(col)))
    high = F.max(F.when(F.col("_pos") == F.ceil(at) + 1, F.col(col)))
    frac = F.max(at - F.floor(at))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), (low + (high - low) * frac).alias(name))


def conformal_level(alpha: float) -> Callable[[Column], Column]:
    return lambda n: F.least(F.lit(1.0), (1 - alpha) * (n + 1) / n)


def conformal_interval(df: DataFrame, alpha: float = 0.05, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Half width per group from absolute residuals; under 20 of them it is zero."""
    rows = df.withColumn("_ae", F.abs(F.col(y) - F.col(p)))
    q = rank_quantile(rows, by, "_ae", conformal_level(alpha), "half_width")
    return q.withColumn("half_width", F.when(F.col("n") < 20, F.lit(0.0)).otherwise(F.col("half_width")))


def conformal_bands(df: DataFrame, alpha: float = 0.10, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred", date: str = DATE, farm: str = FARM, fmt: str = FORMAT) -> dict[str, DataFrame]:
    """Band state: ``overall`` (one row per ``by``), ``farms``, ``known`` groups."""
    by = list(by)
    level = conformal_level(alpha)
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(p)).withColumn("_ae", F.abs(F.col(y) - F.col(p)))
    # Read several times below, so written once with only the columns it needs.
    rows = cut(rows.select(*by, farm, date, ROW_ID, "_ae"))
    dated = rows.where(F.col(date).isNotNull())
    n = dated.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    placed = cut(attach(position(dated, by, [F.col(date), F.col(ROW_ID)], "_pos"), n, by))
    enough = F.col("_n") >= BAND_MIN_RECENT
    n_recent = F.greatest(F.lit(BAND_MIN_RECENT), F.bround(F.col("_n") * RECENT_SHARE).cast("bigint"))
    split = F.greatest(F.lit(20), F.bround(F.col("_n") * 0.70).cast("bigint"))
    recent = placed.where(enough & (F.col("_pos") > F.col("_n") - n_recent))
    early = placed.where(enough & (F.col("_pos") <= split) & (split < F.col("_n")))
    late = placed.where(enough & (F.col("_pos") > split))

    everything = rank_quantile(rows, by, "_ae", level, "q_all").withColumnRenamed("n", "n_calibration")
    newest = rank_quantile(recent, by, "_ae", level, "q_recent").withColumnRenamed("n", "n_recent")
    first = rank_quantile(early, by, "_ae", level, "q_early").drop("n")
    covered = attach(late, first, by).groupBy(*by).agg(
        F.avg((F.col("_ae") <= F.col("q_early")).cast("double")).alias("backtest_coverage"), F.count(F.lit(1)).alias("backtest_n")
    )
    overall = attach(attach(everything, newest, by), covered, by).where(F.col("n_calibration") >= 20)
    overall = overall.withColumn("q_global", F.greatest("q_all", "q_recent")).withColumn("alpha", F.lit(alpha))

    farm_all = rank_quantile(rows, [*by, farm], "_ae", level, "_q").where(F.col("n") >= BAND_MIN_GROUP)
    farm_new = rank_quantile(recent, [*by, farm], "_ae", level, "_r").where(F.col("n") >= max(30, BAND_MIN_GROUP // 2)).drop("n")
    farms = attach(farm_all, farm_new, [*by, farm]).select(*by, farm, F.greatest("_q", "_r").alias("q_farm"), "n")
    known = rows_known(df, [*by, farm, fmt])
    return {"overall": overall, "farms": farms, "known": known}


def rows_known(df: DataFrame, keys: Sequence[str], least: int = BAND_MIN_KNOWN) -> DataFrame:
    """Groups with at least ``least`` rows."""
    return df.groupBy(*keys).count().where(F.col("count") >= least).select(*keys, F.lit(True).alias("known"))


def known_group_flag(df: DataFrame, known: DataFrame, keys: Sequence[str] = FF) -> DataFrame:
    return attach(df, known, keys).withColumn("known", F.coalesce("known", F.lit(False)))


def apply_bands(df: DataFrame, bands: dict[str, DataFrame], p: str = "y_pred", by: Sequence[str] = (), farm: str = FARM, fmt: str = FORMAT) -> DataFrame:
    """Half width (doubled for unknown groups), low, high and confidence."""
    by = list(by)
    out = attach(df, bands["farms"].select(*by, farm, "q_farm"), [*by, farm])
    out = attach(out, bands["overall"].select(*by, "q_global"), by)
    out = known_group_flag(out, bands["known"], [*by, farm, fmt])
    half = F.coalesce("q_farm", "q_global") * F.when(F.col("known"), F.lit(1.0)).otherwise(F.lit(COLD_FACTOR))
    out = out.withColumn("half_width", half)
    return with_confidence(out.drop("q_farm", "q_global"), p)


def with_confidence(df: DataFrame, p: str = "y_pred", half: str = "half_width") -> DataFrame:
    v, h = F.col(p), F.col(half)
    ok = (v > 0) & (h >= 0)
    rel = F.when(ok, h / v)
    return df.withColumns({
        "low": F.when(ok, half_even(F.greatest(F.lit(0.0), v - h), 4)),
        "high": F.when(ok, half_even(v + h, 4)),
        "confidence": F.when(rel > 0.50, "baja").when(rel > 0.25, "media").when(ok, "alta"),
    })


def ensemble_band(std: Column) -> Column:
    """Fallback half width from the spread of an ensemble."""
    return 1.96 * std


def kpi_table(df: DataFrame, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Precision, explained share and gain over predicting the mean, with their grades."""
    by = list(by)
    mean = df.groupBy(*by).agg(F.avg(y).alias("_mean"))
    rows = attach(df, mean, by)
    m = metric_columns(F.col(y), F.col(p))
    out = rows.groupBy(*by).agg(
        m["mape"].alias("mape"), (m["r2"] * 100.0).alias("explained_pct"), m["mae"].alias("mae"), F.avg(F.abs(F.col(y) - F.col("_mean"))).alias("mae_mean")
    )
    out = attach(out, error_percentiles(df, by, y, p).select(*by, "p50", "p80"), by)
    gain = F.when(F.col("mae_mean") > 0, (F.col("mae_mean") - F.col("mae")) / F.col("mae_mean") * 100.0).otherwise(F.lit(0.0))
    out = out.withColumn("gain_pct", gain)

    def grade(high: Column, medium: Column) -> Column:
        return F.when(high, "ALTO").when(medium, "MEDIO").otherwise("BAJO")

    c = F.col
    return out.withColumns({
        "precision_grade": grade(c("mape") <= 15.0, c("mape") <= 25.0),
        "explained_grade": grade(c("explained_pct") >= 80.0, c("explained_pct") >= 60.0),
        "gain_grade": grade(c("gain_pct") >= 50.0, c("gain_pct") >= 25.0),
    })


def verdict(mape: Column, gap: Column) -> Column:
    """First level whose two limits both hold."""
    out = None
    for name, max_mape, max_gap in VERDICTS:
        test = (mape <= max_mape) & (gap <= max_gap)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("no_recomendado")


def recommended_actions(df: DataFrame, abs_gap: float, cols: Sequence[str] = (FORMAT, FARM), y: str = "y_true", p: str = "y_pred", least: int = 10, ratio: float = 1.5) -> DataFrame:
    """Rows (severity, subject, value): high error, memorised training, bad groups, or none."""
    spark = df.sparkSession
    m = metric_columns(F.col(y), F.col(p))["mape"]
    overall = df.agg(m.alias("mape"))
    g = overall.select("mape").scalar()
    high = overall.where("mape > 25.0").select(F.lit("critical").alias("severity"), F.lit("error_global").alias("subject"), F.col("mape").alias("value"))
    gap = spark.range(1).where(F.lit(abs_gap > 0.20)).select(F.lit("warning").alias("severity"), F.lit("gap").alias("subject"), F.lit(float(abs_gap)).alias("value"))
    out = high.unionByName(gap)
    for c in cols:
        groups = df.groupBy(F.col(c).cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_n"), m.alias("mape"))
        bad = groups.where((F.col("_n") >= least) & (F.col("_v") != "") & (g > 0) & (F.col("mape") >= g * ratio))
        out = out.unionByName(bad.select(F.lit("warning").alias("severity"), F.concat(F.lit(f"{c}="), F.col("_v")).alias("subject"), (F.col("mape") / g).alias("value")))
    n = out.agg(F.count(F.lit(1)).alias("n"))
    none = n.where("n = 0").select(F.lit("info").alias("severity"), F.lit("ninguno").alias("subject"), F.lit(0.0).alias("value"))
    return out.unionByName(none)


def training_context(df: DataFrame, by: Sequence[str] = (), date: str = DATE, farm: str = FARM, fmt: str = FORMAT) -> DataFrame:
    """Rows, month range, distinct farms and formats and the first five of each."""
    levels = df.groupBy(*by, farm, fmt).agg(F.count(F.lit(1)).alias("_n"), F.min(date).alias("_a"), F.max(date).alias("_b"))
    out = levels.groupBy(*by).agg(
        F.sum("_n").alias("n_rows"), F.date_format(F.min("_a"), "yyyy-MM").alias("month_min"), F.date_format(F.max("_b"), "yyyy-MM").alias("month_max"),
        F.count_distinct(farm).alias("n_farms"), F.count_distinct(fmt).alias("n_formats"),
    )
    for col, name in ((farm, "farms_top"), (fmt, "formats_top")):
        w = Window.partitionBy(*by).orderBy(col) if by else Window.orderBy(col)
        first = levels.where(F.col(col).isNotNull()).select(*by, col).distinct().withColumn("_r", F.row_number().over(w)).where("_r <= 5")
        out = attach(out, first.groupBy(*by).agg(F.sort_array(F.collect_list(F.col(col).cast("string"))).alias(name)), list(by))
    return out


def traffic_light(r2: Column, mae: Column) -> dict[str, Column]:
    return {
        "r2_light": F.when(r2.isNull(), "-").when(r2 >= R2_GREEN, "VERDE").when(r2 >= R2_AMBER, "AMARILLO").otherwise("ROJO"),
        "mae_light": F.when(mae.isNull(), "-").when(mae <= MAE_GREEN, "VERDE").when(mae <= MAE_GREEN * MAE_AMBER_RATIO, "AMARILLO").otherwise("ROJO"),
    }


def fit_baseline(train: DataFrame, y: str = TARGET, levels: Sequence[Sequence[str]] = (FF, (FARM,), (FORMAT,)), least: int = 10, scope: Sequence[str] = ()) -> list[tuple[list[str], DataFrame]]:
    """Group medians from specific to global; small groups are left out."""
    scope = list(scope)
    rows = _with_missing(train.where(F.col(y).isNotNull()), levels)
    states = []
    for i, level in enumerate([*levels, ()]):
        keys = list(dict.fromkeys([*scope, *level]))
        med = quantiles(rows, keys, {f"_b{i}": (y, 0.5)})
        if level:
            big = rows.groupBy(*keys).agg(F.count(y).alias("_n")).where(F.col("_n") >= least).drop("_n")
            med = attach(big, med, keys)
        states.append((keys, measured(med, keys)))
    return states


def _with_missing(df, levels):
    cols = sorted({c for level in levels for c in level})
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in cols})


def cascade_lookup(df: DataFrame, states: Sequence[tuple[Sequence[str], DataFrame]], name: str) -> DataFrame:
    """First value found from the most specific level to the last."""
    out = df
    values = []
    for keys, state in states:
        out = attach(out, state, keys)
        values += [c for c in state.columns if c not in keys]
    return out.select(*df.columns, F.coalesce(*[F.col(v) for v in values]).alias(name))


def predict_baseline(df: DataFrame, states, name: str = "baseline_pred", levels=(FF, (FARM,), (FORMAT,))) -> DataFrame:
    cols = sorted({c for level in levels for c in level})
    keyed = df.withColumns({f"_raw_{c}": F.col(c) for c in cols})
    out = cascade_lookup(_with_missing(keyed, levels), states, name)
    return out.withColumns({c: F.col(f"_raw_{c}") for c in cols}).select(*df.columns, name)
