"""Distribution drift: years, rows and batches against a stored baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.columns import CATEGORICAL_FEATURES, DATE, MISSING, NUMERIC_FEATURES, ROW_ID, VARIETY
from furrow.functions.scalar import edge_bin_left
from furrow.functions.stats import ks_tail, melt
from furrow.operators.groups import attach, quantiles
from furrow.operators.hypothesis import chi2_goodness
from furrow.operators.ordered import running
from furrow.operators.ranks import ks_two_sample
from furrow.session import cut

# Thresholds of the two PSI rules and of the row report.
EPS_YEARS, EPS_BATCH = 1e-6, 1e-4
MIN_SIDE, MIN_BATCH, MIN_HISTORY = 50, 30, 30
Z_OK, Z_ALERT, RARE_SHARE = 1.0, 3.0, 0.01
SHARES = [0.05, 0.20, 0.25, 0.25, 0.20, 0.05]


def _psi(bins: DataFrame, keys: Sequence[str], eps: float, name: str = "psi") -> DataFrame:
    """PSI of bin counts ``e`` and ``a``; bins empty on both sides add nothing."""
    total = bins.groupBy(*keys).agg(F.sum("e").alias("n_expected"), F.sum("a").alias("n_actual"))
    out = attach(bins, total, keys)
    e = F.greatest(F.col("e") / F.col("n_expected"), F.lit(eps))
    a = F.greatest(F.col("a") / F.col("n_actual"), F.lit(eps))
    return out.groupBy(*keys).agg(
        F.max("n_expected").alias("n_expected"), F.max("n_actual").alias("n_actual"), F.sum((a - e) * F.log(a / e)).alias(name)
    )


def psi(df: DataFrame, keys: Sequence[str], col: str, side: str, bins: int = 10) -> DataFrame:
    """PSI on the deciles of side ``e`` with open ends; both sides need 50 values."""
    keys = list(keys)
    rows = df.where(F.col(col).isNotNull() & ~F.isnan(col))
    spec = {f"_q{i}": (col, i / bins) for i in range(bins + 1)}
    q = quantiles(rows.where(F.col(side) == "e"), keys, spec)
    points = F.array_sort(F.array_distinct(F.array(*[F.col(f"_q{i}") for i in range(bins + 1)])))
    edges = q.select(*keys, points.alias("_p"))
    binned = attach(rows, edges, keys).where(F.size("_p") >= 3)
    inner = F.slice("_p", F.lit(2), F.size("_p") - 2)
    table = binned.groupBy(*keys, edge_bin_left(F.col(col), inner).alias("bin")).agg(
        F.count_if(F.col(side) == "e").alias("e"), F.count_if(F.col(side) == "a").alias("a")
    )
    out = _psi(table, keys, EPS_YEARS)
    enough = (F.col("n_expected") >= MIN_SIDE) & (F.col("n_actual") >= MIN_SIDE)
    return out.withColumn("psi", F.when(enough, F.col("psi")))


def year_pairs(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), date: str = DATE) -> DataFrame:
    """Long rows (variable, year_a, year_b, side, value): each row serves two pairs."""
    by = list(by)
    long = melt(df.withColumn("_year", F.year(date)), [*by, "_year"], cols)
    years = df.select(*by, F.year(date).alias("_year")).where("_year IS NOT NULL").distinct()
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("_year")  # a row per year
    years = years.select(*by, "_year", F.lag("_year").over(w).alias("_before"), F.lead("_year").over(w).alias("_after"))
    both = attach(long, years, [*by, "_year"])
    as_e = F.when(F.col("_after").isNotNull(), F.struct(F.col("_year").alias("year_a"), F.col("_after").alias("year_b"), F.lit("e").alias("side")))
    as_a = F.when(F.col("_before").isNotNull(), F.struct(F.col("_before").alias("year_a"), F.col("_year").alias("year_b"), F.lit("a").alias("side")))
    return both.select(*by, "variable", "value", F.inline(F.array_compact(F.array(as_e, as_a))))


def year_drift(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), date: str = DATE) -> DataFrame:
    """PSI and KS p-value of consecutive years, with the worst PSI and its severity."""
    by = list(by)
    # Read by the edges, the bins and the running counts.
    pairs = cut(year_pairs(df, cols, by, date))
    keys = [*by, "variable", "year_a", "year_b"]
    values = psi(pairs, keys, "value", "side")
    ks = ks_two_sample(pairs.withColumn("side", F.when(F.col("side") == "e", "a").otherwise("b")), keys, "value", "side")
    out = attach(values, ks.select(*keys, "ks", "ks_p"), keys)
    worst = out.groupBy(*by, "variable").agg(F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_psi"))
    grade = F.when(F.col("max_psi") > 0.25, "severo").when(F.col("max_psi") > 0.10, "moderado").otherwise("ninguno")
    return attach(out, worst, [*by, "variable"]).withColumn("severity", grade)


def drift_summary(drift: DataFrame, findings: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Worst PSI, count and names of severe variables, high findings."""
    by = list(by)
    per = drift.groupBy(*by, "variable").agg(F.max("max_psi").alias("max_psi"), F.max("severity").alias("severity"))
    severe = F.col("severity") == "severo"
    out = per.groupBy(*by).agg(
        F.max("max_psi").alias("psi_max"), F.count_if(severe).alias("n_severe"), F.array_join(F.sort_array(F.collect_list(F.when(severe, F.col("variable")))), ",").alias("severe_vars")
    )
    if findings is None:
        return out
    high = findings.groupBy(*by).agg(F.count_if(F.col("severity") == "high").alias("n_high"))
    return attach(out, high, by)


def drift_baseline(history: DataFrame, numeric: Sequence[str] = NUMERIC_FEATURES, categorical: Sequence[str] = CATEGORICAL_FEATURES, by: str = VARIETY, date: str = DATE, row_id: str = ROW_ID) -> dict[str, DataFrame]:
    """State tables per variety: ``numeric`` percentiles, value ``counts``, ``levels``, ``window``."""
    numeric = [c for c in numeric if c in history.columns]
    categorical = [c for c in categorical if c in history.columns]
    long = melt(history, [by, row_id], numeric)
    keys = [by, "variable"]
    q = quantiles(long, keys, {"p05": ("value", 0.05), "p25": ("value", 0.25), "center": ("value", 0.5), "p75": ("value", 0.75), "p95": ("value", 0.95)})
    n = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"))
    stats = attach(q, n, keys).withColumn("scale", F.greatest(F.col("p75") - F.col("p25"), F.lit(1e-9)))
    stats = stats.where(F.col("n_samples") >= MIN_HISTORY)
    # Every value of the history, as counts.
    value_counts = long.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    items = F.array(*[F.struct(F.lit(c).alias("variable"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("level")) for c in categorical])
    cats = history.select(by, F.explode(items).alias("_i")).select(by, "_i.*") if categorical else None
    levels = None
    if cats is not None:
        counts = cats.groupBy(by, "variable", "level").agg(F.count(F.lit(1)).alias("_c"))
        total = counts.groupBy(by, "variable").agg(F.sum("_c").alias("_t"))
        levels = attach(counts, total, [by, "variable"]).select(by, "variable", "level", (F.col("_c") / F.col("_t")).alias("freq"))
    window = history.groupBy(by).agg(F.min(date).alias("date_from"), F.max(date).alias("date_to"), F.count(F.lit(1)).alias("n_history"))
    return {"numeric": stats, "counts": value_counts, "levels": levels, "window": window}


def wide_baseline(stats: DataFrame, numeric: Sequence[str], by: str = VARIETY) -> DataFrame:
    """One row per variety with ``<column>__center`` and so on."""
    aggs = [
        F.max(F.when(F.col("variable") == c, F.col(k))).alias(f"{c}__{k}") for c in numeric for k in ("center", "scale", "p05", "p95")
    ]
    return stats.groupBy(by).agg(*aggs)


def worse(*status: Column) -> Column:
    """The most serious of several statuses."""
    any_alert, any_warn = F.lit(False), F.lit(False)
    for s in status:
        any_alert = any_alert | F.coalesce(s == "alert", F.lit(False))
        any_warn = any_warn | F.coalesce(s == "warning", F.lit(False))
    return F.when(any_alert, "alert").when(any_warn, "warning").otherwise("ok")


def row_drift(df: DataFrame, baseline: dict[str, DataFrame], numeric: Sequence[str] = NUMERIC_FEATURES, categorical: Sequence[str] = CATEGORICAL_FEATURES, by: str = VARIETY) -> DataFrame:
    """Per row: features with robust z or share, worst status, mean score, verdict.

    Works on batch and streaming frames: one join with the wide baseline and one per text
    column, no shuffle of the rows while the baseline is small enough to broadcast.
    """
    numeric = [c for c in numeric if c in df.columns]
    categorical = [c for c in categorical if c in df.columns and baseline["levels"] is not None]
    out = attach(df, wide_baseline(baseline["numeric"], numeric, by).withColumn("_based", F.lit(True)), [by])
    for c in categorical:
        levels = baseline["levels"].where(F.col("variable") == c)
        freq = levels.select(by, F.col("level").alias(f"_lv_{c}"), F.col("freq").alias(f"_fq_{c}"))
        out = attach(out.withColumn(f"_lv_{c}", F.col(c).cast("string")), freq, [by, f"_lv_{c}"])
    features, statuses, parts, used = [], [], [], []
    null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def item(name, value, text, center, scale, freq, z, status):
        return F.struct(
            F.lit(name).alias("feature"), value.alias("value"), text.alias("value_str"), center.alias("baseline_median"), scale.alias("baseline_iqr"),
            freq.alias("baseline_freq"), z.alias("z_score"), status.alias("status"),
        )

    for c in numeric:
        known = F.col(f"{c}__center").isNotNull()
        z = (F.col(c).cast("double") - F.col(f"{c}__center")) / F.col(f"{c}__scale")
        status = F.when(F.abs(z) >= Z_ALERT, "alert").when(F.abs(z) >= Z_OK, "warning").otherwise("ok")
        features.append(F.when(known, item(c, F.col(c).cast("double"), F.when(F.col(c).isNull(), "no enviado"), F.col(f"{c}__center"), F.col(f"{c}__scale"), null_d, z, status)))
        statuses.append(F.when(known, status))
        parts.append(F.coalesce(F.least(F.abs(z) / Z_ALERT, F.lit(1.0)), F.lit(0.0)))
        used.append(z.isNotNull().cast("int"))
    for c in categorical:
        given = F.col(c).isNotNull() & F.col("_based")
        freq = F.coalesce(F.col(f"_fq_{c}"), F.lit(0.0))
        status = F.when(freq <= 0, "alert").when(freq < RARE_SHARE, "warning").otherwise("ok")
        features.append(F.when(given, item(c, null_d, F.col(c).cast("string"), null_d, null_d, freq, null_d, status)))
        statuses.append(F.when(given, status))
        parts.append(F.when(given, F.when(freq <= 0, 1.0).when(freq < RARE_SHARE, 0.5).otherwise(0.0)).otherwise(0.0))
        used.append(F.coalesce(given, F.lit(False)).cast("int"))
    n = sum(used, F.lit(0))
    based = F.col("_based").isNotNull()
    out = out.select(
        *df.columns,
        F.when(based, sum(parts, F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("drift_score"),
        F.when(based, worse(*statuses)).alias("drift_status"),
        F.when(based, F.array_compact(F.array(*features))).alias("per_feature"),
    )
    text = F.when(F.col("drift_status") == "ok", "confiable").when(F.col("drift_status") == "warning", "moderada").when(F.col("drift_status") == "alert", "extrapolando")
    return out.withColumn("drift_verdict", text)


def unseen_categories(observed: DataFrame, levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed levels that the baseline does not know."""
    return observed.join(levels.select(*keys).distinct(), list(keys), "left_anti")


def category_outer_align(observed: DataFrame, levels: DataFrame, keys: Sequence[str], eps: float = EPS_BATCH) -> DataFrame:
    """All levels of both sides with their shares, floored at eps."""
    o = observed.select(*keys, F.col("share").alias("_o"))
    b = levels.select(*keys, F.col("freq").alias("_b"))
    both = o.join(b, list(keys), "full")
    return both.select(
        *keys, F.greatest(F.coalesce("_o", F.lit(0.0)), F.lit(eps)).alias("observed"), F.greatest(F.coalesce("_b", F.lit(0.0)), F.lit(eps)).alias("expected"),
        (F.coalesce("_b", F.lit(0.0)) <= 0).alias("unseen"),
    )


def psi_status(value: Column) -> Column:
    return F.when(value < 0.10, "ok").when(value < 0.25, "warning").otherwise("alert")


def psi_numeric_fixed(observed: DataFrame, stats: DataFrame, counts: DataFrame, keys: Sequence[str], base_keys: Sequence[str]) -> DataFrame:
    """PSI on the baseline's 5/25/50/75/95 percentiles.

    ``observed`` is long (keys, variable, value), ``counts`` has (base keys, variable, value,
    n). Baseline shares come from the counts, or are the nominal ones when there are none.
    """
    pts = F.array("p05", "p25", "center", "p75", "p95")
    # Running maximum keeps the edges in order; repeats merge their bins.
    ordered = F.aggregate(pts, F.array().cast("array<double>"), lambda acc, x: F.array_append(acc, F.greatest(x, F.coalesce(F.try_element_at(acc, F.lit(-1)), x))))
    on = [*base_keys, "variable"]
    edges = stats.select(*on, F.array_distinct(ordered).alias("_e"), "n_samples")
    sized = edges.withColumn("_k", F.size("_e") + 1)

    def count(df, group, weight):
        return attach(df, sized, on).where(F.col("_k").isNotNull()).groupBy(*group, edge_bin_left(F.col("value"), F.col("_e")).alias("bin")).agg(F.sum(weight).alias("c"))

    base = count(counts, on, F.col("n"))
    base_total = base.groupBy(*on).agg(F.sum("c").alias("_t"))
    base = attach(base, base_total, on).select(*on, "bin", (F.col("c") / F.col("_t")).alias("_share"))
    seen = count(observed, [*keys, *[k for k in on if k not in keys]], F.lit(1))
    group = [*keys, *[k for k in on if k not in keys]]
    n = seen.groupBy(*group).agg(F.sum("c").alias("n_observed"))
    grid = attach(n, sized, on).withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    nominal = F.when(F.col("_k") == 6, F.get(F.array(*[F.lit(s) for s in SHARES]), F.col("bin"))).otherwise(1.0 / F.col("_k"))
    grid = attach(attach(grid, base, [*on, "bin"]), seen, [*group, "bin"])
    has = attach(grid, base_total, on)
    e = F.when(F.col("_t") >= MIN_HISTORY, F.coalesce(F.col("_share"), F.lit(0.0))).otherwise(nominal)
    e = F.greatest(e, F.lit(EPS_BATCH))
    a = F.greatest(F.coalesce(F.col("c"), F.lit(0)) / F.col("n_observed"), F.lit(EPS_BATCH))
    out = has.groupBy(*group).agg(F.max("n_observed").alias("n_observed"), F.sum((a - e) * F.log(a / e)).alias("psi"))
    return out.withColumn("psi_status", psi_status(F.col("psi")))


def psi_categorical(counts: DataFrame, levels: DataFrame, keys: Sequence[str], base_keys: Sequence[str]) -> DataFrame:
    """PSI over the union of levels and the number of unseen ones.

    ``counts`` has (keys, variable, level, n).
    """
    group, on = [*keys, "variable"], [*base_keys, "variable"]
    total = counts.groupBy(*group).agg(F.sum("n").alias("n_observed"))
    # Every observed group meets every level of its own baseline.
    every = total.select(*group).join(levels, on).select(*group, "level", "freq")
    seen = attach(counts, total, group).select(*group, "level", (F.col("n") / F.col("n_observed")).alias("_o"))
    both = seen.join(every, [*group, "level"], "full")
    o = F.greatest(F.coalesce("_o", F.lit(0.0)), F.lit(EPS_BATCH))
    b = F.greatest(F.coalesce("freq", F.lit(0.0)), F.lit(EPS_BATCH))
    unseen = (F.coalesce("freq", F.lit(0.0)) <= 0) & (F.coalesce("_o", F.lit(0.0)) > 0)
    out = both.groupBy(*group).agg(F.sum((o - b) * F.log(o / b)).alias("psi"), F.count_if(unseen).alias("n_unseen"))
    return attach(out, total, group).withColumn("psi_status", psi_status(F.col("psi")))


def ks_against(observed: DataFrame, counts: DataFrame, keys: Sequence[str], base_keys: Sequence[str], least: int = MIN_HISTORY) -> DataFrame:
    """KS of each batch against the value counts of its baseline, by looking its values up.

    Between two values of a batch its distribution function is flat, so the largest gap is at
    one of its values or just before it: the baseline's running counts there are all it takes,
    and the baseline is not repeated for each batch.
    """
    on, group = [*base_keys, "variable"], [*keys, "variable"]
    own = observed.where(F.col("value").isNotNull()).groupBy(*group, "value").agg(F.count(F.lit(1)).alias("b"))
    zero = own.select(*on, "value").distinct().withColumn("n", F.lit(0).cast("bigint"))
    axis = counts.select(*on, "value", "n").unionByName(zero).groupBy(*on, "value").agg(F.sum("n").alias("n"))
    axis = running(axis, on, [F.col("value")], {"cum_a": F.col("n")})
    total = counts.groupBy(*on).agg(F.sum("n").alias("n_a"))
    batch = running(own, group, [F.col("value")], {"cum_b": F.col("b")})
    size = own.groupBy(*group).agg(F.sum("b").alias("n_b"))
    met = attach(attach(attach(batch, axis, [*on, "value"]), total, on), size, group)
    at = F.abs(F.col("cum_a") / F.col("n_a") - F.col("cum_b") / F.col("n_b"))
    before = F.abs((F.col("cum_a") - F.col("n")) / F.col("n_a") - (F.col("cum_b") - F.col("b")) / F.col("n_b"))
    out = met.where(F.col("n_a").isNotNull()).groupBy(*group).agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.max(F.greatest(at, before)).alias("ks"))
    enough = (F.col("n_a") >= least) & (F.col("n_b") >= least)
    return out.withColumn("ks", F.when(enough, F.col("ks"))).withColumn("ks_p", ks_tail("ks", F.col("n_a").cast("double"), F.col("n_b").cast("double")))


def batch_drift(df: DataFrame, baseline: dict[str, DataFrame], numeric: Sequence[str] = NUMERIC_FEATURES, categorical: Sequence[str] = CATEGORICAL_FEATURES, by: str = VARIETY, batch: str = "batch") -> DataFrame:
    """Feature rows (by, batch, variable): PSI with KS or chi-square and the merged status.

    Batches under 30 rows give nothing.
    """
    keys = [by, batch]
    numeric = [c for c in numeric if c in df.columns]
    categorical = [c for c in categorical if c in df.columns]
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_BATCH)
    rows = attach(df, big, keys).where(F.col("_n").isNotNull()).drop("_n")
    long = melt(rows, keys, numeric)
    p = psi_numeric_fixed(long, baseline["numeric"], baseline["counts"], keys, [by])
    ks = ks_against(long, baseline["counts"], keys, [by])
    num = attach(p, ks.select(*keys, "variable", "ks", "ks_p"), [*keys, "variable"])
    num = num.withColumn("status", F.when((F.col("psi_status") == "ok") & (F.col("ks_p") < 0.05), "warning").otherwise(F.col("psi_status")))
    null_d = F.lit(None).cast("double")
    num = num.select(*keys, "variable", F.lit("numeric").alias("kind"), "n_observed", "psi", "psi_status", F.col("ks").alias("statistic"), F.col("ks_p").alias("p_value"), F.lit(0).cast("bigint").alias("n_unseen"), "status")
    if not categorical or baseline["levels"] is None:
        return num
    items = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in categorical])
    counts = rows.select(*keys, F.explode(items).alias("_i")).select(*keys, "_i.*").where("level IS NOT NULL").groupBy(*keys, "variable", "level").agg(F.count(F.lit(1)).alias("n"))
    c = psi_categorical(counts, baseline["levels"], keys, [by])
    chi = chi2_goodness(counts, baseline["levels"], "level", [*keys, "variable"], [by, "variable"])
    cat = attach(c, chi.select(*keys, "variable", "chi2", "chi2_p"), [*keys, "variable"])
    status = F.when(F.col("n_unseen") > 0, "alert").when((F.col("psi_status") == "ok") & (F.col("chi2_p") < 0.05), "warning").otherwise(F.col("psi_status"))
    cat = cat.select(*keys, "variable", F.lit("categorical").alias("kind"), "n_observed", "psi", "psi_status", F.coalesce("chi2", null_d).alias("statistic"), F.col("chi2_p").alias("p_value"), "n_unseen", status.alias("status"))
    return num.unionByName(cat)


def batch_report(features: DataFrame, by: str = VARIETY, batch: str = "batch") -> DataFrame:
    """One row per batch: mean PSI (each at most 1) and the worst status."""
    s = F.max(F.when(F.col("status") == "alert", 2).when(F.col("status") == "warning", 1).otherwise(0))
    out = features.groupBy(by, batch).agg(F.avg(F.least("psi", F.lit(1.0))).alias("score"), s.alias("_s"))
    return out.select(by, batch, "score", F.get(F.array(F.lit("ok"), F.lit("warning"), F.lit("alert")), F.col("_s")).alias("status"))


def drift_status_counts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    out = scored.groupBy(*by).agg(*[F.count_if(F.col("drift_status") == s).alias(f"n_{s}") for s in ("ok", "warning", "alert")])
    return out.withColumn("n_flagged", F.col("n_warning") + F.col("n_alert"))
