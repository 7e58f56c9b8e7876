"""Value counts, average ranks and two-sample statistics without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.stats import chi2_tail, ks_tail, normal_two_sided
from furrow.operators.groups import attach
from furrow.operators.ordered import running
from furrow.session import cut


def value_counts(df: DataFrame, keys: Sequence[str], col: str, sums: dict | None = None) -> DataFrame:
    """One row per key and value with counts, running counts included; copies combine first."""
    aggs = sums or {"c": F.count(F.lit(1))}
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("value")).agg(*[a.alias(n) for n, a in aggs.items()])
    return running(counts, list(keys), ["value"], {f"cum_{n}": F.col(n) for n in aggs})


def average_rank(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    """Mean rank of each row's value in its group; ties share it."""
    cum = value_counts(df, keys, col)
    ranks = cum.select(*keys, F.col("value").alias(col), (F.col("cum_c") - (F.col("c") - 1) / 2.0).alias(name))
    return attach(df, ranks, [*keys, col])


def two_sample(df: DataFrame, keys: Sequence[str], col: str, side: str, weight: str | None = None) -> DataFrame:
    """Running counts of sides ``a`` and ``b`` over the joint distinct values.

    ``weight`` holds copies when the rows are already counted.
    """
    w = F.col(weight) if weight else F.lit(1)
    sums = {s: F.coalesce(F.sum(F.when(F.col(side) == s, w)), F.lit(0)).cast("bigint") for s in ("a", "b")}
    return value_counts(df, keys, col, sums)


def ks_two_sample(df: DataFrame, keys: Sequence[str], col: str, side: str, least: int = 30) -> DataFrame:
    """Largest gap of the two distribution functions and its asymptotic p-value."""
    # Values are counted and written once: sizes, running counts and totals read the counts.
    counts = cut(df.where(F.col(col).isNotNull()).groupBy(*keys, col, side).agg(F.count(F.lit(1)).alias("_w")))
    cum = two_sample(counts, keys, col, side, "_w")
    n = counts.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(side) == s, F.col("_w"))), F.lit(0)).cast("bigint").alias(f"n_{s}") for s in ("a", "b")])
    gap = F.abs(F.try_divide(F.col("cum_a"), F.col("n_a")) - F.try_divide(F.col("cum_b"), F.col("n_b")))
    out = attach(cum, n, keys).groupBy(*keys).agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.max(gap).alias("ks"))
    enough = (F.col("n_a") >= least) & (F.col("n_b") >= least)
    return out.withColumn("ks", F.when(enough, F.col("ks"))).withColumn("ks_p", ks_tail("ks", F.col("n_a").cast("double"), F.col("n_b").cast("double")))


def mann_whitney(df: DataFrame, keys: Sequence[str], col: str, side: str, least: int = 3, weight: str | None = None, cum: DataFrame | None = None) -> DataFrame:
    """U of side a, normal p-value with ties and continuity, and Cliff's delta 2U/(nm) - 1."""
    cum = two_sample(df, keys, col, side, weight) if cum is None else cum
    t = F.col("a") + F.col("b")
    rank = F.col("cum_a") + F.col("cum_b") - (t - 1) / 2.0
    out = cum.groupBy(*keys).agg(
        F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * rank).alias("_r"),
        F.sum(t.cast("double") * t * t - t).alias("_ties"),
    )
    return mann_whitney_of(out, keys, least)


def mann_whitney_of(out: DataFrame, keys: Sequence[str], least: int = 3) -> DataFrame:
    """The test from sizes, the rank sum ``_r`` of side a and the tie sum ``_ties``."""
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    u = F.col("_r") - na * (na + 1) / 2.0
    var = na * nb / 12.0 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1)))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - na * nb / 2.0) - 0.5, F.lit(0.0)), F.sqrt(var))
    out = out.withColumn("u", u).withColumn("z", z)
    enough = (F.col("n_a") >= least) & (F.col("n_b") >= least)
    out = out.withColumn("p", F.when(enough, normal_two_sided("z"))).withColumn("delta", F.try_divide(2.0 * F.col("u"), na * nb) - 1.0)
    return out.select(*keys, "n_a", "n_b", "u", "z", "p", "delta")


def kruskal_wallis(df: DataFrame, keys: Sequence[str], col: str, group: str, least: int = 3) -> DataFrame:
    """H with tie correction over groups of at least ``least`` values."""
    rows = df.where(F.col(col).isNotNull())
    big = rows.groupBy(*keys, group).count().where(F.col("count") >= least).drop("count").withColumn("_in", F.lit(True))
    kept = attach(rows, big, [*keys, group]).where("_in").drop("_in")
    per = kept.groupBy(*keys, group, col).agg(F.count(F.lit(1)).alias("_w"))
    cum = value_counts(per, keys, col, {"c": F.sum("_w")})
    ranks = cum.select(*keys, F.col("value").alias(col), (F.col("cum_c") - (F.col("c") - 1) / 2.0).alias("_rank"))
    sums = attach(per, ranks, [*keys, col]).groupBy(*keys, group).agg(F.sum(F.col("_w") * F.col("_rank")).alias("_r"), F.sum("_w").alias("_n"))
    tests = sums.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_s"))
    c = F.col("c").cast("double")
    ties = cum.groupBy(*keys).agg(F.sum(c * c * c - c).alias("_t"))
    out = attach(tests, ties, keys).where(F.col("k") >= 2)
    n = F.col("n").cast("double")
    h = (12.0 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)) / (1 - F.col("_t") / (n * n * n - n))
    out = out.withColumn("h", h)
    return out.select(*keys, "n", "k", "h", chi2_tail("h", (F.col("k") - 1).cast("double")).alias("p"))


def wasserstein(df: DataFrame, keys: Sequence[str], col: str, side: str, weight: str | None = None, cum: DataFrame | None = None) -> DataFrame:
    """W1 = integral of |F_a - F_b| over the joint distinct values."""
    from furrow.operators.ordered import row_frames

    cum = two_sample(df, keys, col, side, weight) if cum is None else cum
    n = cum.groupBy(*keys).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    gap = F.abs(F.try_divide(F.col("cum_a"), F.col("n_a")) - F.try_divide(F.col("cum_b"), F.col("n_b")))
    step = {"_next": lambda w: F.lead("value", 1).over(w)}
    spread = row_frames(attach(cum, n, keys), list(keys), [F.col("value")], 0, step, ahead=1)
    return spread.groupBy(*keys).agg(
        F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"),
        F.coalesce(F.sum(gap * (F.col("_next") - F.col("value"))), F.lit(0.0)).alias("w1"),
    )


def holm(df: DataFrame, p: str, keys: Sequence[str] = (), alpha: float = 0.05, order: Sequence[str] = (), name: str = "rejected") -> DataFrame:
    """Step-down rejection: p of rank i against alpha/(n - i), stopping at the first miss.

    The rows are test results (one per comparison), a table of bounded size.
    """
    from pyspark.sql import Window

    keys = list(keys)
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(F.asc_nulls_last(p), *order)
    n = df.groupBy(*keys).agg(F.count(p).alias("_n"))
    out = attach(df, n, keys).withColumn("_i", F.row_number().over(w) - 1)
    ok = F.coalesce(F.col(p) <= F.try_divide(F.lit(alpha), F.col("_n") - F.col("_i")), F.lit(False))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("_ok", ok).withColumn(name, F.bool_and("_ok").over(upto)).drop("_n", "_i", "_ok")
