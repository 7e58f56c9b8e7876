"""The same operators on arriving forecasts and actuals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from furrow.columns import DATE, FARM, FORMAT, ROW_ID, VARIETY
from furrow.functions.scalar import edge_bin_left
from furrow.operators.cleaning import Rule, normalize_batch, rule_issues
from furrow.operators.drift import EPS_BATCH, psi_status, row_drift
from furrow.operators.groups import attach


def file_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available into a Parquet folder and stop; restartable."""
    return (
        df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def run_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _put(df: DataFrame, path: str, batch: int) -> None:
    """Idempotent per batch: a replayed batch overwrites its own folder."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stream_validate(stream: DataFrame, rules: Sequence[Rule], good: str, issues: str, checkpoint: str, row_id: str = ROW_ID) -> StreamingQuery:
    """Good rows to one folder and issue rows to another, batch by batch."""
    ok = F.lit(True)
    for rule in rules:
        if rule.column in stream.columns:
            ok = ok & F.expr(rule.ok)

    def handle(batch: DataFrame, number: int) -> None:
        clean = normalize_batch(batch).persist()
        try:
            _put(clean.where(ok), good, number)
            _put(rule_issues(clean, rules, row_id), issues, number)
        finally:
            clean.unpersist()

    return run_batches(stream, handle, checkpoint)


def stream_row_drift(stream: DataFrame, baseline: dict[str, DataFrame], numeric: Sequence[str], categorical: Sequence[str], by: str = VARIETY) -> DataFrame:
    """Row drift of arriving rows: joins with a static baseline, no state."""
    return row_drift(stream, baseline, numeric, categorical, by)


def drift_counts(stream: DataFrame, edges: DataFrame, numeric: Sequence[str], time: str, by: str = VARIETY, size: str = "7 days", delay: str = "1 day", start: str = "4 days") -> DataFrame:
    """Bin counts per (variety, window, variable); rows later than the delay are dropped.

    ``edges`` has (by, variable, e) with the sorted inner edges of the baseline.
    """
    items = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in numeric])
    long = stream.withWatermark(time, delay).select(by, time, F.explode(items).alias("_i")).select(by, time, "_i.*").where("value IS NOT NULL")
    binned = attach(long, edges, [by, "variable"]).where(F.col("e").isNotNull()).withColumn("bin", edge_bin_left(F.col("value"), F.col("e")))
    win = F.window(time, size, size, start)
    return binned.groupBy(by, win, "variable", "bin").agg(F.count(F.lit(1)).alias("c")).select(by, F.col("window.start").alias("window_start"), "variable", "bin", "c")


def psi_from_counts(counts: DataFrame, shares: DataFrame, by: str = VARIETY) -> DataFrame:
    """PSI of closed windows from their bin counts and the baseline's (by, variable, bin, share)."""
    group = [by, "window_start", "variable"]
    total = counts.groupBy(*group).agg(F.sum("c").alias("n_observed"))
    grid = total.join(shares, [by, "variable"])
    both = attach(grid, counts, [*group, "bin"])
    e = F.greatest(F.col("share"), F.lit(EPS_BATCH))
    a = F.greatest(F.coalesce(F.col("c"), F.lit(0)) / F.col("n_observed"), F.lit(EPS_BATCH))
    out = both.groupBy(*group).agg(F.max("n_observed").alias("n_observed"), F.sum((a - e) * F.log(a / e)).alias("psi"))
    return out.withColumn("psi_status", psi_status(F.col("psi")))


def stream_batch_drift(stream: DataFrame, edges: DataFrame, shares: DataFrame, numeric: Sequence[str], time: str, path: str, checkpoint: str, by: str = VARIETY, **window) -> StreamingQuery:
    """PSI per variety and window, written when the watermark closes the window."""
    counts = drift_counts(stream, edges, numeric, time, by, **window)

    def handle(batch: DataFrame, number: int) -> None:
        _put(psi_from_counts(batch, shares, by), path, number)

    return run_batches(counts, handle, checkpoint)


def stream_weekly(points: DataFrame, time: str, by: Sequence[str] = (), delay: str = "7 days") -> DataFrame:
    """Weekly sums of matched points in seven-day windows that start on Monday."""
    win = F.window(time, "7 days", "7 days", "4 days")
    out = points.withWatermark(time, delay).groupBy(*by, win).agg(F.sum("pred_original").alias("proj_sum"), F.sum("real").alias("real_sum"), F.count(F.lit(1)).alias("n"))
    pct = F.when(F.col("real_sum") != 0, (F.col("proj_sum") - F.col("real_sum")) / F.col("real_sum") * 100.0)
    return out.select(*by, F.to_date("window.start").alias("week_start"), "proj_sum", "real_sum", "n", pct.alias("pct_diff"))


def stream_dedup_forecasts(stream: DataFrame, time: str, keys: Sequence[str] = (FARM, FORMAT, DATE), delay: str = "1 day") -> DataFrame:
    """One forecast per key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_match(forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str], f_time: str, a_time: str, band: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Forecasts and actuals of one key whose times lie within a band of each other.

    Both sides carry a watermark and the band bounds the state each keeps.
    """
    f = forecasts.withWatermark(f_time, delay)
    a = actuals.withWatermark(a_time, delay)
    for k in keys:
        a = a.withColumnRenamed(k, f"_a_{k}")
    cond = F.expr(f"{a_time} >= {f_time} - INTERVAL {band} AND {a_time} <= {f_time} + INTERVAL {band}")
    for k in keys:
        cond = cond & (f[k] == a[f"_a_{k}"])
    return f.join(a, cond, "inner").drop(*[f"_a_{k}" for k in keys])
