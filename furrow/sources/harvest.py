"""Reading, splitting and describing harvest tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from furrow.columns import DEFAULT_FORMAT, HARVEST_NAMES, HIGH_SEASON, LOW_SEASON, VARIETY
from furrow.functions.scalar import hash_bucket
from furrow.operators.groups import attach

MIN_ROWS = 30

# The season months that the POP variety declares for itself.
VARIETY_OVERRIDES = {"POP": {"high_season_months": list(HIGH_SEASON), "low_season_months": list(LOW_SEASON)}}

CONFIG_DEFAULTS = {
    "high_season_months": list(HIGH_SEASON),
    "low_season_months": list(LOW_SEASON),
    "imputer_knn_threshold": 0.30,
    "rare_min_count": 50,
    "training_window_days": None,
    "max_temporal_mape": 35.0,
    "min_temporal_baseline_skill": 0.0,
    "min_temporal_folds": 2,
}
CONFIG_TYPES = {
    "high_season_months": "array<int>",
    "low_season_months": "array<int>",
    "imputer_knn_threshold": "double",
    "rare_min_count": "int",
    "training_window_days": "int",
    "max_temporal_mape": "double",
    "min_temporal_baseline_skill": "double",
    "min_temporal_folds": "int",
}


def read_harvest(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None
) -> DataFrame:
    """Accumulated table with trimmed headers mapped to column names."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    return df.toDF(*[HARVEST_NAMES.get(c.strip(), c.strip()) for c in df.columns])


def _kept_keys(df: DataFrame, min_rows: int, key: str) -> DataFrame:
    return df.groupBy(key).count().where(F.col("count") >= min_rows).select(key)


def _with_clean_key(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).withColumn(key, F.trim(F.col(key).cast("string")))


def split_by_variety(df: DataFrame, min_rows: int = MIN_ROWS, key: str = VARIETY) -> DataFrame:
    """Rows of keys with at least ``min_rows`` rows (counted before dedup), deduplicated."""
    clean = _with_clean_key(df, key)
    kept = _kept_keys(clean, min_rows, key)
    return clean.join(kept, key, "left_semi").select(*df.columns).dropDuplicates()


def write_by_variety(df: DataFrame, path: str, min_rows: int = MIN_ROWS, key: str = VARIETY) -> None:
    """One partition per key; the rebalance hint splits the files of a huge key."""
    split = split_by_variety(df, min_rows, key)
    split.hint("rebalance", key).write.mode("overwrite").partitionBy(key).parquet(path)


def split_summary(df: DataFrame, min_rows: int = MIN_ROWS, key: str = VARIETY) -> DataFrame:
    """Per key: rows written, duplicates dropped, whether the key was skipped."""
    clean = _with_clean_key(df, key)
    counted = clean.groupBy(*clean.columns).count()
    per_key = counted.groupBy(key).agg(F.sum("count").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"))
    skipped = F.col("n_rows") < min_rows
    return per_key.select(
        key,
        F.when(skipped, F.lit(0)).otherwise(F.col("n_unique")).cast("bigint").alias("rows_written"),
        F.when(skipped, F.lit(0)).otherwise(F.col("n_rows") - F.col("n_unique")).cast("bigint").alias("duplicates_dropped"),
        skipped.alias("skipped"),
    )


def sanitize_partition_name(names: DataFrame, col: str) -> DataFrame:
    """Distinct names made safe: illegal characters to ``_``, 31 characters, unique."""
    clean = F.substring(F.trim(F.regexp_replace(F.col(col).cast("string"), r"[\\/?*\[\]:]", "_")), 1, 31)
    distinct = names.select(col).distinct().withColumn("_c", F.when(clean == "", "SIN_NOMBRE").otherwise(clean))
    rank = F.row_number().over(Window.partitionBy("_c").orderBy(col))
    return distinct.withColumn("_r", rank).select(
        col,
        F.when(F.col("_r") == 1, F.col("_c"))
        .otherwise(F.concat(F.substring("_c", 1, 28), F.lit("_"), F.col("_r").cast("string")))
        .alias("partition_name"),
    )


def list_varieties(df: DataFrame, key: str = VARIETY) -> DataFrame:
    return df.select(key).distinct()


def resolve_varieties(df: DataFrame, requested: Sequence[str] | str, key: str = VARIETY) -> DataFrame:
    """Requested names with a ``known`` flag; ``"all"`` gives every key."""
    have = list_varieties(df, key)
    if requested == "all":
        return have.withColumn("known", F.lit(True))
    spark = df.sparkSession
    asked = spark.createDataFrame([(v,) for v in requested], f"{key} string")
    known = have.withColumn("known", F.lit(True))
    return attach(asked, known, [key]).withColumn("known", F.coalesce("known", F.lit(False)))


def dataset_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-insensitive content hash with row and column counts."""
    cols = list(columns or df.columns)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
    h = hash_bucket(text, "fp")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(cols)).cast("bigint").alias("n_cols"),
        F.sum(h).alias("hash_sum"),
        F.bit_xor(h).alias("hash_xor"),
    )


def forecast_inputs(df: DataFrame) -> DataFrame:
    """Forecast request rows: required columns checked, blanks given their defaults."""
    required = ["variedad", "fecha", "kg_ha", "dpc", "ha", "dia_cosecha"]
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")

    def text(c: str) -> Column:
        return F.trim(F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("string")

    def number(c: str) -> Column:
        return F.expr(f"try_cast(nullif(trim(cast({c} AS string)), '') AS double)") if c in df.columns else F.lit(None).cast("double")

    optional = {c: number(c) for c in ("indus_pct", "p_baya", "horas_efectivas")}
    return df.select(
        text("variedad").alias("variedad"),
        F.expr("try_cast(fecha AS date)").alias("fecha"),
        *[number(c).alias(c) for c in ("kg_ha", "dpc", "ha")],
        number("dia_cosecha").cast("int").alias("dia_cosecha"),
        F.when(F.coalesce(text("formato"), F.lit("")) == "", F.lit(DEFAULT_FORMAT)).otherwise(text("formato")).alias("formato"),
        F.coalesce(text("fundo"), F.lit("")).alias("fundo"),
        *[c.alias(n) for n, c in optional.items()],
        F.when(text("external_id") != "", text("external_id")).alias("external_id"),
    )


def read_forecast_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Request table from CSV, every column read as text and then cast."""
    return forecast_inputs(read_harvest(spark, path, "csv"))


def variety_config(spark: SparkSession, overrides: dict[str, dict] | None = None) -> DataFrame:
    """Declared overrides as a table; unknown setting names are rejected."""
    overrides = VARIETY_OVERRIDES if overrides is None else overrides
    for name, values in overrides.items():
        unknown = sorted(set(values) - set(CONFIG_DEFAULTS))
        if unknown:
            raise ValueError(f"{name}: unknown settings {unknown}")
    rows = [(v, *[values.get(k) for k in CONFIG_DEFAULTS]) for v, values in overrides.items()]
    schema = f"{VARIETY} string, " + ", ".join(f"{k} {CONFIG_TYPES[k]}" for k in CONFIG_DEFAULTS)
    return spark.createDataFrame(rows, schema)


def with_variety_config(df: DataFrame, overrides: dict[str, dict] | None = None) -> DataFrame:
    """Settings per row: override of its variety, else the global default."""
    joined = attach(df, variety_config(df.sparkSession, overrides), [VARIETY])

    def default(k: str) -> Column:
        v = CONFIG_DEFAULTS[k]
        lit = F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
        return lit.cast(CONFIG_TYPES[k])

    return joined.select(*df.columns, *[F.coalesce(F.col(k), default(k)).alias(k) for k in CONFIG_DEFAULTS])


def write_profile(profile: DataFrame, path: str, run_id: str, key: str = VARIETY) -> None:
    """Append one run's profile rows, partitioned by variety."""
    stamped = profile.withColumn("run_id", F.lit(run_id)).withColumn("generated_at", F.current_timestamp())
    stamped.write.mode("append").partitionBy(key).parquet(path)


def latest_profile(spark: SparkSession, path: str, key: str = VARIETY) -> DataFrame:
    """Rows of the newest run of each variety."""
    stored = spark.read.parquet(path)
    newest = stored.groupBy(key).agg(F.max_by("run_id", F.struct("generated_at", "run_id")).alias("_run"))
    return attach(stored, newest, [key]).where(F.col("run_id") == F.col("_run")).drop("_run")
