"""Filters, schema checks and batch validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.columns import (
    CATEGORICAL_FEATURES,
    DATE,
    FARMS,
    FORMATS,
    LEAKAGE,
    MAX_BATCH_ROWS,
    NUMERIC_FEATURES,
    NUMERIC_RANGES,
    ROW_ID,
    TARGET,
    VARIETY,
)
from furrow.functions.scalar import normalize_text


def number(col: str) -> Column:
    return F.expr(f"try_cast({col} AS double)")


def clean_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows whose target is a positive number."""
    value = number(target)
    return df.withColumn(target, value).where((F.col(target) > 0) & ~F.isnan(target))


def target_report(df: DataFrame, target: str = TARGET) -> DataFrame:
    raw, value = F.col(target), number(target)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(raw.isNull()).alias("n_null"),
        F.count_if(raw.isNotNull() & value.isNull()).alias("n_text"),
        F.count_if(value <= 0).alias("n_nonpositive"),
        F.count_if(value > 0).alias("n_kept"),
    )


def dedup_rows(df: DataFrame) -> DataFrame:
    """Exact duplicate rows dropped; the aggregate combines copies before the shuffle."""
    return df.dropDuplicates()


def clean_dates(df: DataFrame, date: str = DATE) -> DataFrame:
    """Dates coerced, invalid rows dropped."""
    return df.withColumn(date, F.expr(f"try_cast({date} AS date)")).where(F.col(date).isNotNull())


def select_features(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Model inputs only: required columns checked, text trimmed, numbers cast."""
    needed = [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES, DATE]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(
        *extra,
        *[number(c).alias(c) for c in NUMERIC_FEATURES],
        *[F.trim(F.col(c).cast("string")).alias(c) for c in CATEGORICAL_FEATURES],
        DATE,
    )


def aligned_business_columns(df: DataFrame, target: str = TARGET, date: str = DATE) -> DataFrame:
    """Leakage columns of exactly the rows the features keep, by row id."""
    kept = clean_dates(clean_target(df, target), date)
    return kept.select(ROW_ID, *[number(c).alias(c) for c in LEAKAGE])


def check_types(df: DataFrame, numeric: Sequence[str], date: str | None = None) -> DataFrame:
    """Values that a cast would lose, one row per column."""
    checks = {c: F.count_if(F.col(c).isNotNull() & number(c).isNull()) for c in numeric}
    if date:
        checks[date] = F.count_if(F.col(date).isNotNull() & F.expr(f"try_cast({date} AS date)").isNull())
    return _melt(df.agg(*[v.alias(k) for k, v in checks.items()]), checks, "n_bad")


def _melt(row: DataFrame, names, value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("bigint").alias(value)) for n in names])
    return row.select(F.inline(pairs))


def check_ranges(df: DataFrame, rules: dict[str, tuple] | None = None) -> DataFrame:
    """Rows below and above the bounds, in one pass."""
    rules = {c: b for c, b in (rules or NUMERIC_RANGES).items() if c in df.columns}
    aggs, items = [], []
    for c, (low, high) in rules.items():
        v = number(c)
        aggs.append((F.count_if(v < low) if low is not None else F.lit(0)).cast("bigint").alias(f"{c}__low"))
        aggs.append((F.count_if(v > high) if high is not None else F.lit(0)).cast("bigint").alias(f"{c}__high"))
        items.append(F.struct(F.lit(c).alias("column"), F.col(f"{c}__low").alias("n_low"), F.col(f"{c}__high").alias("n_high")))
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def check_duplicates(df: DataFrame) -> DataFrame:
    counted = df.groupBy(*df.columns).count()
    return counted.agg(F.coalesce(F.sum("count") - F.count(F.lit(1)), F.lit(0)).cast("bigint").alias("n_duplicates"))


def check_zero_variance(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Constant numeric columns and single-level text columns."""
    cols = [*numeric, *categorical]
    same = {c: ((F.count(c) > 0) & F.coalesce(F.min(c) == F.max(c), F.lit(False))).cast("int") for c in cols}
    out = _melt(df.agg(*[v.alias(k) for k, v in same.items()]), cols, "constant")
    return out.where("constant = 1").select("column")


def validate_dataset(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], date: str | None = None) -> DataFrame:
    """Every check as rows (check, column, n); nothing is raised."""
    types = check_types(df, numeric, date).where("n_bad > 0").selectExpr("'types' AS check", "column", "n_bad AS n")
    ranges = check_ranges(df)
    low = ranges.where("n_low > 0").selectExpr("'below_range' AS check", "column", "n_low AS n")
    high = ranges.where("n_high > 0").selectExpr("'above_range' AS check", "column", "n_high AS n")
    dups = check_duplicates(df).where("n_duplicates > 0").selectExpr("'duplicates' AS check", "'*' AS column", "n_duplicates AS n")
    const = check_zero_variance(df, numeric, categorical).selectExpr("'zero_variance' AS check", "column", "cast(1 AS bigint) AS n")
    return types.unionByName(low).unionByName(high).unionByName(dups).unionByName(const)


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule when ``ok`` (a SQL predicate) is not true."""

    column: str
    ok: str
    reason: str


def range_rule(column: str, low: float, high: float, optional: bool = False) -> Rule:
    test = f"coalesce(try_cast({column} AS double) BETWEEN {low} AND {high}, false)"
    return Rule(column, f"({column} IS NULL OR {test})" if optional else test, f"must be between {low} and {high}")


def member_rule(column: str, allowed: Sequence[str]) -> Rule:
    values = ", ".join("'" + a.replace("'", "''") + "'" for a in allowed)
    return Rule(column, f"coalesce({column} IN ({values}), false)", "value not allowed")


# Bounds of the forecast request.
REQUEST_RULES = [
    Rule("fecha", "try_cast(fecha AS date) IS NOT NULL", "invalid date"),
    range_rule("kg_ha", 0.001, 100000),
    range_rule("dpc", 0, 400),
    range_rule("ha", 0.001, 10000),
    range_rule("dia_cosecha", 0, 365),
    member_rule("formato", FORMATS),
    member_rule("fundo", FARMS),
    range_rule("indus_pct", 0, 100, optional=True),
    range_rule("p_baya", 0.001, 100, optional=True),
    range_rule("horas_efectivas", 0, 24, optional=True),
]
REQUIRED = ["variedad", "fecha", "kg_ha", "dpc", "ha", "dia_cosecha", "formato", "fundo"]


def normalize_batch(df: DataFrame) -> DataFrame:
    """Text keys trimmed, upper case, single spaces; blank optionals to null."""
    for c in ("variedad", "fundo", "formato"):
        if c in df.columns:
            df = df.withColumn(c, normalize_text(F.col(c).cast("string")))
    for c in ("indus_pct", "p_baya", "horas_efectivas", "external_id"):
        if c in df.columns and dict(df.dtypes)[c] == "string":
            df = df.withColumn(c, F.when(~F.trim(F.col(c)).isin("", "nan"), F.col(c)))
    return df


def rule_issues(df: DataFrame, rules: Sequence[Rule], row_id: str = ROW_ID) -> DataFrame:
    """All violations as rows (row, column, value, reason) in one pass."""
    broken = [
        F.when(
            ~F.expr(rule.ok),
            F.struct(
                F.lit(rule.column).alias("column"),
                F.coalesce(F.col(rule.column).cast("string"), F.lit("(empty)")).alias("value"),
                F.lit(rule.reason).alias("reason"),
            ),
        )
        for rule in rules
        if rule.column in df.columns
    ]
    return df.select(F.col(row_id).cast("string").alias("row"), F.explode(F.array_compact(F.array(*broken))).alias("_i")).select("row", "_i.*")


def validate_batch(
    df: DataFrame,
    rules: Sequence[Rule] = REQUEST_RULES,
    required: Sequence[str] = REQUIRED,
    varieties: DataFrame | None = None,
    max_rows: int | None = None,
    row_id: str = ROW_ID,
) -> DataFrame:
    """Issue table of a batch.

    Missing columns block everything; otherwise every violated rule of every row is listed.
    With ``max_rows`` (MAX_BATCH_ROWS for a request) a variety with more rows is listed once
    and its rows are not; other varieties are not affected.
    """
    spark = df.sparkSession
    df = normalize_batch(df)
    missing = [c for c in required if c not in df.columns]
    if missing:
        rows = [("0", c, "(absent)", "required column missing") for c in missing]
        return spark.createDataFrame(rows, "row string, column string, value string, reason string")
    if max_rows is None:
        return _row_issues(df, rules, varieties, row_id)
    oversized = df.groupBy(VARIETY).count().where(F.col("count") > max_rows)
    blocks = oversized.select(
        F.lit("0").alias("row"),
        F.lit(VARIETY).alias("column"),
        F.col(VARIETY).alias("value"),
        F.concat(F.col("count").cast("string"), F.lit(f" rows exceed the maximum of {max_rows}")).alias("reason"),
    )
    big = oversized.select(F.col(VARIETY).alias("_big"))
    free = df.join(big, df[VARIETY].eqNullSafe(big["_big"]), "left_anti")
    return blocks.unionByName(_row_issues(free, rules, varieties, row_id))


def _row_issues(df: DataFrame, rules: Sequence[Rule], varieties: DataFrame | None, row_id: str) -> DataFrame:
    issues = rule_issues(df, rules, row_id)
    if varieties is not None:
        known = varieties.select(F.upper(F.col(VARIETY)).alias(VARIETY)).distinct()
        unknown = df.join(known, VARIETY, "left_anti").select(
            F.col(row_id).cast("string").alias("row"),
            F.lit(VARIETY).alias("column"),
            F.coalesce(F.col(VARIETY), F.lit("(empty)")).alias("value"),
            F.lit("unknown variety").alias("reason"),
        )
        issues = issues.unionByName(unknown)
    return issues


def align_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly ``{name: type}`` in order: missing ones null, extras and blank rows dropped."""
    out = df.select(
        *[(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()]
    )
    return out.where(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull())


def validate_predictions(scored: DataFrame, inputs: DataFrame, pred: str, low: str, high: str, row_id: str = ROW_ID) -> DataFrame:
    """Count of bad values and whether every input row has exactly one prediction."""

    def bad(c: str) -> Column:
        v = F.col(c)
        return v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))

    per_row = scored.groupBy(row_id).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(bad(pred) | bad(low) | bad(high)).alias("_bad")
    )
    both = inputs.select(row_id).join(per_row, row_id, "left")
    return both.agg(
        F.coalesce(F.sum("_bad"), F.lit(0)).cast("bigint").alias("n_invalid"),
        F.count_if(F.coalesce(F.col("_n"), F.lit(0)) != 1).alias("n_unmatched"),
    )


def quality_metrics(df: DataFrame, groups: Sequence[str], date: str = DATE, by: Sequence[str] = ()) -> DataFrame:
    """Rows, columns, duplicates, missing share, distinct groups and date range.

    Copies are combined first, so duplicates and the rest come from one aggregation.
    """
    by = list(by)
    cols = [c for c in df.columns if c not in by]
    unique = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    missing = sum((F.col(c).isNull().cast("bigint") for c in cols), F.lit(0).cast("bigint"))
    out = unique.groupBy(*by).agg(
        F.sum("_copies").alias("n_rows"),
        F.lit(len(cols)).cast("bigint").alias("n_cols"),
        (F.sum("_copies") - F.count(F.lit(1))).alias("n_duplicates"),
        F.sum(missing * F.col("_copies")).alias("n_missing"),
        *[F.count_distinct(g).alias(f"n_{g}") for g in groups],
        F.min(date).alias("date_min"),
        F.max(date).alias("date_max"),
    )
    return out.withColumn("missing_ratio", F.col("n_missing") / (F.col("n_rows") * F.col("n_cols")))
