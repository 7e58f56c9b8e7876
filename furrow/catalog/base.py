"""Registry of runnable queries, and the harvest view of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.groups import attach

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(col, digits: int = 6):
    """Rounded value for comparison.

    A shift far below the last digit moves exact ties off the rounding boundary, where
    engines differ; adding zero makes a negative zero plain.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + F.lit(_shift(digits)), digits) + F.lit(0.0)


def rs(expr: str, digits: int = 6) -> str:
    return f"(round({expr} + {_shift(digits)!r}, {digits}) + 0.0)"


def _shift(digits: int) -> float:
    return 1.37 * 10.0 ** -(digits + 3)


def harvest(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as harvest records: supplier = farm, return flag = format."""
    li = table(spark, sf, "lineitem")
    hours = (1 + F.col("l_linenumber")).cast("double")
    rate = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        F.col("l_suppkey").cast("string").alias("fundo"),
        F.col("l_returnflag").alias("formato"),
        F.to_date("l_shipdate").alias("fecha"),
        F.col("l_quantity").alias("kg_ha"),
        rate.alias("kg_jr_h"),
        F.when(F.col("l_discount") > 0, F.col("l_discount") * 100).alias("indus_pct"),
        F.when(F.col("l_linenumber") > 3, F.col("l_tax") + 0.01).alias("p_baya"),
        F.dayofyear("l_shipdate").alias("dia_cosecha"),
        hours.alias("h_ef"),
        (rate * hours).alias("kg_jr"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_linestatus").alias("estado"),
    )


H_COLS = """
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
         cast(l_suppkey AS varchar) AS fundo, l_returnflag AS formato,
         cast(l_shipdate AS date) AS fecha, l_quantity AS kg_ha,
         l_extendedprice / l_quantity AS kg_jr_h,
         CASE WHEN l_discount > 0 THEN l_discount * 100 END AS indus_pct,
         CASE WHEN l_linenumber > 3 THEN l_tax + 0.01 END AS p_baya,
         cast(dayofyear(l_shipdate) AS integer) AS dia_cosecha,
         cast(1 + l_linenumber AS double) AS h_ef,
         l_extendedprice / l_quantity * cast(1 + l_linenumber AS double) AS kg_jr,
         l_partkey AS partkey, l_linestatus AS estado
  FROM lineitem"""
H = f"WITH h AS ({H_COLS})"


def harvest_full(spark: SparkSession, sf: str) -> DataFrame:
    """Harvest records with variety, berry count and area of the part."""
    part = table(spark, sf, "part").select(
        F.col("p_partkey"),
        F.col("p_brand").alias("variedad"),
        F.col("p_size").cast("double").alias("dpc"),
        (F.col("p_retailprice") / 100).alias("ha"),
        F.col("p_type").alias("tipo"),
    )
    h = harvest(spark, sf)
    return h.join(part, h.partkey == part.p_partkey).drop("p_partkey")


HF = f"""WITH h0 AS ({H_COLS}),
h AS (SELECT h0.*, p_brand AS variedad, cast(p_size AS double) AS dpc,
             p_retailprice / 100 AS ha, p_type AS tipo
      FROM h0 JOIN part ON partkey = p_partkey)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Harvest with a stored prediction (the farm-format mean) and a fold number."""
    from furrow.functions.scalar import hash_bucket

    h = harvest(spark, sf)
    mean = h.groupBy("fundo", "formato").agg(F.round(F.avg("kg_jr_h"), 4).alias("y_pred"))
    fold = (hash_bucket(F.col("row_id"), 42) % 5).cast("int").alias("fold_id")
    return attach(h, mean, ["fundo", "formato"]).select("*", F.col("kg_jr_h").alias("y_true"), fold)


FOLD_SQL = "cast(('0x' || substr(md5('42|' || row_id), 1, 8))::bigint % 5 AS integer)"
S = f"""{H},
m AS (SELECT fundo, formato, round(avg(kg_jr_h), 4) AS y_pred FROM h GROUP BY ALL),
s AS (SELECT h.*, y_pred, kg_jr_h AS y_true, {FOLD_SQL} AS fold_id
      FROM h JOIN m USING (fundo, formato))"""
