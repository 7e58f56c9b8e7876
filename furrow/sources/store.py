"""Forecast and history tables on files: append, replace, page, delete, export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.scalar import daily_kilos
from furrow.session import cut


def valid_history(df: DataFrame) -> DataFrame:
    """Observation rows with finite, positive yield and rate."""
    kg, rate = F.expr("try_cast(kg_ha AS double)"), F.expr("try_cast(kg_jr_h AS double)")
    typed = df.withColumn("kg_ha", kg).withColumn("kg_jr_h", rate)
    good = F.col("fecha").isNotNull()
    for c in ("kg_ha", "kg_jr_h"):
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0)
    return typed.withColumn("_good", F.coalesce(good, F.lit(False)))


def import_history(df: DataFrame, path: str, variety: str, replace: bool = False) -> dict[str, int]:
    """Store the valid rows of one variety; returns inserted and skipped counts.

    A replace overwrites only that variety's partition, and is refused when nothing is
    valid, so that a bad upload cannot empty the table.
    """
    checked = cut(valid_history(df))
    counts = checked.agg(F.count_if("_good").alias("ok"), F.count_if(~F.col("_good")).alias("bad")).first()
    if replace and counts["ok"] == 0:
        raise ValueError("refusing to replace history with no valid rows")
    rows = checked.where("_good").drop("_good").withColumn("variety", F.lit(variety))
    rows = rows.withColumn("created_at", F.current_timestamp())
    writer = rows.write.partitionBy("variety")
    if replace:
        writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    else:
        writer.mode("append").parquet(path)
    return {"inserted": counts["ok"], "skipped": counts["bad"]}


def append_forecasts(df: DataFrame, path: str) -> None:
    """Append scored rows with daily kilos and timestamps."""
    now = F.current_timestamp()
    out = df.withColumn("kgjn_pred", daily_kilos(F.col("kghora_pred"), F.col("horas_efectivas")))
    out.withColumn("created_at", now).withColumn("updated_at", now).write.mode("append").partitionBy("variety").parquet(path)


def _filtered(df: DataFrame, filters: dict) -> DataFrame:
    """Pushed-down filters: equality, or (low, high) inclusive ranges."""
    for col, want in filters.items():
        if want is None:
            continue
        if isinstance(want, tuple):
            low, high = want
            if low is not None:
                df = df.where(F.col(col) >= F.lit(low))
            if high is not None:
                df = df.where(F.col(col) <= F.lit(high))
        else:
            df = df.where(F.col(col) == F.lit(want))
    return df


def list_page(df: DataFrame, filters: dict, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page in order with the total number of matches."""
    hits = _filtered(df, filters)
    total = hits.agg(F.count(F.lit(1)).alias("n")).scalar()
    return hits.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def list_forecasts(df, filters: dict, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first."""
    return list_page(df, filters, [F.desc("created_at"), F.desc("id")], limit, offset)


def list_history(df, variety: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Latest dates first."""
    return list_page(df, {"variety": variety}, [F.desc("fecha"), F.desc("id")], limit, offset)


PENDING = "_pending-"
COMMIT = "_COMMIT"


def _folders(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    child = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join([root.toString(), *parts]))
    names = lambda p: sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    return root, fs, child, names


def recover(spark: SparkSession, path: str) -> int:
    """Finish deletes that were interrupted after they were decided, and drop those that weren't.

    A decided delete lists the partitions it replaces; those whose new files still wait are
    put in place, those without any are removed. Returns how many deletes were finished.
    """
    root, fs, child, names = _folders(spark, path)
    done = 0
    for pending in [n for n in names(root) if n.startswith(PENDING)]:
        if fs.exists(child(pending, COMMIT)):
            staged = set(names(child(pending, "rows")))
            # One name a partition; a partition that has been put in place has no waiting files.
            for line in spark.read.text(child(pending, COMMIT).toString()).collect():
                kind, _, name = line[0].partition(" ")
                if kind == "empty":
                    fs.delete(child(name), True)
                elif name in staged:
                    fs.delete(child(name), True)
                    fs.rename(child(pending, "rows", name), child(name))
            done += 1
        fs.delete(child(pending), True)
    return done


def delete_rows(spark: SparkSession, path: str, filters: dict) -> int:
    """Delete the matching rows of a table in partitions by ``variety``; returns how many.

    Only partitions with a match are written anew, beside the table; a list of them is the
    decision, after which their folders are exchanged. Files of other partitions stay as they
    are. If the job dies before the decision nothing has changed, and after it the next
    delete, or ``recover``, finishes the exchange.
    """
    recover(spark, path)
    stored = spark.read.parquet(path)
    hit = F.lit(True)
    for col, want in filters.items():
        hit = hit & F.coalesce(F.col(col) == F.lit(want), F.lit(False))
    # One row a partition with a match.
    touched = stored.where(hit).groupBy("variety").agg(F.count(F.lit(1)).alias("n"), F.any_value("_metadata.file_path").alias("at")).collect()
    if not touched:
        return 0
    _, fs, child, names = _folders(spark, path)
    pending = f"{PENDING}{uuid.uuid4().hex}"
    mine = F.lit(False)
    for t in touched:
        mine = mine | F.col("variety").eqNullSafe(F.lit(t["variety"]))
    rows = child(pending, "rows").toString()
    stored.where(mine & ~hit).write.partitionBy("variety").parquet(rows)
    staged = [n for n in names(child(pending, "rows")) if n.startswith("variety=")]
    uri = spark._jvm.java.net.URI
    every = {spark._jvm.org.apache.hadoop.fs.Path(uri(t["at"])).getParent().getName() for t in touched}
    lines = [f"rows {n}" for n in staged] + [f"empty {n}" for n in sorted(every - set(staged))]
    decided = child(pending, COMMIT + "-draft")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(decided.toString())
    fs.rename(decided, child(pending, COMMIT))
    recover(spark, path)
    return sum(t["n"] for t in touched)


def delete_forecasts(spark, path, **filters) -> int:
    return delete_rows(spark, path, filters)


def delete_history(spark, path, variety: str) -> int:
    return delete_rows(spark, path, {"variety": variety})


def export_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Business export: one folder per table (predictions, groups, summary)."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(f"{path}/{name}")


def append_audit(df: DataFrame, path: str) -> None:
    """One JSON line per trained model."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)
