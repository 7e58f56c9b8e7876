"""Ordered operators (running sums, positions, row frames) without one-task groups.

A group that fits a task uses a plain window. A larger one is range-partitioned on
``(keys, order)`` into slices; the order must be unique inside a group, so the range
partitioner may cut anywhere. Slice totals, a table of at most slices x groups rows,
turn per-slice results into whole-group results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from furrow.operators.groups import attach, is_hot
from furrow.session import cut, hot_rows

FIRST, HERE = Window.unboundedPreceding, Window.currentRow


def _window(keys: Sequence[str], order: Sequence) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Rows with a fixed ``_slice``: consecutive slices hold consecutive ranges.

    There are enough slices for each to hold about the rows one task may hold.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-df.count() // hot_rows(df.sparkSession)), 2)
    by = [*[F.col(k) for k in keys], *order]
    return cut(df.repartitionByRange(n, *by).withColumn("_slice", F.spark_partition_id()))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    sums: dict[str, Column],
    hot: bool | None = None,
) -> DataFrame:
    """Inclusive running sums of each expression in group order."""
    keys = list(keys)
    if hot is None:
        hot = is_hot(df, keys)
    if not hot:
        w = _window(keys, order).rowsBetween(FIRST, HERE)
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])

    prepared = df.select("*", *[c.alias(f"_s_{n}") for n, c in sums.items()])
    parts = sliced(prepared, keys, order)
    local_w = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(FIRST, HERE)
    local = parts.select("*", *[F.sum(f"_s_{n}").over(local_w).alias(f"_l_{n}") for n in sums])
    # One row per slice and group, so this window is bounded by the number of slices.
    totals = parts.groupBy(*keys, "_slice").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    before = _window(keys, ["_slice"]).rowsBetween(FIRST, -1)
    offsets = totals.select(
        *keys, "_slice", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    joined = attach(local, offsets, [*keys, "_slice"])
    return joined.select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]
    )


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "pos", hot: bool | None = None
) -> DataFrame:
    """1-based index of each row in its ordered group."""
    keys = list(keys)
    if hot is None:
        hot = is_hot(df, keys)
    if not hot:
        return df.withColumn(name, F.row_number().over(_window(keys, order)).cast("bigint"))
    return running(df, keys, order, {name: F.lit(1)}, hot=True)


def value_chunks(counts: DataFrame, keys: Sequence[str], first: str, size: int, back: int, ahead: int) -> DataFrame:
    """(keys, first, _own, _copies): the chunk of each value of ``first`` and all that need its rows.

    ``counts`` has ``_n`` for each value. A value is in the chunk where its first row falls,
    so a chunk has at most ``size`` rows more than its last value. It is copied to every
    chunk that begins less than ``back`` rows after it or ends less than ``ahead`` before it.
    """
    keys = list(keys)
    days = counts.withColumn("_end", F.sum("_n").over(_window(keys, [F.col(first)]).rowsBetween(FIRST, HERE)))
    days = days.withColumn("_start", F.col("_end") - F.col("_n")).withColumn("_own", F.floor(F.col("_start") / size).cast("bigint"))
    edges = days.groupBy(*keys, "_own").agg(F.min("_start").alias("p"), F.max("_end").alias("e"))
    chunks = edges.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_own").alias("c"), "p", "e")).alias("_edges"))
    start, end = F.col("_start"), F.col("_end")
    needs = F.filter("_edges", lambda x: ((x["p"] >= end) & (x["p"] < end + back)) | ((x["e"] <= start) & (start < x["e"] + ahead)))
    copies = F.concat(F.array("_own"), F.transform(needs, lambda x: x["c"]))
    return attach(days, chunks, keys).select(*keys, first, "_own", copies.alias("_copies"))


def row_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    back: int,
    columns: dict[str, Callable[[WindowSpec], Column]],
    ahead: int = 0,
    hot: bool | None = None,
    first: str | None = None,
    base: DataFrame | None = None,
    number: str | None = None,
    finish: Callable[[DataFrame], DataFrame] | None = None,
    added: Sequence[str] = (),
) -> DataFrame:
    """Window columns that look at most ``back`` rows back and ``ahead`` rows forward.

    All columns share one partitioning and one sort. In a huge group rows are numbered,
    cut into chunks, and the edge rows of each chunk copied into its neighbours, which
    gives every row its whole frame inside a bounded chunk.

    ``first`` names the leading column of ``order``. Where none of its values has too many
    rows for a task, chunks are whole values of it, told from their counts: nothing is
    numbered or written. ``base`` holds the same rows without the columns added since, so
    that sizes are counted without computing these. ``number`` is the row's number in its
    group or chunk, for use in ``columns``. ``finish`` adds the columns ``added`` to rows that
    still hold all of a frame in window order, before the copied ones are dropped.
    """
    keys = list(keys)
    base = df if base is None else base

    def build_all(rows, w):
        if number is not None:
            rows = rows.withColumn(number, F.row_number().over(w))
        rows = rows.select("*", *[build(w).alias(n) for n, build in columns.items()])
        return finish(rows) if finish is not None else rows

    kept = [*df.columns, *columns, *added]
    if hot is None:
        hot = is_hot(base, keys)
    if not hot:
        return build_all(df, _window(keys, order)).select(*kept)

    size = max(hot_rows(df.sparkSession) // 4, back, ahead, 1)
    if first is not None:
        counts = cut(base.groupBy(*keys, first).agg(F.count(F.lit(1)).alias("_n")))
        if counts.agg(F.max("_n")).first()[0] <= hot_rows(df.sparkSession):
            placed = attach(df, cut(value_chunks(counts, keys, first, size, back, ahead)), [*keys, first])
            spread = placed.withColumn("_chunk", F.explode("_copies")).drop("_copies")
            framed = build_all(spread, Window.partitionBy(*keys, "_chunk").orderBy(*order))
            return framed.where(F.col("_own") == F.col("_chunk")).select(*kept)

    chunk = F.floor((F.col("_pos") - 1) / size).cast("bigint")
    inside = (F.col("_pos") - 1) % size
    numbered = position(df, keys, order, "_pos", hot=True).withColumn("_own", chunk)
    copies = F.array(F.col("_own"))
    if back:
        copies = F.concat(copies, F.when(inside >= size - back, F.array(F.col("_own") + 1)).otherwise(F.array().cast("array<bigint>")))
    if ahead:
        copies = F.concat(copies, F.when(inside < ahead, F.array(F.col("_own") - 1)).otherwise(F.array().cast("array<bigint>")))
    spread = numbered.withColumn("_chunk", F.explode(copies))
    framed = build_all(spread, Window.partitionBy(*keys, "_chunk").orderBy("_pos"))
    return framed.where(F.col("_own") == F.col("_chunk")).select(*kept)
