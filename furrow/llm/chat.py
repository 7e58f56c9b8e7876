"""Chat formatting: logged snapshots that later turns extend collapse into one conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.groups import attach, is_hot
from furrow.operators.ordered import position, sliced

# Fixed marks of the rendered form.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn_hashes(turns: DataFrame) -> tuple[bool, DataFrame]:
    """Whether some conversation is too big for a task; (_conv, _k, _a, _b): two hashes of
    each turn that depend on its place."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").alias("_conv"),
        "turn",
        F.xxhash64("role", "text", F.col("role").isNull(), F.col("text").isNull()).alias("_x"),
        F.xxhash64(F.lit(7), "text", "role", F.col("text").isNull()).alias("_y"),
    )
    order = ["turn", "_x", "_y"]
    hot = is_hot(rows, ["_conv"])
    if hot:
        # Slices need a unique order: each group of equal rows is numbered.
        groups = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
        rows = groups.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"))
        order.append("_i")
    placed = position(rows, ["_conv"], order, "_k", hot=hot)
    return hot, placed.select("_conv", "_k", F.xxhash64("_k", "_x", "_y").alias("_a"), F.xxhash64("_y", "_k", "_x").alias("_b"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(_conv, _k, _a, _b, _size) of each prefix: 128 bits that roll on from turn to turn.

    A prefix's hash is the exclusive or of place-dependent hashes of its turns, so it needs
    one running fold over narrow rows. A conversation with more rows than one task should
    hold is cut into slices whose folds are joined.
    """
    hot, rows = _turn_hashes(turns)
    fold = lambda w: (F.bit_xor("_a").over(w).alias("_a"), F.bit_xor("_b").over(w).alias("_b"))
    upto = (Window.unboundedPreceding, Window.currentRow)
    if not hot:
        w = Window.partitionBy("_conv").orderBy("_k")
        return rows.select("_conv", "_k", *fold(w.rowsBetween(*upto)), F.max("_k").over(Window.partitionBy("_conv")).alias("_size"))
    parts = sliced(rows, ["_conv"], ["_k"])
    sizes = parts.groupBy("_conv").agg(F.max("_k").alias("_size"))
    local = parts.select("_conv", "_k", "_slice", *fold(Window.partitionBy("_conv", "_slice").orderBy("_k").rowsBetween(*upto)))
    totals = parts.groupBy("_conv", "_slice").agg(F.bit_xor("_a").alias("_ta"), F.bit_xor("_b").alias("_tb"))
    before = Window.partitionBy("_conv").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_conv", "_slice", *[F.coalesce(F.bit_xor(f"_t{c}").over(before), F.lit(0)).alias(f"_o{c}") for c in "ab"])
    whole = attach(local, offsets, ["_conv", "_slice"])
    whole = whole.select("_conv", "_k", *[F.col(f"_{c}").bitwiseXOR(F.col(f"_o{c}")).alias(f"_{c}") for c in "ab"])
    return attach(whole, sizes, ["_conv"])


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_snapshots) of conversations that no longer one continues.

    Of equal conversations the smallest id stays; n_snapshots counts it and its equals. Rows
    are compared by order of (turn, role and text hashes), role and text; null roles and
    texts differ from empty ones. Rows without a conv_id belong to no conversation. Repeated
    rows are turns of their own. Equal endings and prefixes are combined before the
    anti-join, which therefore meets each hash once on either side.
    """
    steps = prefixes(turns)
    ends = steps.where("_k = _size").groupBy("_k", "_a", "_b").agg(F.min("_conv").alias("conv_id"), F.count("*").alias("n_snapshots"))
    inner = steps.where("_k < _size").select("_k", "_a", "_b").distinct()
    return ends.join(inner, ["_k", "_a", "_b"], "left_anti").select("conv_id", F.col("_k").alias("n_turns"), "n_snapshots")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE + "\n"))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_snapshots, rendered) of the maximal conversations.

    Snapshots are collapsed on hashes; texts of what remains are shuffled once, by
    conversation, and a conversation is rendered into one value. An empty table gives no row;
    columns other than conv_id, turn, role and text are not read.
    """
    kept = maximal(turns)
    rows = turns.select("conv_id", "turn", "role", "text")
    mine = rows.join(kept.select("conv_id"), "conv_id", "left_semi")
    turn = F.struct("turn", F.xxhash64("role", "text", F.col("role").isNull(), F.col("text").isNull()).alias("x"), render_turn(F.col("role"), F.col("text")).alias("r"))
    texts = mine.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(turn)), lambda t: t.r), "").alias("rendered"))
    return kept.join(texts, "conv_id")
