"""Mixing sources to target weights: raking to marginals, then sampling by calibrated weights.

Only token sums of cells (source x language x topic) are grouped; texts stay where they lie.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.groups import attach
from furrow.session import cut

DIMENSIONS = ("source", "lang", "topic")
TOPICS = 16
TOPIC_LETTERS = 6
# What a sample should hold of all tokens.
FRACTION = 0.3
SWEEPS = 200
CLOSE = 1e-9
# Cells raked in the driver; more are raked by joins.
DRIVER_CELLS = 500_000


def topic_of(words: list[bytes], topics: int) -> int:
    """Bucket of a text's most frequent long word (of equals, the smallest); -1 if it has none."""
    long_words = Counter(w for w in words if len(w) >= TOPIC_LETTERS)
    if not long_words:
        return -1
    top = max(long_words.values())
    return xxhash.xxh64_intdigest(min(w for w, n in long_words.items() if n == top)) % topics


def with_topics(docs: DataFrame, text: str = "text", topics: int = TOPICS) -> DataFrame:
    """``docs`` with n_tokens (words) and topic; columns of these names are replaced."""
    columns = [c for c in docs.columns if c not in ("n_tokens", "topic")]
    df = docs.select(*[F.col(f"`{c}`") for c in columns])
    place = columns.index(text)

    def run(batches):
        for b in batches:
            sizes, found = [], []
            for t in b.column(place):
                words = (t.as_py() or "").encode("utf-8", "replace").lower().split()
                sizes.append(len(words))
                found.append(topic_of(words, topics))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64()), pa.array(found, pa.int32())], names=[*columns, "n_tokens", "topic"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, n_tokens bigint, topic int")


def cells_of(docs: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    """Tokens of each cell, combined before the shuffle."""
    return docs.groupBy(*dimensions).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, share): shares of a dimension's values by tokens, flattened by ``power``."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("n")).where("n > 0")
    whole = sums.agg(F.sum(F.pow("n", F.lit(power))).alias("all"))
    return attach(sums, whole).select("value", (F.pow("n", F.lit(power)) / F.col("all")).alias("share"))


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], sweeps: int = SWEEPS) -> np.ndarray:
    """Weights with 0 <= weight <= tokens whose sums over each dimension meet its targets.

    Iterative proportional fitting from weights in proportion to tokens; after each factor a
    cell gives all it has at most. Targets that can't be met with what the cells hold are met
    as far as the cells go.
    """
    weights = tokens * min(1.0, float(targets[0].sum() / tokens.sum())) if tokens.sum() > 0 else tokens * 0.0
    for _ in range(sweeps):
        before = weights
        for code, target in zip(codes, targets, strict=True):
            sums = np.bincount(code, weights, minlength=len(target))
            factor = np.divide(target, sums, out=np.zeros_like(target), where=sums > 0)
            weights = np.minimum(weights * factor[code], tokens)
        if np.abs(weights - before).sum() <= CLOSE * max(weights.sum(), 1.0):
            break
    return weights


def _rake_local(cells: DataFrame, targets: dict[str, DataFrame], total: float) -> DataFrame:
    table = cells.toArrow()
    codes, aims = [], []
    for name, target in targets.items():
        own = target.toArrow()
        place = {v: i for i, v in enumerate(own.column("value").to_pylist())}
        # Values without a target share a last place whose target is nothing.
        codes.append(np.array([place.get(v, own.num_rows) for v in table.column(name).to_pylist()], dtype=np.int64))
        aims.append(np.append(own.column("share").to_numpy() * total, 0.0))
    weights = rake(table.column("tokens").to_numpy(), codes, aims)
    return cells.sparkSession.createDataFrame(table.append_column("weight", pa.array(weights, pa.float64())))


def _rake_joined(cells: DataFrame, targets: dict[str, DataFrame], total: float, whole: float) -> DataFrame:
    state = cells.withColumn("weight", F.col("tokens") * F.lit(min(1.0, total / whole) if whole > 0 else 0.0))
    for _ in range(SWEEPS):
        before = cut(state)
        state = before.withColumn("_old", F.col("weight"))
        for name, target in targets.items():
            sums = state.groupBy(F.col(name).alias("value")).agg(F.sum("weight").alias("_sum"))
            factor = attach(sums, target, ["value"]).select(
                F.col("value").alias(name), F.when(F.col("_sum") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("_sum")).otherwise(0.0).alias("_f")
            )
            state = attach(state, factor, [name])
            state = state.withColumn("weight", F.least(F.col("weight") * F.col("_f"), F.col("tokens"))).drop("_f")
        state = cut(state)
        moved, held = state.agg(F.sum(F.abs(F.col("weight") - F.col("_old"))), F.sum("weight")).first()
        state = state.drop("_old")
        if (moved or 0) <= CLOSE * max(held or 0, 1.0):
            break
    return state


def raked_cells(cells: DataFrame, targets: dict[str, DataFrame], fraction: float = FRACTION, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """``cells`` with weight (expected tokens in the sample) and probability.

    The number of cells is counted: few are raked as arrays, more as tables, with the same
    steps. Shares that don't sum to 1 are scaled to it.
    """
    whole, n = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0.0)), F.count("*")).first()
    scaled = {}
    for name, target in targets.items():
        given = target.select("value", "share")
        scaled[name] = attach(given, given.agg(F.sum("share").alias("_all"))).select("value", (F.col("share") / F.col("_all")).alias("share"))
    total = whole * fraction
    out = _rake_local(cells, scaled, total) if n <= driver_cells else _rake_joined(cells, scaled, total, whole)
    return out.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.col("weight") / F.col("tokens"), F.lit(1.0))).otherwise(0.0))


def draw(id_col: str, text: str, seed: int):
    """A number in [0, 1) that depends on the id (on the text where it has none) and the seed."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.when(F.col(id_col).isNull(), F.col(text)), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION, id_col: str = "doc_id", text: str = "text", seed: int = 1, power: float = 0.5, topics: int = TOPICS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """``docs`` with n_tokens, topic, probability and sampled (columns of these names are replaced).

    ``targets`` has a table (value, share) for each of source, lang and topic; by default the
    shares of the data, flattened by ``power``. A value without a target gets nothing; a null
    is a value like others. A document is sampled when a hash of its id is below its
    probability, so the expected tokens of each value meet its target: repeated rows share
    their fate, documents without words are never sampled, an empty table stays empty.
    """
    featured = with_topics(docs, text, topics)
    cells = cut(cells_of(featured))
    targets = targets or {d: tempered(cells, d, power) for d in DIMENSIONS}
    raked = cut(raked_cells(cells, targets, fraction, driver_cells)).select(*DIMENSIONS, "probability")
    own = [c for c in featured.columns if c not in ("probability", "sampled")]
    joined = attach(featured.select(*own), raked, list(DIMENSIONS))
    return joined.withColumn("sampled", draw(id_col, text, seed) < F.col("probability"))
