"""Isolation forest per group: bounded trees from samples, scores on every row."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.columns import ROW_ID
from furrow.operators.groups import attach, quantiles

TREES, SAMPLE = 100, 256
# Nodes of trees that one scoring pass may carry to the tasks.
NODE_BUDGET = 4_000_000
# Rows that are scored at a time.
BATCH_ROWS = 200_000


def _depth_of(n):
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """Random splits down to single points or the depth limit, as flat arrays."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    feature, cut_at, left, right, value = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        me = len(feature)
        for arr, v in ((feature, -1), (cut_at, 0.0), (left, -1), (right, -1), (value, 0.0)):
            arr.append(v)
        spread = [j for j in range(x.shape[1]) if len(rows) and x[rows, j].min() < x[rows, j].max()]
        if depth >= limit or len(rows) <= 1 or not spread:
            value[me] = depth + float(_depth_of([len(rows)])[0])
            return me
        j = int(rng.choice(spread))
        low, high = x[rows, j].min(), x[rows, j].max()
        at = rng.uniform(low, high)
        mask = x[rows, j] <= at
        feature[me], cut_at[me] = j, float(at)
        left[me] = node(rows[mask], depth + 1)
        right[me] = node(rows[~mask], depth + 1)
        return me

    node(np.arange(len(x)), 0)
    return {"feature": feature, "cut_at": cut_at, "left": left, "right": right, "value": value}


def fit_trees(df: DataFrame, cols: Sequence[str], by: str, seed: int = 42, trees: int = TREES, row_id: str = ROW_ID) -> DataFrame:
    """One row per group and tree, each grown on about 256 hash-chosen rows."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    marked = attach(df.select(row_id, by, *cols), sizes, [by])
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("_n"))
    chosen = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.xxhash64(F.col(row_id), t, F.lit(seed)).cast("double") < (2 * share - 1) * float(2**63),
    )
    sample = marked.select(by, F.explode(chosen).alias("_tree"), *[F.col(c).cast("double") for c in cols], row_id)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row_id)
        tree = int(pdf["_tree"].iloc[0])
        grown = _grow(pdf[list(cols)].to_numpy(float), np.random.default_rng([seed, tree]))
        return pd.DataFrame([{by: pdf[by].iloc[0], "_tree": tree, "_size": len(pdf), **grown}])

    schema = (
        f"`{by}` {dict(df.dtypes)[by]}, _tree int, _size int, feature array<int>, cut_at array<double>, "
        "left array<int>, right array<int>, value array<double>"
    )
    return sample.groupBy(by, "_tree").applyInPandas(one, schema)


def _paths(x: np.ndarray, tree: dict) -> np.ndarray:
    at = np.zeros(len(x), dtype=int)
    while True:
        f = tree["feature"][at]
        inner = f >= 0
        if not inner.any():
            return tree["value"][at]
        rows = np.flatnonzero(inner)
        goes_left = x[rows, f[rows]] <= tree["cut_at"][at[rows]]
        at[rows] = np.where(goes_left, tree["left"][at[rows]], tree["right"][at[rows]])


def gathered(batches: Iterable[pd.DataFrame], least: int = BATCH_ROWS) -> Iterator[list[pd.DataFrame]]:
    """Batches in lists of about ``least`` rows, so that a tree meets many rows of its group at once."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= least:
            yield held
            held, n = [], 0
    if held:
        yield held


def isolation_scores(df: DataFrame, cols: Sequence[str], by: str, seed: int = 42, trees: int = TREES, row_id: str = ROW_ID) -> DataFrame:
    """Isolation score in (0, 1] of every row; higher is more isolated. Rows without a
    group form a group of their own.

    Forests travel to the tasks in passes of bounded size: groups beyond the node budget
    are scored in a further pass over their own rows.
    """
    from furrow.session import cut

    forest = cut(fit_trees(df, cols, by, seed, trees, row_id))
    nodes = forest.groupBy(by).agg(F.sum(F.size("feature")).alias("n")).orderBy(by)
    passes: list[list] = [[]]
    used = 0
    for row in nodes.toLocalIterator():
        if used + row["n"] > NODE_BUDGET and passes[-1]:
            passes.append([])
            used = 0
        passes[-1].append(row[by])
        used += row["n"]
    schema = df.select(*df.columns).schema.add("iso_score", "double")
    out = None
    for groups in passes:
        held: dict = {}
        mine = F.col(by).isin([g for g in groups if g is not None])
        mine = F.coalesce(mine, F.lit(False)) | F.col(by).isNull() if None in groups else mine
        for row in forest.where(mine).collect():
            held.setdefault(row[by], []).append(
                {k: np.asarray(row[k]) for k in ("feature", "cut_at", "left", "right", "value")} | {"size": row["_size"]}
            )

        def score(batches, held=held):
            for parts in gathered(batches):
                pdf = pd.concat([p[list(dict.fromkeys([by, *cols]))] for p in parts], ignore_index=True)
                result = np.full(len(pdf), np.nan)
                for name, idx in pdf.groupby(by, dropna=False).indices.items():
                    forest_of = held.get(None if pd.isna(name) else name)
                    if not forest_of:
                        continue
                    x = pdf.iloc[idx][list(cols)].to_numpy(float)
                    total = sum(_paths(x, t) for t in forest_of) / len(forest_of)
                    usual = float(_depth_of([np.mean([t["size"] for t in forest_of])])[0])
                    result[idx] = 2.0 ** (-total / usual) if usual > 0 else 1.0
                ends = np.cumsum([len(p) for p in parts])
                for p, end in zip(parts, ends, strict=True):
                    yield p.assign(iso_score=result[end - len(p) : end])

        part = df.where(mine).mapInPandas(score, schema)
        out = part if out is None else out.unionByName(part)
    return out


def isolation_filter(df: DataFrame, cols: Sequence[str], by: str, contamination: float = 0.05, least: int = 5, seed: int = 42, trees: int = TREES) -> DataFrame:
    """Drop the most isolated share of each group; groups under ``least`` rows stay whole.

    Complete cases only, as the model has it: a row with a null feature is dropped too. Use
    ``isolation_scores`` to keep such rows.
    """
    from furrow.session import cut

    complete = df.dropna(subset=list(cols))
    scores = cut(isolation_scores(complete, cols, by, seed, trees))
    limits = quantiles(scores, [by], {"_limit": ("iso_score", 1.0 - contamination)})
    sizes = scores.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    judged = attach(attach(scores, limits, [by]), sizes, [by])
    return judged.where((F.col("_n") < least) | (F.col("iso_score") <= F.col("_limit"))).drop("_limit", "_n")
