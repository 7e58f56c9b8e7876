"""Neighbour joins, outlier factor and imputation against brute force; isolation on a planted outlier."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow.operators.isolation import isolation_filter, isolation_scores
from furrow.operators.neighbors import KnnImputer, LofScorer

COLS = list("abc")
N = 250


def points():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(N, 3))
    x[::3] = x[0]  # a third of all rows are copies
    return rng, x


def order(d, z):
    return np.lexsort(tuple(z[:, j] for j in (2, 1, 0)) + (np.round(d, 12),))


def test_lof_equals_brute_force(spark):
    _, x = points()
    k = 5
    ids = [str(i) for i in range(N)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=COLS).assign(row_id=ids))
    got = LofScorer(COLS, k).fit(df).transform(df).toPandas().set_index("row_id").loc[ids].lof_score.to_numpy()
    iqr = np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0)
    iqr[iqr == 0] = 1
    z = (x - np.median(x, 0)) / iqr
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    other = d.copy()
    np.fill_diagonal(other, np.inf)
    near = [order(other[i], z)[:k] for i in range(N)]
    kd = np.array([other[i][near[i]].max() for i in range(N)])
    lrd = np.array([1 / (np.maximum(kd[near[i]], other[i][near[i]]).mean() + 1e-10) for i in range(N)])
    want = []
    for i in range(N):
        n = order(d[i], z)[:k]
        want.append((lrd[n] * (np.maximum(kd[n], d[i][n]).mean() + 1e-10)).mean())
    assert got == pytest.approx(np.array(want), rel=1e-5, abs=1e-5)


def test_knn_imputer_equals_brute_force(spark):
    rng, x = points()
    y = x.copy()
    y[rng.random(N) < 0.2, 1] = np.nan
    y[rng.random(N) < 0.1, 2] = np.nan
    ids = [str(i) for i in range(N)]
    raw = spark.createDataFrame(pd.DataFrame(y, columns=COLS).assign(row_id=ids))
    df = raw.select("row_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in COLS])
    got = KnnImputer(COLS, 4).fit(df).transform(df).toPandas().set_index("row_id").loc[ids][COLS].to_numpy(float)
    assert not np.isnan(got).any()
    iqr = np.nanquantile(y, 0.75, 0) - np.nanquantile(y, 0.25, 0)
    iqr[iqr == 0] = 1
    med = np.nanmedian(y, 0)
    z = (y - med) / iqr
    checked = 0
    for i, c in zip(*np.where(np.isnan(y))):
        donors = np.flatnonzero(~np.isnan(y[:, c]))
        both = ~np.isnan(z[i]) & ~np.isnan(z[donors])
        d = np.sqrt(3 / both.sum(1) * np.where(both, (z[i] - z[donors]) ** 2, 0).sum(1))
        rank = np.argsort(d, kind="stable")
        if (d < d[rank[3]] + 1e-9).sum() > 4:
            continue  # ties at the last place may go either way
        pick = rank[:4]
        w = (d[pick] == 0).astype(float) if (d[pick] == 0).any() else 1 / d[pick]
        value = (w * z[donors[pick], c]).sum() / w.sum() * iqr[c] + med[c]
        assert got[i, c] == pytest.approx(value)
        checked += 1
    assert checked > 10


def test_isolation_finds_the_planted_row_and_keeps_small_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(f"r{i}", "big", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    rows += [("odd", "big", 25.0, -25.0)] + [(f"s{i}", "small", float(i), 0.0) for i in range(4)]
    df = spark.createDataFrame(rows, "row_id string, variedad string, a double, b double")
    top = isolation_scores(df, ["a", "b"], "variedad", trees=40).orderBy(F.desc("iso_score")).where("variedad = 'big'").first()
    assert top["row_id"] == "odd"
    kept = isolation_filter(df, ["a", "b"], "variedad", 0.05, trees=40)
    ids = {r["row_id"] for r in kept.collect()}
    assert "odd" not in ids and {f"s{i}" for i in range(4)} <= ids and 370 < len(ids) < 400


def test_isolation_scores_gather_batches_and_keep_rows(spark, monkeypatch):
    from furrow.operators import isolation as ISO

    rng = np.random.default_rng(8)
    rows = [(f"r{i}", ["a", "b", None][i % 3], float(v), 2**60 + i if i % 5 else None) for i, v in enumerate(rng.normal(size=90))]
    df = spark.createDataFrame(rows, "row_id string, g string, x double, big bigint").coalesce(1)
    sizes = [sum(map(len, parts)) for parts in ISO.gathered(iter([pd.DataFrame({"x": range(7)})] * 5), 20)]
    assert sizes == [21, 14]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = {r["row_id"]: (r["iso_score"], r["x"]) for r in isolation_scores(df, ["x"], "g", trees=5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = {r["row_id"]: (r["iso_score"], r["x"]) for r in isolation_scores(df, ["x"], "g", trees=5).collect()}
    assert len(small) == 90 and small == whole
