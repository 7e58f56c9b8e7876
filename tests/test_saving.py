"""Fitted chains written and read back, in this session and in a new one."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from furrow.operators.features import SkewTransformer
from furrow.operators.imputing import GroupMedianImputer, MedianImputer, OutlierCapper
from furrow.operators.lags import LagFlags
from furrow.operators.neighbors import KnnImputer, RobustScaler
from furrow.operators.saving import decode, encode, feature_names_out
from furrow.plans.chain import preprocessing_chain
from furrow.session import cut

COLUMNS = ["row_id", "fundo", "formato", "fecha", "kg_ha", "indus_pct", "dpc", "p_baya", "ha", "dia_cosecha", "kg_jr_h"]


@pytest.fixture(scope="module")
def harvest(spark):
    df = spark.range(200).select(
        F.format_string("%04d", "id").alias("row_id"), (F.col("id") % 3).cast("string").alias("fundo"), (F.col("id") % 2).cast("string").alias("formato"),
        F.expr("date_add(DATE'2020-01-01', cast(id % 300 AS int))").alias("fecha"), (F.col("id") * 7 % 50 + 1).cast("double").alias("kg_ha"),
        F.when(F.col("id") % 11 > 0, (F.col("id") * 3 % 17).cast("double")).alias("indus_pct"), (F.col("id") * 5 % 23).cast("double").alias("dpc"),
        F.when(F.col("id") % 2 > 0, (F.col("id") % 5).cast("double")).alias("p_baya"), (F.col("id") % 4 + 1).cast("double").alias("ha"), (F.col("id") % 300 + 1).cast("double").alias("dia_cosecha"),
    )
    return df.withColumn("kg_jr_h", F.col("kg_ha") * 2 + F.col("dpc")).cache()


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_a_chain_with_lags_neighbours_and_outliers_reads_back(spark, harvest, tmp_path):
    train, new = harvest.where("row_id < '0170'"), harvest.where("row_id >= '0160'")
    model = preprocessing_chain(LagFlags(), cascade=True).fit(train)
    want = cut(model.transform(new))
    path = str(tmp_path / "chain")
    model.write().save(path)
    again = PipelineModel.load(path)
    assert feature_names_out(again, new) == want.columns
    harvest.write.parquet(str(tmp_path / "rows"))
    want.write.parquet(str(tmp_path / "want"))
    code = textwrap.dedent(f"""
        from pyspark.ml import PipelineModel
        from furrow.session import local_session
        spark = local_session("2", "other")
        new = spark.read.parquet({str(tmp_path / "rows")!r}).where("row_id >= '0160'")
        got, want = PipelineModel.load({path!r}).transform(new), spark.read.parquet({str(tmp_path / "want")!r})
        same = [sorted(map(str, x.select(*sorted(want.columns)).collect())) for x in (got, want)]
        print("same" if same[0] == same[1] and len(same[0]) == 40 else "different")
    """)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=600)
    assert done.stdout.strip().endswith("same"), done.stderr[-2000:]


def test_unfitted_stages_and_overwriting(spark, harvest, tmp_path):
    path = str(tmp_path / "p")
    stages = [GroupMedianImputer(["dpc"], 0.1, least=5), OutlierCapper(["kg_ha"], "percentile", group=["fundo"]), SkewTransformer(["kg_ha"])]
    Pipeline(stages=stages).write().save(path)
    again = Pipeline.load(path).getStages()
    assert [type(s) for s in again] == [type(s) for s in stages] and again[0].levels == stages[0].levels and again[1].method == "percentile"
    model = RobustScaler(["kg_ha"]).fit(harvest)
    model.write().save(str(tmp_path / "m"))
    with pytest.raises(Exception):
        model.write().save(str(tmp_path / "m"))
    model.write().overwrite().save(str(tmp_path / "m"))
    assert rows_of(type(model).load(str(tmp_path / "m")).transform(harvest)) == rows_of(model.transform(harvest))
    with pytest.raises(ValueError):
        KnnImputer.load(str(tmp_path / "m"))


def test_arguments_are_params(spark, harvest):
    knn = KnnImputer(["indus_pct", "kg_ha"], k=3)
    assert knn.getOrDefault(knn.param_k) == 3 and "param_uniform" in knn.explainParams()
    other = knn.copy({knn.param_k: 7, knn.param_uniform: True})
    assert (other.k, other.uniform, other.uid, knn.k) == (7, True, knn.uid, 3)
    imputer = MedianImputer(["indus_pct"], 0.0)
    grid = ParamGridBuilder().addGrid(imputer.param_threshold, [0.0, 0.9]).build()
    low, high = (imputer.fit(harvest, g) for g in grid)
    assert low.transform(harvest).where("indus_pct IS NULL").isEmpty() and not high.transform(harvest).where("indus_pct IS NULL").isEmpty()


def test_values_of_every_kind_survive():
    import datetime as dt

    import numpy as np

    value = {"a": (1, 2.5, None, True), 3: [dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3)], "s": {1, 2}, "f": LagFlags(), "n": np.float64(1.5)}
    got = decode(encode(value, []), None)
    assert got == value and isinstance(got["a"], tuple)
    assert decode(encode(np.arange(3), []), None).tolist() == [0, 1, 2]
    with pytest.raises(TypeError):
        encode(object(), [])
    with pytest.raises(ValueError):
        decode({"$data": "os:stat_result", "state": {}}, None)


def test_deletes_touch_only_partitions_with_a_match(spark, tmp_path, monkeypatch):
    import glob

    from furrow.sources import store

    path = str(tmp_path / "table")
    rows = [(i, ["POP", "a b%c", None, "x=1"][i % 4], i % 5) for i in range(40)]
    spark.createDataFrame(rows, "id int, variety string, day int").write.partitionBy("variety").parquet(path)
    stamp = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}
    ids = lambda: sorted(r.id for r in spark.read.parquet(path).select("id").collect())
    before = stamp()
    assert store.delete_rows(spark, path, {"id": 5}) == 1 and ids() == [i for i in range(40) if i != 5]
    after = stamp()
    assert all(after.get(f) == t for f, t in before.items() if "a b" not in f) and any(f not in after for f in before)
    assert store.delete_rows(spark, path, {"id": 999}) == 0 and stamp() == after
    # A whole partition, by its own name.
    assert store.delete_history(spark, path, "x=1") == 10 and ids() == [i for i in range(40) if i % 4 != 3 and i != 5]

    # Interrupted after the decision: readable, and finished by the next call.
    whole = store.recover
    calls = []
    monkeypatch.setattr(store, "recover", lambda s, p: whole(s, p) if not calls and not calls.append(1) else 0)
    assert store.delete_rows(spark, path, {"day": 0}) > 0
    left = [i for i in range(40) if i % 4 != 3 and i != 5]
    assert ids() == left
    monkeypatch.undo()
    assert store.recover(spark, path) == 1 and ids() == [i for i in left if i % 5]
    # Interrupted before it: nothing happens.
    os.makedirs(f"{path}/{store.PENDING}x/rows/variety=POP")
    assert store.recover(spark, path) == 0 and ids() == [i for i in left if i % 5] and not glob.glob(f"{path}/{store.PENDING}*")


def test_thousands_of_levels_make_one_sparse_column(spark, tmp_path):
    from pyspark.ml.functions import vector_to_array

    from furrow.operators.features import SparseOneHot, SparseOneHotModel

    df = spark.range(9000).select(F.concat(F.lit("lv"), F.lpad((F.col("id") % 4000).cast("string"), 5, "0")).alias("k"), (F.col("id") % 2).cast("string").alias("s"))
    model = SparseOneHot("k").fit(df)
    model.write().save(str(tmp_path / "m"))
    again = SparseOneHotModel.load(str(tmp_path / "m"))
    assert model.size == 4000 and again.names().where("place = 17").first()["name"] == "k__lv00017"
    new = spark.createDataFrame([("lv00017",), ("never",), (None,)], "k string")
    got = [r.v for r in again.transform(new).select(vector_to_array("k__levels").alias("v")).collect()]
    assert [len(v) for v in got] == [4000] * 3 and got[0][17] == 1.0 and [sum(v) for v in got] == [1.0, 0.0, 0.0]
    both = SparseOneHot(["k", "s"], "pair", least=3).fit(df.where("k < 'lv00003'").unionByName(df.limit(0)))
    assert both.size == 3 and both.transform(df).columns == ["k", "s", "pair"]
