"""Parameters, writing and reading of pipeline stages.

A stage written by ``write().save(path)`` (alone or inside a Spark ML pipeline) is a metadata
row, a manifest of its attributes in it, and one Parquet table for each fitted state; it reads
back in any session that reaches the folder. Constructor arguments of estimators and
transformers are ML params named ``param_<argument>``, so grids and ``fit(df, {param: value})``
work.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import functools
import importlib
import inspect

import numpy as np
from pyspark.ml import Model
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

PREFIX = "param_"
ROOT = __name__.split(".")[0]
OWN = ("uid", "_paramMap", "_defaultParamMap", "_params", "_given")
PLAIN = (type(None), bool, int, float, str)


class Saved(MLWritable, MLReadable):
    """Mixin of stages that can be written and read, with their arguments as params."""

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        if "__init__" not in cls.__dict__ or issubclass(cls, Model):
            return
        signature = inspect.signature(cls.__init__)
        for name in list(signature.parameters)[1:]:
            setattr(cls, PREFIX + name, Param(Params._dummy(), PREFIX + name, f"argument {name} of {cls.__name__}"))
        inner = cls.__init__

        @functools.wraps(inner)
        def init(self, *args, **named):
            inner(self, *args, **named)
            bound = signature.bind(self, *args, **named)
            bound.apply_defaults()
            self._given = {k: v for k, v in list(bound.arguments.items())[1:]}
            # What a table or model can't be written into the metadata as.
            self._setDefault(**{PREFIX + k: v for k, v in self._given.items() if _simple(v)})

        cls.__init__ = init

    def copy(self, extra=None):
        changed = {p.name[len(PREFIX) :]: v for p, v in {**self._paramMap, **(extra or {})}.items() if p.parent == self.uid and p.name.startswith(PREFIX)}
        if not changed:
            return super().copy(extra)
        new = type(self)(**{**self._given, **changed})
        new._resetUid(self.uid)
        return new

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def feature_names_out(self, df: DataFrame) -> list[str]:
        return feature_names_out(self, df)


def feature_names_out(model, df: DataFrame) -> list[str]:
    """Columns that a fitted stage or pipeline gives for a table with the columns of ``df``."""
    return model.transform(df.sparkSession.createDataFrame([], df.schema)).columns


def _simple(v) -> bool:
    if isinstance(v, dict):
        return all(isinstance(k, str) and _simple(x) for k, x in v.items())
    return isinstance(v, PLAIN) or (isinstance(v, (list, tuple)) and all(map(_simple, v)))


def _name(cls: type) -> str:
    return f"{cls.__module__}:{cls.__qualname__}"


def _find(name: str) -> type:
    module, _, qualified = name.partition(":")
    if module.split(".")[0] != ROOT:
        raise ValueError(f"{name} is not a class of this library")
    found = importlib.import_module(module)
    for part in qualified.split("."):
        found = getattr(found, part)
    return found


def encode(v, tables: list[DataFrame]):
    """JSON for a value; tables are appended to ``tables`` and stand as their number."""
    if isinstance(v, PLAIN):
        return v
    if isinstance(v, np.generic):
        return v.item()
    if isinstance(v, DataFrame):
        tables.append(v)
        return {"$table": len(tables) - 1}
    if isinstance(v, (dt.datetime, dt.date)):
        return {"$time" if isinstance(v, dt.datetime) else "$date": v.isoformat()}
    if isinstance(v, list):
        return [encode(x, tables) for x in v]
    if isinstance(v, (tuple, set, frozenset)):
        kind = "$tuple" if isinstance(v, tuple) else "$set"
        return {kind: [encode(x, tables) for x in (v if kind == "$tuple" else sorted(v, key=repr))]}
    if isinstance(v, dict):
        return {"$dict": [[encode(k, tables), encode(x, tables)] for k, x in v.items()]}
    if isinstance(v, np.ndarray):
        return {"$array": v.tolist(), "dtype": str(v.dtype)}
    if isinstance(v, Saved):
        return {"$stage": _name(type(v)), "uid": v.uid, "state": _state(v, tables)}
    if dataclasses.is_dataclass(v) and not isinstance(v, type):
        return {"$data": _name(type(v)), "state": {f.name: encode(getattr(v, f.name), tables) for f in dataclasses.fields(v)}}
    raise TypeError(f"a stage holding {type(v).__name__} can't be written")


def _state(stage: Saved, tables: list[DataFrame]) -> dict:
    return {k: encode(v, tables) for k, v in vars(stage).items() if k not in OWN and not isinstance(v, Param)}


def decode(v, table):
    """The value of JSON from ``encode``; ``table(i)`` gives its tables."""
    if isinstance(v, list):
        return [decode(x, table) for x in v]
    if not isinstance(v, dict):
        return v
    if "$table" in v:
        return table(v["$table"])
    if "$date" in v:
        return dt.date.fromisoformat(v["$date"])
    if "$time" in v:
        return dt.datetime.fromisoformat(v["$time"])
    if "$tuple" in v:
        return tuple(decode(x, table) for x in v["$tuple"])
    if "$set" in v:
        return {decode(x, table) for x in v["$set"]}
    if "$dict" in v:
        return {decode(k, table): decode(x, table) for k, x in v["$dict"]}
    if "$array" in v:
        return np.array(v["$array"], dtype=v["dtype"])
    if "$data" in v:
        return _find(v["$data"])(**{k: decode(x, table) for k, x in v["state"].items()})
    return _restore(_find(v["$stage"]), v["uid"], v["state"], table)


def _restore(cls: type, uid: str, state: dict, table, given: dict | None = None):
    stage = cls.__new__(cls)
    Params.__init__(stage)
    stage._resetUid(uid)
    for k, v in state.items():
        setattr(stage, k, decode(v, table))
    stage._given = given or {}
    return stage


class _Writer(MLWriter):
    def __init__(self, stage: Saved):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        tables: list[DataFrame] = []
        state = _state(self.stage, tables)
        given = {k: encode(v, []) for k, v in getattr(self.stage, "_given", {}).items() if _simple(v)}
        for i, t in enumerate(tables):
            t.write.parquet(f"{path}/tables/{i}")
        # The metadata come last: a folder without them is an interrupted write.
        DefaultParamsWriter.saveMetadata(self.stage, path, spark, extraMetadata={"state": state, "given": given})


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        found = _find(metadata["class"].rpartition(".")[0] + ":" + metadata["class"].rpartition(".")[2])
        if not issubclass(found, self.cls):
            raise ValueError(f"{path} holds a {found.__name__}, not a {self.cls.__name__}")
        table = lambda i: spark.read.parquet(f"{path}/tables/{i}")
        given = {k: decode(v, table) for k, v in metadata.get("given", {}).items()}
        return _restore(found, metadata["uid"], metadata["state"], table, given)
