"""Columns computed by Arrow batches beside the columns a table already has."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_arrays(
    df: DataFrame,
    keep: Sequence[str],
    inputs: Sequence[Column],
    added: Sequence[tuple[str, T.DataType]],
    make: Callable[[list[pa.Array]], list[pa.Array]],
) -> DataFrame:
    """``keep`` columns of every row and the ``added`` ones that ``make`` gives for ``inputs``.

    Rows stay in place. Columns travel under positions, so no name of the caller can clash;
    a kept column with an added name gives way to it.
    """
    names = {n for n, _ in added}
    keep = [c for c in keep if c not in names]
    k = len(keep)
    given = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], *[x.alias(f"i{i}") for i, x in enumerate(inputs)])
    fields = [T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType(fields + [T.StructField(f"a{i}", t) for i, (_, t) in enumerate(added)])
    labels = schema.names

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *make(list(b.columns[k:]))], names=labels)

    return given.mapInArrow(run, schema).toDF(*keep, *[n for n, _ in added])
