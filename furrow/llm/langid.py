"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
SMOOTHING = 0.5
# Labelled rows used to fit, about; chosen by a hash of the text over all labelled rows.
FIT_ROWS = 20_000
CHUNK = 1 << 19
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
_MIX = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], dtype=np.uint32)


def buckets_of(data: bytes) -> np.ndarray:
    """Bucket of each n-gram of bytes, one row per order; row k has len(data) entries.

    N-grams are taken over UTF-8 bytes; those that would run past the end wrap onto the
    padding that callers put between texts.
    """
    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint32) + 1
    out = np.empty((len(ORDERS), len(a)), dtype=np.uint32)
    h = np.zeros(len(a), dtype=np.uint32)
    row = 0
    for k in range(max(ORDERS)):
        shifted = np.concatenate([a[k:], np.ones(min(k, len(a)), dtype=np.uint32)])[: len(a)]
        h = h * np.uint32(16777619) + shifted * _MIX[k]
        if k + 1 in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * _MIX[(k + 1) % 5]
            out[row] = (mixed >> np.uint32(16)) % np.uint32(BUCKETS)
            row += 1
    return out


def _plain(text: str) -> bytes:
    """Lower-case text with single spaces around words, as bytes."""
    return (" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace")


def _pieces(data: bytes):
    """A long text in pieces that overlap by the longest order less one."""
    for start in range(0, len(data), CHUNK):
        end = min(start + CHUNK, len(data))
        yield data[start : end + max(ORDERS) - 1], end - start


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability matrix of buckets x languages).

    Labelled rows are those with a text and a language; about ``fit_rows`` of them, chosen by
    a 64-bit hash of the text, are used (all, if there are fewer). Their n-gram counts are
    added up in Spark; the matrix has BUCKETS rows and one column per language whatever the
    size of the data. Without labelled rows the list is empty.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    n = rows.count()
    if n > fit_rows:
        rows = rows.where(F.xxhash64("text", F.lit("fit")) < F.lit(int((2 * fit_rows / n - 1) * (2**63 - 1))))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for name, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                mine = total.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
                for piece, size in _pieces(_plain(value.as_py())):
                    mine += np.bincount(buckets_of(piece)[:, :size].ravel(), minlength=BUCKETS)
        for name, mine in total.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(mine[at])], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    blocks = counts.groupBy("lang", F.expr("bucket div 4096").alias("block")).agg(F.collect_list(F.struct("bucket", "n")).alias("v")).toPandas()
    names = sorted(blocks["lang"].unique())
    total = np.full((BUCKETS, len(names)), SMOOTHING)
    for name, v in zip(blocks["lang"], blocks["v"], strict=True):
        pairs = np.array([(x[0], x[1]) for x in v], dtype=np.int64)
        total[pairs[:, 0], names.index(name)] += pairs[:, 1]
    return names, np.log(total / total.sum(axis=0)).astype(np.float32)


def score_texts(texts: list[str | None], names: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """Best language and its posterior probability for each text, with equal priors.

    The bags of a batch are rows of a sparse matrix given by places and row starts; their
    product with the matrix is a gather and a sum per row.
    """
    predicted, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not names:
        return predicted, scores
    sums = np.zeros((len(texts), len(names)))
    held, rows, size = [], [], 0

    def flush():
        nonlocal held, rows, size
        if held:
            joined = b"".join(x for x, _ in held)
            at = buckets_of(joined)
            values = matrix[at[0]]
            for k in range(1, len(ORDERS)):
                values += matrix[at[k]]
            starts = np.cumsum([0] + [len(x) for x, _ in held])[:-1]
            ends = starts + np.array([n for _, n in held])
            cuts = np.column_stack([starts, ends]).ravel()
            # Between an end and the next start lies the overlap of a long text: left out.
            padded = np.vstack([values, np.zeros((1, len(names)), dtype=values.dtype)])
            per = np.add.reduceat(padded, cuts, axis=0, dtype=np.float64)[::2]
            np.add.at(sums, rows, per)
        held, rows, size = [], [], 0

    for i, t in enumerate(texts):
        if t is None or not LETTER.search(t):
            continue
        for piece, n in _pieces(_plain(t)):
            held.append((piece, n))
            rows.append(i)
            size += len(piece)
            if size >= CHUNK:
                flush()
    flush()
    best = sums.argmax(axis=1)
    top = sums.max(axis=1)
    chance = 1.0 / np.exp(np.clip(sums - top[:, None], -700, 0)).sum(axis=1)
    for i, t in enumerate(texts):
        if t is not None and LETTER.search(t):
            predicted[i], scores[i] = names[best[i]], float(chance[i])
    return predicted, scores


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``keep`` columns of every row with lang_pred and score.

    The matrix is broadcast: its size is buckets x languages. A text that is null or has no
    letter is ``und`` with score 0, as is every text when nothing was learned. A tie goes to
    the first language in order. Rows stay in place: nothing is shuffled.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text"))
    fields = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        names, matrix = shared.value
        for b in batches:
            predicted, scores = score_texts(b.column(len(keep)).to_pylist(), names, matrix)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(predicted, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return given.mapInArrow(run, ", ".join(x for x in (fields, "lang_pred string, score double") if x))


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus
