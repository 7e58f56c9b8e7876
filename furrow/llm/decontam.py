"""Benchmark decontamination: seeds find passages, local alignment scores them.

The benchmark is small beside the corpus; it is broadcast in blocks of bounded bytes, and
documents are read where they lie, so no text is shuffled and no document or item is hot.

What reaches the threshold is found whatever was edited. An alignment that shares a trigram
with its item is found by that trigram: all are seeds. One without has no run of more than
two equal words, and each further run costs a point, so it needs about two thirds of the
item's words; then it has one of the rarest third, and enough of the others around it.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
BLOCK_BYTES = 16 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates them."""
    if not text:
        return []
    return (text if text.isascii() else text.lower()).encode("utf-8", "replace").translate(_PLAIN).split()


def seed_keys(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, 64-bit keys) of the windows whose words all have an id above 0."""
    n = len(ids) - SEED_WORDS + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    known = ids > 0
    whole = known[:n].copy()
    for k in range(1, SEED_WORDS):
        whole &= known[k : k + n]
    at = np.flatnonzero(whole)
    keys = np.zeros(len(at), dtype=np.uint64)
    for k in range(SEED_WORDS):
        keys = (keys ^ ids[at + k].astype(np.uint64)) * _MULTIPLIER
        keys ^= keys >> np.uint64(29)
    return at, keys


class Items:
    """Benchmark items of one block, ready to be looked up by the words of a document."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.vocabulary: dict[bytes, int] = {}
        self.words = []
        for _, text in rows:
            known = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            self.words.append(np.array(known, dtype=np.int64))
        found = [seed_keys(w) for w in self.words]
        offsets, keys = (np.concatenate([np.empty(0, dtype=kind), *(f[k] for f in found)]) for k, kind in enumerate((np.int64, np.uint64)))
        owners = np.repeat(np.arange(len(found)), [len(k) for _, k in found])
        self.seeds, gram = np.unique(keys, return_inverse=True)
        by = np.argsort(gram, kind="stable")
        # Items and places of seed k: from starts[k] up to starts[k + 1].
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(gram, minlength=len(self.seeds)))])
        self.post_items, self.post_places = owners[by], offsets[by]
        # What documents are counted for: words (word w at w - 1), then trigrams.
        self.keys = np.concatenate([np.arange(1, len(self.vocabulary) + 1, dtype=np.uint64), self.seeds])

    def encode(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))

    def lookup(self, ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, indexes into ``keys``) of a text's windows that are among ``keys``."""
        at, found = seed_keys(ids)
        if not len(found) or not len(keys):
            return at[:0], at[:0]
        where = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        hit = keys[where] == found
        return at[hit], where[hit]

    def choose(self, counts: np.ndarray, threshold: float = THRESHOLD) -> None:
        """Set what a score of ``threshold`` takes: for each item the words and width of an
        alignment without a trigram, and of its words the rarest, one of which that must have.

        ``counts`` are the documents that hold each of ``keys``; those of words are used.
        """
        self.threshold = threshold
        self.half, self.least, self.slack, rare = [], [], [], []
        for words in self.words:
            n = len(words)
            points = 2 * n * threshold
            # Equal words that any alignment needs.
            self.half.append(max(int(np.ceil(points / MATCH - 1e-9)), 1))
            # r runs of at most SEED_WORDS - 1 equal words give 2 m - (r - 1) points at most.
            least = max(int(np.ceil((points - 1) / (MATCH - 1 / (SEED_WORDS - 1)) - 1e-9)), 1)
            self.least.append(least)
            # Points that can be lost to words put in.
            self.slack.append(max(int(MATCH * n - points + 1e-9), 0))
            by = np.argsort(counts[words - 1], kind="stable")
            rare.append(np.unique(words[by[: max(n - least + 1, 0)]]) if n >= SEED_WORDS else words[:0])
        word = np.concatenate([np.empty(0, dtype=np.int64), *rare])
        by = np.argsort(word, kind="stable")
        self.rare_starts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(self.vocabulary) + 1))])
        self.rare_items = np.repeat(np.arange(len(rare)), [len(r) for r in rare])[by]
        self.is_rare = np.diff(self.rare_starts) > 0
        self.sets = [np.unique(w) for w in self.words]
        self.present = np.zeros(len(self.vocabulary) + 1, dtype=bool)

    def holds(self, ids: np.ndarray, wanted: list[int], least: list[int]) -> list[bool]:
        """Whether ``least`` words of each item occur somewhere among ``ids``."""
        self.present[ids] = True
        out = [int(np.count_nonzero(self.present[self.words[i]])) >= least[i] for i in wanted]
        self.present[ids] = False
        return out


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """(score, end in the window) of the best local alignment of two word sequences."""
    width = len(window)
    slope = -GAP * np.arange(width + 1)
    above = np.zeros(width + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        step = np.maximum(0, above - -GAP)
        step[1:] = np.maximum(step[1:], above[:-1] + np.where(window == word, MATCH, MISMATCH))
        # Gaps along the row: a running maximum of what each place would still be worth.
        above = np.maximum.accumulate(step + slope) - slope
        at = int(above.argmax())
        if above[at] > best:
            best, end = int(above[at]), at
    return best, end


def near(items: Items, ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(item, begin, stop) of a text's parts that can hold an item without any of its trigrams."""
    at = np.flatnonzero(items.is_rare[ids])
    if not len(at):
        return []
    places: dict[int, list[int]] = {}
    for place, i, j in zip(at.tolist(), items.rare_starts[ids[at]].tolist(), items.rare_starts[ids[at] + 1].tolist(), strict=True):
        for item in items.rare_items[i:j].tolist():
            places.setdefault(item, []).append(place)
    out = []
    for (item, found), held in zip(places.items(), items.holds(ids, list(places), items.least), strict=True):
        if not held:
            continue
        own, least = items.sets[item], items.least[item]
        width = len(items.words[item]) + items.slack[item]
        first = 0
        for k in range(1, len(found) + 1):
            if k < len(found) and found[k] - found[k - 1] <= 2 * width:
                continue
            lo, hi = max(found[first] - width, 0), min(found[k - 1] + width + 1, len(ids))
            first = k
            part = ids[lo:hi]
            total = np.concatenate([[0], np.cumsum(own[np.minimum(np.searchsorted(own, part), len(own) - 1)] == part)])
            # Words of the item in each stretch of ``width`` words.
            enough = np.flatnonzero(total[min(width, len(part)) :] - total[: max(len(part) - width, 0) + 1] >= least)
            if len(enough):
                # Stretches that meet are aligned as one.
                for run in np.split(enough, np.flatnonzero(np.diff(enough) > width) + 1):
                    begin, stop = lo + int(run[0]), min(lo + int(run[-1]) + width, len(ids))
                    if items.holds(ids[begin:stop], [item], items.least)[0]:
                        out.append((item, begin, stop))
    return out


def search(items: Items, text: str | None) -> list[tuple]:
    """(item id, score, first word, end word) of each item that a text holds in part or edited.

    The score is the alignment's share of what the whole item would reach. Seed hits of an
    item whose diagonals lie within its length are one region; the best region counts.
    """
    ids = items.encode(text)
    places, keys = items.lookup(ids, items.seeds)
    diagonals: dict[int, list[int]] = {}
    for place, i, j in zip(places.tolist(), items.starts[keys].tolist(), items.starts[keys + 1].tolist(), strict=True):
        for item, offset in zip(items.post_items[i:j].tolist(), items.post_places[i:j].tolist(), strict=True):
            diagonals.setdefault(item, []).append(place - offset)
    regions: dict[int, list[tuple[int, int]]] = {}
    best: dict[int, tuple[int, int, int]] = {}
    for item, starts in diagonals.items():
        words, slack = items.words[item], items.slack[item]
        n = len(words)
        starts = sorted(set(starts))
        whole = next((s for s in starts if s >= 0 and np.array_equal(ids[s : s + n], words)), None)
        if whole is not None:
            best[item] = (MATCH * n, whole, whole + n)
            continue
        first = starts[0]
        for s, t in zip(starts, [*starts[1:], None], strict=True):
            if t is None or t - s > slack or t - first > n:
                begin, stop = max(first - slack, 0), min(s + n + slack, len(ids))
                if items.holds(ids[begin:stop], [item], items.half)[0]:
                    regions.setdefault(item, []).append((begin, stop))
                first = t
    for item, begin, stop in near(items, ids):
        if item not in best:
            regions.setdefault(item, []).append((begin, stop))
    for item, parts in regions.items():
        words = items.words[item]
        for begin, stop in parts:
            points, last = align(words, ids[begin:stop])
            if points > best.get(item, (0,))[0]:
                best[item] = (points, begin, begin + last)
        if item in best and best[item][0] / (MATCH * len(words)) >= items.threshold:
            # Backwards from its end, the alignment ends where it begins.
            points, begin, last = best[item]
            best[item] = (points, last - align(words[::-1], ids[begin:last][::-1])[1], last)
    scored = ((items.ids[i], points / (MATCH * len(items.words[i])), begin, last) for i, (points, begin, last) in best.items())
    return [x for x in scored if x[1] >= items.threshold]


def blocks_of(benchmark: DataFrame, id_col: str, text: str, block_bytes: int) -> list[list[tuple]]:
    """Items in blocks of bounded bytes, one read at a time for each."""
    rows = benchmark.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    for k in range(n):
        mine = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield [(r.id, r.text) for r in mine.distinct().orderBy("id", "text").collect()]


def prepared(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, threshold: float = THRESHOLD):
    """Broadcasts of the items of each block, with rare words chosen by their corpus counts."""
    context = docs.sparkSession.sparkContext
    for rows in blocks_of(benchmark, item_col, item_text, block_bytes):
        items = Items(rows)
        shared = context.broadcast(items)

        def count(batches, shared=shared):
            own = shared.value
            total = np.zeros(len(own.keys), dtype=np.int64)
            for b in batches:
                for t in b.column(0):
                    ids = np.unique(own.encode(t.as_py()))
                    total[ids[ids > 0] - 1] += 1
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["key", "n"])

        counted = docs.select(text).mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(len(items.keys), dtype=np.int64)
        for r in counted:
            counts[r.key] = r.n
        items.choose(counts, threshold)
        yield context.broadcast(items)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item, score, first_word, end_word) of every document that holds a benchmark item.

    Items of fewer than SEED_WORDS words, null and empty ones have no seeds and are not
    searched for; null and empty texts hold nothing. Repeated documents are each reported,
    repeated items once. Empty tables give no row; other columns are not read. A larger
    benchmark is searched for in more blocks, each a pass over the documents.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, score double, first_word bigint, end_word bigint"
    out = None
    for shared in prepared(docs, benchmark, text, item_col, item_text, block_bytes, threshold):

        def run(batches, shared=shared):
            for b in batches:
                rows, found = [], []
                for i, t in enumerate(b.column(1)):
                    for hit in search(shared.value, t.as_py()):
                        rows.append(i)
                        found.append(hit)
                columns = [[x[k] for x in found] for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], _arrow(item_kind)), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                    names=[id_col, item_col, "score", "first_word", "end_word"],
                )

        part = docs.select(id_col, text).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs``, with all their columns, that hold no item of the benchmark."""
    place = docs.columns.index(text)
    for shared in prepared(docs, benchmark, text, item_col, item_text, block_bytes, threshold):

        def run(batches, shared=shared):
            for b in batches:
                yield b.filter(pa.array([not search(shared.value, t.as_py()) for t in b.column(place)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
