"""Collocations: phrases of two to four words by stripes of next-word counts.

A stripe is keyed by a prefix of words and counts the words that follow it; what follows and
can't belong to a frequent phrase, and the end of a piece, are counted under 0. Stripes of
blocks of text are merged element by element. One merged stripe so gives the extensions of
its prefix with their counts, the count of the prefix itself (the sum) and the largest
extension (the maximum), which decides subsumption.

Three passes read the texts: words, then pairs of words that pass a filter of frequent words,
then all longer phrases whose pairs pass a filter of frequent pairs. A filter is a bitmap of
hashes: it lets some infrequent ones through and never stops a frequent one; counts then
decide exactly.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import cut

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
SUBSUMED = 80  # per cent of the shorter phrase's count
# Bits of a filter: 16 MB broadcast whatever the corpus.
FILTER_BITS = 1 << 27
# A stripe is held in parts by its next words, so that no part of a frequent prefix is hot;
# parts travel in so many bundles at least.
PARTS = 16
BUNDLES = 4096
BLOCK = 1 << 22
HELD = 1 << 20

_SPLIT = np.zeros(256, bool)
_SPLIT[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t")] = True
_CUT = re.compile(rb"[.,;:!?\x0A-\x0D]")
_PER_BITMAP = 32768


def _odd(seed: int) -> int:
    return int(np.random.default_rng([13, seed]).integers(0, 1 << 63, dtype=np.int64)) * 2 + 1


class Hasher:
    """64-bit hashes of all words of a buffer at once: differences of a running sum of byte values times powers."""

    def __init__(self, seed: int):
        self.table = np.random.default_rng([31, seed]).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(_odd(seed) % (1 << 64))
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.powers) < n:
            self.powers, self.inverses = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x)])) for x in (self.base, self.inverse))
        sums = np.zeros(n, np.uint64)
        np.cumsum(self.table[data] * self.powers[: n - 1], out=sums[1:])
        return spread((sums[ends] - sums[starts]) * self.inverses[starts])


def spread(h: np.ndarray) -> np.ndarray:
    """Mixed bits of 64-bit hashes, never 0."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.where(h == 0, np.uint64(1), h)


def joined(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its first words and of its last one."""
    return spread(h * np.uint64(0xD6E8FEB86659FD93) + more)


def _blocks(batches):
    """(language, lower-case bytes of about a block) over a whole partition, cut at piece ends only."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for b in batches:
        for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            data = t.as_py().lower()  # of bytes: A to Z only
            at = 0
            while at < len(data):
                end = len(data)
                if end - at > BLOCK:
                    found = _CUT.search(data, at + BLOCK)
                    end = found.end() if found else end
                held.setdefault(lang, []).append(data[at:end])
                size[lang] = size.get(lang, 0) + end - at
                at = end
                if size[lang] >= BLOCK:
                    yield lang, b"\n".join(held.pop(lang))
                    size[lang] = 0
        if sum(size.values()) > 4 * BLOCK:
            for lang, parts in held.items():
                yield lang, b"\n".join(parts)
            held, size = {}, {}
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


def words_of(data: bytes, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, piece) of each word of a buffer."""
    a = np.frombuffer(data, dtype=np.uint8)
    cuts = _SPLIT[a]
    inside = np.concatenate([[False], ~(cuts | _BLANK[a]), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return hasher(a, starts, ends), starts, ends, np.cumsum(cuts)[starts] if len(starts) else starts


def _slices(data: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of the given ranges as strings, gathered in one step."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    gathered = np.frombuffer(data, dtype=np.uint8)[at]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(gathered))


def _source(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t"))


def count_words(docs: DataFrame, seed: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, h, word, n, clash) of every distinct word hash; ``clash`` tells that two words share it."""

    def run(batches):
        hasher = Hasher(seed)
        for name, data in _blocks(batches):
            h, starts, ends, _ = words_of(data, hasher)
            if len(h):
                own, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array(own.view(np.int64)), _slices(data, starts[first], ends[first]), pa.array(n)], names=["lang", "h", "word", "n"])

    found = _source(docs, lang, text).mapInArrow(run, "lang string, h bigint, word string, n bigint")
    merged = found.groupBy("lang", "h", "word").agg(F.sum("n").alias("n"))
    w = merged.groupBy("lang", "h").agg(F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("_last"))
    return w.select("lang", "h", "word", "n", (F.col("word") != F.col("_last")).alias("clash"))


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """The filter of the hashes in column ``key``: ``bits`` bits, or-ed together in Spark."""
    at = F.col("key").bitwiseAND(F.lit(bits - 1)) + 1
    rows = keys.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p"))
    found = rows.groupBy("b").agg(F.bitmap_construct_agg(F.col("p")).alias("m")).toArrow()
    out = np.zeros(max(bits // 8, _PER_BITMAP // 8), np.uint8)
    for b, m in zip(found["b"].to_pylist(), found["m"].to_pylist(), strict=True):
        out[(b - 1) * (_PER_BITMAP // 8) : b * (_PER_BITMAP // 8)] = np.frombuffer(m, dtype=np.uint8)
    return out


def passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def _lang_hash(name: str) -> np.uint64:
    return spread(np.array([int.from_bytes(name.encode()[:64], "little") % (1 << 64)], np.uint64))[0]


def _keys(h: np.ndarray, name: str, k: int) -> np.ndarray:
    """Hash of the language and the ``k`` words from each place on."""
    key = joined(np.full(len(h) - k + 1, _lang_hash(name)), h[: len(h) - k + 1])
    for i in range(1, k):
        key = joined(key, h[i : len(h) - k + 1 + i])
    return key


def _phrase_keys(phrases: DataFrame, k: int) -> DataFrame:
    """The same hash for a table of (lang, w1..wk), as ``key``."""

    def run(batches):
        for b in batches:
            langs = b.column(0).dictionary_encode()
            own = np.array([_lang_hash(x) for x in langs.dictionary.to_pylist()], np.uint64)
            key = own[langs.indices.to_numpy()] if len(own) else np.zeros(0, np.uint64)
            for i in range(k):
                key = joined(key, b.column(1 + i).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return phrases.select("lang", *_prefix(k)).mapInArrow(run, "key bigint")


def _prefix(k: int) -> list[str]:
    return [f"w{i}" for i in range(1, k + 1)]


def _merge(cols: list[np.ndarray], nxt: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Stripes of places, added up: (prefix columns, next words, counts), sorted by prefix and next word."""
    order = np.lexsort((nxt, *cols[::-1]))
    cols, nxt = [c[order] for c in cols], nxt[order]
    entry = np.ones(len(nxt), bool)
    entry[1:] = nxt[1:] != nxt[:-1]
    for c in cols:
        entry[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(entry)
    return [c[at] for c in cols], nxt[at], np.diff(np.append(at, len(nxt)))


def stripes(docs: DataFrame, lengths: Sequence[int], bits: np.ndarray, seed: int, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """Merged stripes of prefixes of the given lengths: (lang, bundle, w1..wk, total, most, next).

    Lengths follow each other; ``bits`` is the filter of frequent phrases of the first of
    them, and a place counts where all such phrases in it pass. Shorter prefixes have 0 in
    their last columns. A task merges the stripes of its own places, at most ``HELD`` at a
    time, and packs them into bundles: a row of arrays for all stripe parts of one hash
    bucket, which travel together. After one shuffle by bundle, entries are added up across
    tasks. ``next`` holds the entries of at least ``min_count``, ``most`` the largest of them.
    Where words are the prefixes, prefix 0 counts a language's words.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bits)
    bundles = max(BUNDLES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    k0, width = lengths[0], lengths[-1]
    names = _prefix(width)
    schema = "lang string, bundle bigint, " + ", ".join(f"{n} array<bigint>" for n in [*names, "next", "n"])

    def packed(name, cols, nxt, n):
        key = cols[0]
        for c in cols[1:]:
            key = joined(key, c)
        bundle = joined(key, _part(nxt)) % np.uint64(bundles)
        order = np.argsort(bundle, kind="stable")
        bundle = bundle[order]
        first = np.flatnonzero(np.append(True, bundle[1:] != bundle[:-1]))
        offsets = pa.array(np.append(first, len(bundle)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order].view(np.int64))) for x in (*cols, nxt, n)]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(first), pa.string()), pa.array(bundle[first].view(np.int64)), *lists], names=["lang", "bundle", *names, "next", "n"])

    def run(batches):
        filter_, hasher = shared.value, Hasher(seed)
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def flush(name):
            places = np.concatenate(held.pop(name), axis=1)
            sizes[name] = 0
            return packed(name, *_merge(list(places[:-1]), places[-1]))

        totals: dict[str, int] = {}
        for name, data in _blocks(batches):
            h, _, _, piece = words_of(data, hasher)
            totals[name] = totals.get(name, 0) + len(h)
            m = len(h) - k0 + 1
            if m < 1:
                continue
            good = passes(_keys(h, name, k0), filter_) & (piece[:m] == piece[k0 - 1 :])
            whole = good
            for k in lengths:
                if k > k0:
                    # The prefix that is a word longer, where the phrase that ends it passes.
                    whole = whole[:-1] & good[k - k0 :] & (piece[: len(h) - k + 1] == piece[k - 1 :])
                if not len(whole):
                    break
                # The next word counts by itself where the phrase that ends in it passes too.
                nxt = np.zeros(len(whole), np.uint64)
                nxt[:-1] = np.where(good[k - k0 + 1 :] & (piece[: len(whole) - 1] == piece[k:]), h[k:], np.uint64(0))
                at = np.flatnonzero(whole)
                if len(at):
                    blank = np.zeros(len(at), np.uint64)
                    held.setdefault(name, []).append(np.stack([*[h[at + i] if i < k else blank for i in range(width)], nxt[at]]))
                    sizes[name] = sizes.get(name, 0) + len(at)
            if sum(sizes.values()) > HELD:
                yield from [flush(x) for x in list(held)]
        yield from [flush(x) for x in list(held)]
        if k0 == 1:
            zero = np.zeros(1, np.uint64)
            yield from [packed(x, [zero] * width, zero, np.array([n])) for x, n in totals.items()]

    raw = _source(docs, lang, text).mapInArrow(run, schema).repartition("lang", "bundle")
    at = F.col("i")
    entries = raw.select("*", F.posexplode("next").alias("i", "following")).select(
        "lang", "bundle", *[F.get(c, at).alias(c) for c in names], F.col("following").alias("next"), F.get("n", at).alias("n")
    )
    merged = entries.groupBy("lang", "bundle", *names, "next").agg(F.sum("n").alias("n"))
    kept = (F.col("next") != 0) & (F.col("n") >= min_count)
    # A bundle holds whole parts of stripes, so this needs no further shuffle.
    return merged.groupBy("lang", "bundle", *names).agg(
        F.sum("n").alias("total"),
        F.max(F.when(kept, F.col("n"))).alias("most"),
        F.collect_list(F.when(kept, F.struct("next", "n"))).alias("next"),
    )


def _part(nxt: np.ndarray) -> np.ndarray:
    """Part of a stripe by its next word, so that a frequent prefix is spread over tasks."""
    return (nxt >> np.uint64(40)) % np.uint64(PARTS)


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    min_count: int = MIN_COUNT,
    top: int | None = TOP,
    max_words: int = MAX_WORDS,
    subsumed: int = SUBSUMED,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases.

    Texts are lower-cased in A to Z, split into pieces at ``.,;:!?`` and line ends and those
    into words at spaces and tabs; a null text has no words, a null language is ``und``. A
    phrase of two to ``max_words`` words that occurs ``min_count`` times is a candidate. Its
    score is the lowest of floor(2,000,000 a / (l + r)) over its cuts into two parts, with ties
    to the shortest first part. A candidate goes when a longer one that contains it has
    ``subsumed`` per cent of its count: as counts fall with length, one that is a word longer
    decides. Ranks break ties by count and then by the phrase's bytes; ``top`` None keeps all.
    Repeated rows count as often as they occur; an empty table gives no row. Long texts are
    read in blocks that end with a piece.
    """
    if max_words < 2 or filter_bits < _PER_BITMAP or filter_bits & (filter_bits - 1):
        raise ValueError("phrases have two words at least, and a filter a power of two of bits from 32,768 on")
    for seed in range(8):
        # Words that share a hash are found by comparing the words; then other hashes are taken.
        words = cut(count_words(docs, seed, lang, text).where(F.col("n") >= min_count))
        if words.where("clash").isEmpty():
            break
    else:
        raise RuntimeError("no hash sets the frequent words apart")

    c = F.col("c")
    frequent = words.select("lang", F.col("h").alias("w1"))
    counts, phrases, larger = [], [], []
    for lengths in ([1], list(range(2, max_words))):
        if not lengths:
            break
        merged = stripes(docs, lengths, bitmap(_phrase_keys(frequent, lengths[0]), filter_bits), seed, lang, text, min_count)
        p = F.array_remove(F.array(*_prefix(lengths[-1])), F.lit(0).cast("bigint"))
        # Longer prefixes are counted as what their own prefixes are followed by.
        held = cut(merged if lengths == [1] else merged.where("most IS NOT NULL"))
        grown = held.select(p.alias("p"), "lang", F.explode("next").alias("e")).select("lang", F.concat("p", F.array("e.next")).alias("c"), F.col("e.n").alias("a"))
        phrases.append(grown)
        if lengths == [1]:
            counts.append(held.groupBy("lang", p.alias("p")).agg(F.sum("total").alias("f")))
            frequent = grown.select("lang", F.get(c, F.lit(0)).alias("w1"), F.get(c, F.lit(1)).alias("w2"))
        else:
            larger.append(held.select("lang", p.alias("c"), F.col("most").alias("m")))
            larger.append(grown.select("lang", F.slice(c, F.lit(2), F.size(c) - 1).alias("c"), F.col("a").alias("m")))
    found = _union(phrases)
    count_of = _union([*counts, found.where(F.size(c) < max_words).select("lang", F.col("c").alias("p"), F.col("a").alias("f"))])
    if larger:
        most = _union(larger).groupBy("lang", "c").agg(F.max("m").alias("m"))
        found = found.join(most, ["lang", "c"], "left").where(F.col("m").isNull() | (100 * F.col("m") < subsumed * F.col("a"))).drop("m")
    cuts = found.select("lang", "c", "a", F.explode(F.sequence(F.lit(1), F.size("c") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice(c, F.lit(1), F.col("k")).alias("first"), F.slice(c, F.col("k") + 1, F.size("c") - F.col("k")).alias("rest"))
    for name, part in (("l", "first"), ("r", "rest")):
        cuts = cuts.join(count_of.withColumnsRenamed({"p": part, "f": name}), ["lang", part])
    score = F.expr("CAST((CAST(a AS decimal(20,0)) * 2000000) div (CAST(l AS decimal(20,0)) + r) AS bigint)")
    scored = cuts.groupBy("lang", "c", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s")).select("lang", "c", "a", "s.score", "s.l", "s.r")
    if top is not None:
        # With all ties of the last place, before the words are looked up.
        near = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        scored = scored.withColumn("_r", F.rank().over(near)).where(F.col("_r") <= top).drop("_r")
    spelled = scored.select("lang", "c", F.posexplode("c").alias("i", "h")).join(words.select("lang", "h", "word"), ["lang", "h"])
    spelled = spelled.groupBy("lang", "c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x.word), " ").alias("phrase"))
    sizes = counts[0].where(F.size("p") == 0).select("lang", F.col("f").alias("n"))
    named = scored.join(spelled, ["lang", "c"]).join(sizes, "lang")
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(last).cast("bigint"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
