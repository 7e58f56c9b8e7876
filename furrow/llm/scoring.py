"""Language-model scores from a weighted backoff automaton trained on the corpus.

States are the contexts of n-grams, arcs carry smoothed log-probabilities, failure arcs the
backoff weights; a document is read once, left to right. Every n-gram that occurs LEAST times
is learned whatever the size of the corpus, so the model grows with it and is never held
whole: its states are tables. Texts become chunks of word hashes once. A chunk asks the
tables for the n-grams it contains, compiles the part of the automaton that its own texts can
reach, and traverses them with it.

Words and n-grams go by 64-bit hashes. N-grams are counted length by length, and one counts
only where its two parts, shorter by a word, pass a filter of frequent ones: a bitmap that
lets some others through and never stops a frequent one, so counts stay exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.collocations import FILTER_BITS, Hasher, bitmap, joined, passes
from furrow.session import cut

ORDER = 3
LEAST = 10
DISCOUNT = 0.5
SMOOTHING = 0.5
END = np.uint64(1)
SEED = 5
# Bytes hashed at once, tokens of a chunk (whole texts), entries a task merges or answers.
BLOCK_BYTES = 1 << 21
CHUNK_TOKENS = 1 << 21
# Tokens whose automaton is compiled at once.
MACHINE_TOKENS = 1 << 18
BUCKET_TOKENS = 1 << 21
# Last bits of a key that the search for candidates leaves out.
SHORT = 24

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def hashed(texts: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, each text closed by END; tokens of each text)."""
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), dtype=np.uint8)
    inside = np.concatenate([[False], ~_BLANK[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    limits = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(limits, starts, side="right")
    out = np.full(len(starts) + len(texts), END)
    out[np.arange(len(starts)) + text] = hasher(data, starts, ends)
    return out, np.bincount(text, minlength=len(texts)) + 1


def sequences(rows: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks of whole texts of a table (_id, _train, _text): ids, flags and sizes of the texts,
    the distinct word hashes and, compressed, the place of each token's word among them."""
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        hasher = Hasher(SEED)
        task, number = TaskContext.get().partitionId(), 0
        tokens: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ids: list[pa.Array] = []
        flags: list[pa.Array] = []

        def chunk():
            nonlocal number
            number += 1
            words, at = np.unique(np.concatenate(tokens), return_inverse=True)
            own, flag = pa.concat_arrays(ids), pa.concat_arrays(flags)
            size = np.concatenate(sizes)
            learned = int(size[flag.to_numpy(zero_copy_only=False)].sum())
            at = at.astype(np.uint32)
            seq = pack(at)
            ends = lambda n: pa.array(np.array([0, n], np.int32))
            columns = [pa.array([task << 32 | number]), pa.array([len(at)]), pa.array([learned]), pa.ListArray.from_arrays(ends(len(own)), own), pa.ListArray.from_arrays(ends(len(flag)), flag)]
            columns += [pa.ListArray.from_arrays(ends(len(size)), pa.array(size.astype(np.int64))), pa.array([pack(words, True)], pa.binary())]
            for x in (tokens, sizes, ids, flags):
                x.clear()
            return pa.RecordBatch.from_arrays([*columns, pa.array([seq], pa.binary())], names=["chunk", "tokens", "learned", "ids", "train", "sizes", "words", "seq"])

        held = 0
        for b in batches:
            at = 0
            while at < len(b):
                texts, size, first = [], 0, at
                while at < len(b) and size < min(BLOCK_BYTES, 8 * chunk_tokens):
                    texts.append(b.column(2)[at].as_py())
                    size += len(texts[-1])
                    at += 1
                t, n = hashed(texts, hasher)
                tokens.append(t)
                sizes.append(n)
                ids.append(b.column(0).slice(first, len(texts)))
                flags.append(b.column(1).slice(first, len(texts)))
                held += len(t)
                if held >= chunk_tokens:
                    yield chunk()
                    held = 0
        if tokens:
            yield chunk()

    schema = f"chunk bigint, tokens bigint, learned bigint, ids array<{kind}>, train array<boolean>, sizes array<bigint>, words binary, seq binary"
    return rows.select("_id", "_train", "_text").mapInArrow(run, schema)


def gram_keys(tokens: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams from each place on, of lengths 1 to ``order``: a key joins those of
    the two parts that are shorter by a word. What runs over the end of a text is included."""
    keys = [tokens]
    for _ in range(order - 1):
        keys.append(joined(keys[-1][:-1], keys[-1][1:]) if len(keys[-1]) else keys[-1])
    return keys


def inner(tokens: np.ndarray, k: int) -> np.ndarray:
    """Whether the n-gram of length ``k`` from each place on stays within a text."""
    n = max(len(tokens) - k + 1, 0)
    out = np.ones(n, bool)
    for i in range(k - 1):
        out &= tokens[i : i + n] != END
    return out


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of keys, which are hashes: sorted keys are in the order of their buckets."""
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Numbers of 8 or 4 bytes, byte planes apart, compressed; of ``rising`` ones the steps."""
    x = np.diff(x, prepend=x.dtype.type(0)) if rising else np.ascontiguousarray(x)
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes(), 1)


def unpack(data: bytes, kind=np.uint64, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    x = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if rising else x


def _dealt(bucket: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """Entries as one row of packed columns for each bucket, the first column rising in each;
    ``bucket`` is in order."""
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True)) if len(first) else []
    return bucket[first], [pa.array([pack(c[s:e], i == 0) for s, e in cuts], pa.binary()) for i, c in enumerate(columns)]


def _all(column: pa.ChunkedArray, kind=np.uint64, rising: bool = False) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *[unpack(x, kind, rising) for x in column.to_pylist()]])


def _tokens(batches):
    """(tokens of a chunk, whether each is of a training text)."""
    for b in batches:
        for train, sizes, words, seq in zip(*b.columns, strict=True):
            tokens = unpack(words.as_py(), rising=True)[unpack(seq.as_py(), np.uint32)]
            yield tokens, np.repeat(train.values.to_numpy(zero_copy_only=False), sizes.values.to_numpy())


def _learned(batches, k: int, parts, wanted):
    """(key, head, tail, n) of the n-grams in each chunk's training texts that can be frequent."""
    for tokens, train in _tokens(batches):
        keep = train[: max(len(tokens) - k + 1, 0)] & inner(tokens, k)
        keys = gram_keys(tokens, k)
        if parts is not None:
            good = passes(keys[k - 2], parts.value)
            keep &= good[:-1] & good[1:]
        if wanted is not None:
            keep &= passes(keys[k - 1] >> np.uint64(SHORT), wanted.value)
        at = np.flatnonzero(keep)
        key, first, count = np.unique(keys[k - 1][at], return_index=True, return_counts=True)
        first = at[first]
        yield key, keys[k - 2][first] if k > 1 else key, keys[k - 2][first + 1] if k > 1 else key, count.astype(np.uint64)


def candidates(chunks: DataFrame, k: int, parts, buckets: int, least: int) -> DataFrame:
    """Column ``key``: the first 40 bits of keys of n-grams, of those that occur ``least`` times.

    They travel as steps between sorted numbers, in about three bytes; n-grams that share them
    count as one here, which lets a few more through.
    """

    def run(batches):
        for key, _, _, n in _learned(batches, k, parts, None):
            mine, columns = _dealt(_bucket(key, buckets), [key >> np.uint64(SHORT), n])
            yield pa.RecordBatch.from_arrays([pa.array(mine), *columns], names=["bucket", "key", "n"])

    def merge(table: pa.Table) -> pa.Table:
        key, at = np.unique(_all(table["key"], rising=True), return_inverse=True)
        return pa.table({"key": key[np.bincount(at, _all(table["n"]), minlength=len(key)) >= least].view(np.int64)})

    sent = chunks.select("train", "sizes", "words", "seq").mapInArrow(run, "bucket bigint, key binary, n binary")
    return sent.groupBy("bucket").applyInArrow(merge, "key bigint")


def count_grams(chunks: DataFrame, k: int, parts, buckets: int, least: int) -> DataFrame:
    """(key, head, tail, n) of the n-grams of length ``k`` that occur ``least`` times in training
    texts. ``head`` and ``tail`` are the keys of its parts, which must pass the filter ``parts``.

    A chunk sends each of its n-grams once, with its count, so a frequent one is no hot key.
    """
    wanted = chunks.sparkSession.sparkContext.broadcast(bitmap(candidates(chunks, k, parts, buckets, least), FILTER_BITS)) if k > 1 else None
    names = ["head", "tail", "n"] if k > 1 else ["head", "n"]

    def run(batches):
        for key, head, tail, n in _learned(batches, k, parts, wanted):
            bucket = _bucket(key, buckets)
            order = np.lexsort((tail, head, bucket)) if k > 1 else slice(None)
            mine, columns = _dealt(bucket[order], [c[order] for c in ([head, tail, n] if k > 1 else [key, n])])
            yield pa.RecordBatch.from_arrays([pa.array(mine), *columns], names=["bucket", *names])

    def merge(table: pa.Table) -> pa.Table:
        head, n = _all(table["head"], rising=True), _all(table["n"])
        tail = _all(table["tail"]) if k > 1 else head
        key, first, at = np.unique(joined(head, tail) if k > 1 else head, return_index=True, return_inverse=True)
        sums = np.bincount(at, n, minlength=len(key)).astype(np.int64)
        keep = sums >= least
        first = first[keep]
        return pa.table({"key": key[keep].view(np.int64), "head": head[first].view(np.int64), "tail": tail[first].view(np.int64), "n": sums[keep]})

    sent = chunks.select("train", "sizes", "words", "seq").mapInArrow(run, "bucket bigint, " + ", ".join(f"{c} binary" for c in names))
    return sent.groupBy("bucket").applyInArrow(merge, "key bigint, head bigint, tail bigint, n bigint")


def train(chunks: DataFrame, buckets: int, order: int = ORDER, least: int = LEAST) -> tuple[DataFrame, list, int, int]:
    """(states, filters, N, V) of the training texts of ``chunks``.

    A state or arc is a row (level, key, value, backoff): the count of a word at level 1, the
    log10 probability of the last word of an n-gram above; ``backoff`` is the weight (log10) of
    its failure arc where the n-gram is the context of another one, else null. ``filters`` are
    broadcast bitmaps of the keys of levels 2 to ``order``.
    """
    context = chunks.sparkSession.sparkContext
    level = cut(count_grams(chunks, 1, None, buckets, 1).select("key", "n"))
    total, distinct = level.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    denominator = total + SMOOTHING * (distinct + 1)
    # What is known of the n-grams that are one word shorter.
    shorter = level.where(F.col("n") >= least).select("key", "n", ((F.col("n") + SMOOTHING) / denominator).alias("p"))
    values = [level.select("key", F.col("n").cast("double").alias("value"))]
    backoffs, filters = [], []
    filter_ = context.broadcast(bitmap(shorter.select("key"), FILTER_BITS))
    for k in range(2, order + 1):
        grams = count_grams(chunks, k, filter_, buckets, least)
        heads = shorter.select(F.col("key").alias("head"), F.col("n").alias("seen"))
        tails = shorter.select(F.col("key").alias("tail"), F.col("p").alias("less"))
        joint = cut(grams.join(heads, "head").join(tails, "tail").select("key", "head", "n", ((F.col("n") - DISCOUNT) / F.col("seen")).alias("p"), "less"))
        left, room = (F.greatest(1 - F.sum(c), F.lit(1e-12)) for c in ("p", "less"))
        backoffs.append(joint.groupBy(F.col("head").alias("key")).agg(F.log10(left / room).alias("backoff")))
        values.append(joint.select("key", F.log10("p").alias("value")))
        shorter = joint.select("key", "n", "p")
        filter_ = context.broadcast(bitmap(shorter.select("key"), FILTER_BITS))
        filters.append(filter_)
    states = None
    for k, v in enumerate(values, 1):
        whole = v.join(backoffs[k - 1], "key", "left") if k < order else v.withColumn("backoff", F.lit(None).cast("double"))
        one = whole.select(F.lit(k).alias("level"), "key", "value", "backoff")
        states = one if states is None else states.unionAll(one)
    return states, filters, total, distinct


def find(own: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted array ``own``, whether it is there) of each key."""
    if not len(own):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    return at, own[at] == keys


def answers(chunks: DataFrame, states: DataFrame, filters: list, buckets: int) -> DataFrame:
    """(chunk, level, bucket, hit, value, backoff): what the states say of the n-grams of each chunk.

    A chunk asks once for each distinct n-gram, in order of keys; a packed answer tells for
    each whether it is known and, of those that are, the numbers. Requests and states meet by
    ranges of keys. Numbers of n-grams travel in 4 bytes; counts of words are exact.
    """

    def ask(batches):
        for b in batches:
            for chunk, words, seq in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                tokens = unpack(words.as_py(), rising=True)[unpack(seq.as_py(), np.uint32)]
                for k, own in enumerate(asked_keys(tokens, [f.value for f in filters]), 1):
                    mine, (lists,) = _dealt(_bucket(own, buckets), [own])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), chunk)), pa.array(np.full(len(mine), k, np.int32)), pa.array(mine), lists], names=["chunk", "level", "bucket", "keys"])

    def tell(asked: pa.Table, known: pa.Table) -> pa.Table:
        own = known["key"].to_numpy().view(np.uint64)
        order = np.argsort(own)
        own, value, backoff = own[order], known["value"].to_numpy()[order], known["backoff"].to_numpy()[order].astype(np.float32)
        hits, values, backoffs = [], [], []
        for level, data in zip(asked["level"].to_pylist(), asked["keys"].to_pylist(), strict=True):
            at, hit = find(own, unpack(data, rising=True))
            hits.append(zstandard.compress(np.packbits(hit).tobytes(), 1))
            values.append(pack(value[at[hit]].astype(np.float32 if level > 1 else np.float64)))
            backoffs.append(pack(backoff[at[hit]]))
        return pa.table({"chunk": asked["chunk"], "level": asked["level"], "bucket": asked["bucket"], "hit": hits, "value": values, "backoff": backoffs}, schema=told)

    told = pa.schema([("chunk", pa.int64()), ("level", pa.int32()), ("bucket", pa.int64()), ("hit", pa.binary()), ("value", pa.binary()), ("backoff", pa.binary())])
    requests = chunks.select("chunk", "words", "seq").mapInArrow(ask, "chunk bigint, level int, bucket bigint, keys binary")
    dealt = states.withColumn("bucket", F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(buckets).cast("bigint"), 32))
    schema = "chunk bigint, level int, bucket bigint, hit binary, value binary, backoff binary"
    return requests.groupBy("level", "bucket").cogroup(dealt.groupBy("level", "bucket")).applyInArrow(tell, schema)


def asked_keys(tokens: np.ndarray, filters: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct n-grams of a chunk that can be known, by length."""
    out = []
    for k, keys in enumerate(gram_keys(tokens, len(filters) + 1), 1):
        if k > 1:
            keys = keys[inner(tokens, k)]
            keys = keys[passes(keys, filters[k - 2])]
        out.append(np.unique(keys))
    return out


def known_of(asked: list[np.ndarray], said: pa.Table, buckets: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """{length: (keys, values, backoffs)} from a chunk's requests and the answers to them."""
    levels, numbers = said["level"].to_numpy(), said["bucket"].to_numpy()
    out = {}
    for k, keys in enumerate(asked, 1):
        bucket = _bucket(keys, buckets)
        mine = np.flatnonzero(levels == k)
        mine = mine[np.argsort(numbers[mine])]
        parts: list[list[np.ndarray]] = [[keys[:0]], [np.empty(0)], [np.empty(0)]]
        for i in mine.tolist():
            start, end = np.searchsorted(bucket, [numbers[i], numbers[i] + 1])
            hit = np.unpackbits(np.frombuffer(zstandard.decompress(said["hit"][i].as_py()), np.uint8), count=end - start).astype(bool)
            parts[0].append(keys[start:end][hit])
            parts[1].append(unpack(said["value"][i].as_py(), np.float32 if k > 1 else np.float64))
            parts[2].append(unpack(said["backoff"][i].as_py(), np.float32))
        out[k] = tuple(np.concatenate(p) for p in parts)
    return out


class Automaton:
    """The part of the machine that texts over some words can reach.

    Words are places in the sorted array ``words`` of hashes; ``known[k]`` holds the sorted keys,
    values and backoffs (NaN where no context) of the n-grams of length k that the model has.
    State 0 is the empty context, which has an arc for each word. ``arcs`` maps state *
    len(words) + word to an arc, which has a log10 probability and a next state: the longest
    suffix of what was read that is a context. ``fail`` leads to the next shorter context at
    the price ``backoff``.
    """

    def __init__(self, words: np.ndarray, tokens: np.ndarray, known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], denominator: float):
        size, order = len(words), max(known)
        at, hit = find(known[1][0], words)
        self.counts = np.where(hit, known[1][1][at], 0.0) if len(known[1][0]) else np.zeros(size)
        self.root = np.log10((self.counts + SMOOTHING) / denominator)
        states, backoffs, fails = 1, [np.zeros(1)], [np.zeros(1, np.int64)]
        # State of each n-gram of the level below where it is a context itself, else of its longest suffix.
        below_keys, below_state = np.empty(0, np.uint64), np.empty(0, np.int64)
        below_proper = np.empty(0, np.int64)
        arc_keys, arc_logp, arc_next = [], [], []
        hashes = tokens_keys = words[tokens]
        for k in range(1, order + 1):
            if k == 1:
                keys, first = words, None
                tail_state = np.zeros(size, np.int64)
            else:
                n = len(tokens) - k + 1
                tokens_keys = joined(tokens_keys[:-1], tokens_keys[1:]) if len(tokens_keys) else tokens_keys
                place = np.flatnonzero(inner(hashes, k)) if n > 0 else np.empty(0, np.int64)
                _, hit = find(known[k][0], tokens_keys[place])
                keys, own = np.unique(tokens_keys[place[hit]], return_index=True)
                first = place[hit][own]
                head, tail = previous[first], previous[first + 1]
                tail_state = below_state[find(below_keys, tail)[0]] if len(first) else np.empty(0, np.int64)
            at, hit = find(known[k][0], keys)
            weight = np.where(hit, known[k][2][at], np.nan) if len(known[k][0]) else np.full(len(keys), np.nan)
            context = ~np.isnan(weight)
            proper = np.where(context, states + np.cumsum(context) - 1, -1)
            state = np.where(context, proper, tail_state)
            states += int(context.sum())
            backoffs.append(weight[context])
            fails.append(tail_state[context])
            if k == 1:
                self.root_next = state
            else:
                source = below_proper[find(below_keys, head)[0]] if len(first) else np.empty(0, np.int64)
                arc_keys.append(source * size + tokens[first + k - 1])
                arc_logp.append(known[k][1][at])
                arc_next.append(state)
            below_keys, below_state, below_proper, previous = keys, state, proper, tokens_keys
        self.size = size
        self.fail, self.backoff = np.concatenate(fails), np.concatenate(backoffs)
        join = lambda parts: np.concatenate(parts).tolist() if parts else []
        self.arcs = dict(zip(join(arc_keys), zip(join(arc_logp), join(arc_next), strict=True), strict=True))
        self.lists = tuple(x.tolist() for x in (self.fail, self.backoff, self.root, self.root_next))

    def score(self, text: list[int]) -> float:
        """log10 probability of a text, read once from left to right."""
        fail, backoff, root, root_next = self.lists
        get, base, state, total = self.arcs.get, self.size, 0, 0.0
        for w in text:
            while state:
                arc = get(state * base + w)
                if arc is not None:
                    total += arc[0]
                    state = arc[1]
                    break
                total += backoff[state]
                state = fail[state]
            else:
                total += root[w]
                state = root_next[w]
        return total


def score(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text: str = "text", order: int = ORDER, least: int = LEAST, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Rows where ``train_on`` holds are learned from, all are scored; the others are held_out.
    N-grams of 2 to ``order`` words are learned if they occur ``least`` times; words always.
    A null text is an empty one, which is one end. Null ids and repeated rows are scored like
    others. If there is nothing to learn from, no word is known and all have probability 1
    (a score of 0 after log10(0.5 / 0.5)). Other columns are not read. A text is never cut: a
    chunk is as long as its longest text, which a task holds a few times over.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"), F.coalesce(train_on, F.lit(False)).alias("_train"))
    chunks = cut(sequences(rows, chunk_tokens))
    tokens = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    buckets = max(1, -(-tokens // BUCKET_TOKENS))
    states, filters, total, distinct = train(chunks, buckets, order, least)
    told = answers(chunks, states, filters, buckets)
    denominator = total + SMOOTHING * (distinct + 1)
    kind = docs.schema[id_col].dataType.simpleString()

    def read(own: pa.Table, said: pa.Table) -> pa.Table:
        parts = []
        for i in range(own.num_rows):
            words = unpack(own["words"][i].as_py(), rising=True)
            at = unpack(own["seq"][i].as_py(), np.uint32).astype(np.int64)
            known = known_of(asked_keys(words[at], [f.value for f in filters]), said, buckets)
            sizes = own["sizes"][i].values.to_numpy()
            starts = np.append(0, np.cumsum(sizes))
            scores, first = [], 0
            while first < len(sizes):
                # One machine for the texts of some tokens at a time.
                last = max(first + 1, int(np.searchsorted(starts, starts[first] + MACHINE_TOKENS, side="right")) - 1)
                machine = Automaton(words, at[starts[first] : starts[last]], known, denominator)
                scores += [machine.score(at[s:e].tolist()) for s, e in zip(starts[first:last].tolist(), starts[first + 1 : last + 1].tolist(), strict=True)]
                first = last
            seen = np.add.reduceat((machine.counts > 0)[at].astype(np.int64), starts[:-1])
            base = np.add.reduceat(machine.root[at], starts[:-1])
            flags = own["train"][i].values.to_numpy(zero_copy_only=False)
            parts.append(pa.table([own["ids"][i].values, pa.array(~flags), pa.array(sizes), pa.array(seen), pa.array(np.full(len(sizes), total)), pa.array(base), pa.array(scores, pa.float64())], names=names))
        if not parts:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (own.schema.field("ids").type.value_type, pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2), strict=True)})
        return pa.concat_tables(parts)

    names = ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(read, schema).withColumnRenamed("_id", id_col)
