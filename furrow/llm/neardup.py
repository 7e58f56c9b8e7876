"""N-gram Jaccard join: MinHash bands, Bayesian pruning, exact verification.

Texts with the same set of word shingles are one node. Bands of MinHash values put nodes
into buckets; inside a bucket pairs are compared a few values at a time and dropped once the
posterior probability of reaching the threshold is below a tolerance. What survives joins
nodes into candidate components, and inside a component all pairs are verified on their
shingles. Buckets and components that are too big for one task are cut into blocks, and each
pair of blocks is a task of its own. Pairs are never rows: a task sends on counts of links
and a spanning forest, which are no more than its nodes.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.groups import attach
from furrow.session import cut

WORDS = 5
THRESHOLD = 0.8
# 32 bands of 4 values: a pair at the threshold shares no band with probability 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
TOLERANCE = 1e-6
STEP = 16
BLOCK = 512
CACHE_WORDS = 500_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(1 << 31, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, cache: dict[bytes, int], words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``words`` words; of the whole text if shorter.

    Words are in lower case and separated by white space.
    """
    if not text:
        return np.empty(0, dtype=np.uint64)
    found = text.lower().encode("utf-8", "replace").split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(cache.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(words, len(h))
    n = len(h) - width + 1
    key = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        key = (key ^ h[k : k + n]) * _GOLDEN
        key ^= key >> np.uint64(32)
    return np.unique(_mix(key))


def minhash(values: np.ndarray) -> np.ndarray:
    """Smallest of each of HASHES hashes over a set."""
    x = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(x), 4096):
        part = x[start : start + 4096]
        h = part[None, :] * _A[:, None] + _B[:, None]
        # The low bits of a product are weak: fold the high ones in.
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out = np.minimum(out, h.min(axis=1))
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of values compared, the matches below which a pair is dropped.

    With a uniform prior the posterior of the similarity after k of n matches is
    Beta(k + 1, n - k + 1), whose upper tail at t is the lower tail of Binomial(n + 1, t) at k.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail, k = 0.0, 0
        while k <= n:
            tail += comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
            if tail >= tolerance:
                break
            k += 1
        out[n] = k
    return out


def surviving(a: np.ndarray, b: np.ndarray | None, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into a; into b, or into a again) that the comparison doesn't drop."""
    left, right = [], []
    other = a if b is None else b
    for i in range(len(a)):
        start = i + 1 if b is None else 0
        at = np.arange(start, len(other))
        matches = np.zeros(len(at), dtype=np.int32)
        for n, k in least.items():
            if not len(at):
                break
            matches += (other[at, n - STEP : n] == a[i, n - STEP : n]).sum(axis=1, dtype=np.int32)
            keep = matches >= k
            at, matches = at[keep], matches[keep]
        left.append(np.full(len(at), i))
        right.append(at)
    if not left:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) edges that connect what the given pairs connect."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        ri, rj = root(i), root(j)
        if ri != rj:
            parent[max(ri, rj)] = min(ri, rj)
    return [(root(x), x) for x in range(n) if root(x) != x]


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets of a with sets of b."""
    if len(a) * len(b) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], dtype=np.int64).reshape(len(a), len(b))
    # Only values on both sides count; their incidence is multiplied in slices of columns.
    common = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    out = np.zeros((len(a), len(b)), dtype=np.float32)

    def places(sets):
        rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(common, np.concatenate(sets))
        hit = at < len(common)
        hit[hit] = common[at[hit]] == np.concatenate(sets)[hit]
        order = np.argsort(at[hit], kind="stable")
        return rows[hit][order], at[hit][order]

    (ra, ca), (rb, cb) = places(a), places(b)
    for start in range(0, len(common), 4096):
        x, y = np.zeros((len(a), 4096), dtype=np.float32), np.zeros((len(b), 4096), dtype=np.float32)
        for m, r, c in ((x, ra, ca), (y, rb, cb)):
            lo, hi = np.searchsorted(c, [start, start + 4096])
            m[r[lo:hi], c[lo:hi] - start] = 1
        out += x @ y.T
    return np.rint(out).astype(np.int64)


def links(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets with a Jaccard similarity of ``threshold`` or more."""
    other = a if b is None else b
    both = intersections(a, other)
    sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in other])[None, :] - both
    # Multiplied out in whole thousandths of the threshold's digits, so that a tie counts.
    hit = both * 10**6 >= np.round(threshold * 10**6).astype(np.int64) * sizes
    if b is None:
        hit = np.triu(hit, 1)
    return np.nonzero(hit)


def features(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _t, node, n_shingles, signature, bands) of every row; no node without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        cache = _WordHash()
        for b in batches:
            nodes, sizes, signatures, bands = [], [], [], []
            for t in b.column(2):
                values = shingles(t.as_py(), cache)
                sizes.append(len(values))
                if not len(values):
                    nodes.append(None)
                    signatures.append(None)
                    bands.append(None)
                    continue
                raw = values.tobytes()
                own = minhash(values)
                nodes.append(xxhash.xxh3_128_digest(raw))
                signatures.append(own.tobytes())
                folded = _mix(own.astype(np.uint64).reshape(BANDS, ROWS) @ np.array([1, 0x100000001B3, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                bands.append(folded.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["_id", "_t", "node", "n_shingles", "signature", "bands"],
            )

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, _t bigint, node binary, n_shingles int, signature binary, bands array<bigint>")


def _groups(batches, key: int):
    """Rows of one key after another from sorted batches, as lists of columns."""
    held: list[list] | None = None
    current = None
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        keys = columns[key]
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held is not None and keys[start] == current:
                    for h, c in zip(held, columns, strict=True):
                        h.extend(c[start:i])
                else:
                    if held is not None:
                        yield held
                    held, current = [c[start:i] for c in columns], keys[start]
                start = i
    if held is not None:
        yield held


def _blocked(members: DataFrame, sizes: DataFrame, group: str, block: int) -> DataFrame:
    """Members with _task, _side: each pair of blocks of a group is a task.

    ``sizes`` has (group, n). A member of a group of one block goes to one task, one of k
    blocks to k of them; a task on one block compares it with itself, one on two blocks
    compares side 0 with side 1.
    """
    df = members.join(sizes, group).withColumn("_k", F.ceil(F.col("n") / block).cast("int"))
    df = df.withColumn("_own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("_k")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    task = F.xxhash64(group, low, high)
    side = F.when(F.col("_own") == low, 0).otherwise(1)
    return df.withColumns({"_task": task, "_side": side}).drop("n", "_k", "_own", "_other")


def candidate_edges(nodes: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """(a, b): forests over the pairs that bands propose and the comparison doesn't drop."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    marks = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    # Buckets with the same members need one look.
    sizes = cut(marks.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n"))
    members = _blocked(rows.join(sizes.select("bucket"), "bucket", "left_semi"), sizes, "bucket", block)
    signed = members.select("_task", "_side", "node").join(nodes.select("node", "signature"), "node")
    least = least_matches(threshold, tolerance)

    def run(batches):
        for task, side, node, signature in _groups(batches, 0):
            side = np.array(side)
            matrix = np.frombuffer(b"".join(signature), dtype=np.uint32).reshape(len(node), HASHES)
            zero, one = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(one):
                i, j = surviving(matrix[zero], matrix[one], least)
                i, j = zero[i], one[j]
            else:
                i, j = surviving(matrix, None, least)
            edges = forest(len(node), i, j)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([node[x] for x, _ in edges], pa.binary()), pa.array([node[y] for _, y in edges], pa.binary())], names=["a", "b"])

    by_task = signed.select("_task", "_side", "node", "signature").repartition(F.col("_task")).sortWithinPartitions("_task")
    return by_task.mapInArrow(run, "a binary, b binary").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge tables."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that a node is connected with; both of edge ends.

    Large-star and small-star steps in turn: neighbours move to the smallest of them until
    all edges are stars. Minima are combined before the shuffle and written: a join of two
    tables deals both sides itself, and so can split the partition of a node with many edges.
    """
    edges = cut(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a != b").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("a").alias("b"), F.col("b").alias("a")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        small_low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(small_low, "a")
        small = joined.select("b", F.col("m")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_low.select("a", F.col("m").alias("b"))).distinct()
        edges, before = cut(small), mark
        mark = _mark(edges)
        if mark == before:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def verified(docs: DataFrame, spots: DataFrame, threshold: float, id_col: str, text: str, block: int) -> DataFrame:
    """(a, b, n): links of nodes counted on shingles, and forests over them.

    ``spots`` has (_id, _t, node, component, n_docs). A row with b is an edge, one without it
    says that a is linked to n documents of other nodes in one task.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))
    # Always merged: which texts are wanted grows with the corpus, so a broadcast that happens
    # to fit at one size would only hide what the join costs.
    wanted = attach(spots.hint("merge"), own, ["_id", "_t"], "inner").select("node", "component", "n_docs", "_text")

    def sets(batches):
        cache = _WordHash()
        for b in batches:
            values = [shingles(t.as_py(), cache).tobytes() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(values, pa.binary())], names=["node", "component", "n_docs", "set"])

    members = wanted.mapInArrow(sets, "node binary, component binary, n_docs bigint, set binary")
    sizes = spots.groupBy("component").agg(F.count("*").alias("n"))

    def run(batches):
        for _, side, node, weight, raw in _groups(batches, 0):
            # Repeated rows of the chosen text of a node come twice: one is enough.
            first = {}
            for i, (s, x) in enumerate(zip(side, node, strict=True)):
                first.setdefault((s, x), i)
            at = sorted(first.values())
            side, node, weight = np.array(side)[at], [node[i] for i in at], np.array(weight)[at]
            values = [np.frombuffer(raw[i], dtype=np.uint64) for i in at]
            zero, one = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(one):
                i, j = links([values[k] for k in zero], [values[k] for k in one], threshold)
                i, j = zero[i], one[j]
            else:
                i, j = links(values, None, threshold)
            total = np.bincount(i, weight[j], minlength=len(node)) + np.bincount(j, weight[i], minlength=len(node))
            counted = np.flatnonzero(total)
            edges = forest(len(node), i, j)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([node[k] for k in counted] + [node[x] for x, _ in edges], pa.binary()),
                    pa.array([None] * len(counted) + [node[y] for _, y in edges], pa.binary()),
                    pa.array(total[counted].astype(np.int64).tolist() + [0] * len(edges), pa.int64()),
                ],
                names=["a", "b", "n"],
            )

    tasks = _blocked(members, sizes, "component", block).select("_task", "_side", "node", "n_docs", "set")
    return tasks.repartition(F.col("_task")).sortWithinPartitions("_task").mapInArrow(run, "a binary, b binary, n bigint")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(_id, _t, node, class_id, class_t, n_links, n_copies) of every row.

    class_id is the smallest id of a document that links lead to, n_copies the documents with
    the same shingles, itself included, n_links the other documents with a similarity of the
    threshold or more, copies included. A text without words has no shingles, no link and its
    own id as class. A class without any id has none. Rows that repeat an id and a text count
    as documents of their own. An empty table gives no row; other columns are not read.
    """
    rows = cut(features(docs, id_col, text))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.first("signature").alias("signature"), F.first("bands").alias("bands"), F.count("*").alias("n_docs"), F.min(F.struct(F.col("_id").isNull().alias("no"), "_id", "_t")).alias("spot")
    )
    nodes = cut(nodes)
    candidates = components(candidate_edges(nodes, threshold, tolerance, block))
    spots = cut(nodes.select("node", "n_docs", "spot._id", "spot._t").join(candidates, "node"))
    found = cut(verified(docs, spots, threshold, id_col, text, block))
    classes_ = cut(components(found.where("b IS NOT NULL").select("a", "b")))
    counted = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("_other"))
    named = nodes.select("node", "n_docs", "spot").join(classes_, "node", "left").join(counted, "node", "left")
    heads = named.where("component IS NOT NULL").groupBy("component").agg(F.min("spot").alias("_head"))
    named = named.join(heads, "component", "left").select(
        "node", "n_docs", F.coalesce("_head", "spot").alias("_head"), (F.col("n_docs") - 1 + F.coalesce("_other", F.lit(0))).alias("n_links")
    )
    # Written, so that the join deals both sides itself and can split a frequent node.
    out = rows.select("_id", "_t", "node").join(cut(named), "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        "_id",
        "_t",
        "node",
        F.when(alone, F.col("_id")).otherwise(F.col("_head._id")).alias("class_id"),
        F.when(alone, F.col("_t")).otherwise(F.col("_head._t")).alias("class_t"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("n_docs", F.lit(1)).cast("bigint").alias("n_copies"),
    )


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(id, class_id, n_links, n_copies) of every row; see ``classes``."""
    found = classes(docs, id_col, text, threshold, tolerance, block)
    return found.select(F.col("_id").alias(id_col), "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """Rows of ``docs``, with all their columns, without near duplicates.

    Of each class the row with the smallest id stays (of equal ids, the one with the smallest
    text hash; of repeated rows, one). Texts without words all stay.
    """
    found = classes(docs, id_col, text, threshold, tolerance, block)
    kept = found.where("node IS NOT NULL").select("class_id", "class_t").distinct()
    columns = docs.columns
    keyed = docs.withColumn("_t", F.xxhash64(text))
    worded = F.coalesce(F.col(text), F.lit("")).rlike(r"\S")
    chosen = attach(keyed.where(worded), kept.select(F.col("class_id").alias(id_col), F.col("class_t").alias("_t")), [id_col, "_t"], "left_semi")
    once = chosen.dropDuplicates([id_col, "_t"])
    return once.select(*columns).unionByName(keyed.where(~worded).select(*columns))
