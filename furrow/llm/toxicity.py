"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, with Nyström landmarks.

The kernel compares words by the four-letter subsequences they share; a subsequence counts
less the further it is spread, up to ``SPAN`` letters, so a word with letters inserted,
doubled or left out stays close to the plain one. A text is a bag of sentences and a sentence
a bag of words. A label says that a text has a toxic sentence, not which: training begins
with words whose texts are toxic beyond chance, then alternates between fitting the machine
and picking each labelled text's most toxic word under it: the witness of a toxic sentence,
or the hardest counter-example of a clean text. A text scores as its most toxic word.

The feature space of this kernel is finite, so the landmarks' weights fold into one weight
for each subsequence (hashed to ``BUCKETS``); scoring is a gather and a sum, equal to
evaluating the kernel with every landmark.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.frames import with_arrays
from furrow.session import cut

ORDER = 4
SPAN = 6
DECAY = 0.5
# Labelled texts used of each label, about; chosen by a hash of the text over all of that label.
FIT_ROWS = 10_000
LANDMARKS = 384
ROUNDS = 2
# Rounds of made-up misspellings of each toxic word, and the most texts a word counts for.
VARIANTS = 3
WEIGHT = 50.0
# Letters of a word; longer runs are read in overlapping parts.
LONGEST = 20
EMPTY = -3.0
# Least log-odds of a word between toxic and clean texts to be a witness.
ODDS = 1.5
# Words remembered with their value by a worker before it begins anew.
MEMO = 1 << 19
# Characters of texts, and new tokens, that a worker handles at a time.
CHUNK = 1 << 20
TOKENS = 1 << 12

_EDGE = 27
# Buckets of hashed subsequences: the folded weights take 8 MB.
BUCKETS = 1 << 20
# Distances of the later letters from the first, and the weight of each choice of them.
_GAPS = [(*inner, last, DECAY ** (last - ORDER + 1)) for last in range(ORDER - 1, SPAN) for inner in combinations(range(1, last), ORDER - 2)]
_LETTERS = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[\s.,*_|/\\-]+[^\W\d_]){3,}(?![^\W_])")
_SENTENCE = re.compile(r"[.!?\n]+")
_DIGITS = str.maketrans("013457", "oieast")


def codes(word: str) -> list[int]:
    """Letters as 1 to 26, others hashed to 28 to 63."""
    return [o - 96 if 97 <= (o := ord(c)) <= 122 else 28 + o % 36 for c in word]


def plain_letters(token: str) -> str:
    """Digits beside letters as the letters they stand for."""
    if any(c in token for c in "013457") and _LETTERS.search(token):
        token = token.translate(_DIGITS)
    return token


def words_of_token(token: str) -> list[str]:
    """What a run of other than spaces may say: its letters in one, and each of its runs of letters."""
    token = plain_letters(token)
    if token.isalpha():
        runs = [token]
    else:
        runs = _LETTERS.findall(token)
        if len(runs) > 1:
            runs = {"".join(runs), *[r for r in runs if len(r) > 2]}
    out = []
    for r in runs:
        if len(r) <= LONGEST:
            out.append(r)
        else:
            out.extend(r[i : i + LONGEST] for i in range(0, len(r) - LONGEST // 2, LONGEST // 2))
    return out


def tokens_of(text: str) -> set[str]:
    """Distinct lower-case tokens, and letters spaced out over a text as one token each."""
    low = text.lower()
    found = set(low.split())
    for m in _SPACED.finditer(low):
        found.add("".join(_LETTERS.findall(m.group())))
    return found


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, value) triples of the normalised feature vectors, in order of word.

    A word stands between two edge marks, so beginnings and ends count.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    lengths = np.array([len(w) + 2 for w in words])
    a = np.array([c for w in words for c in (_EDGE, *codes(w), _EDGE)] + [0] * SPAN, dtype=np.int64)
    n = int(lengths.sum())
    row = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
    keys, values = [], []
    for *places, weight in _GAPS:
        ok = np.flatnonzero(left > places[-1])
        key = a[ok]
        for i in places:
            key = (key << 6) | a[ok + i]
        key = (key * 0x9E3779B1 >> 12) & (BUCKETS - 1)
        keys.append((row[ok] << 20) | key)
        values.append(np.full(len(ok), weight))
    key, value = np.concatenate(keys), np.concatenate(values)
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    value, key = np.add.reduceat(value, first), key[first]
    row = key >> 20
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(words)))
    return row, key & (BUCKETS - 1), value / norm[row]


_PLACES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of each subsequence, power of its decay) in a word of ``n`` signs, edges included."""
    if n not in _PLACES:
        found = [(i, *(i + g for g in gaps), gaps[-1] - ORDER + 1) for *gaps, _ in _GAPS for i in range(n - gaps[-1])]
        table = np.array(found, dtype=np.int64).reshape(len(found), ORDER + 1)
        _PLACES[n] = table[:, :-1].T.copy(), table[:, -1]
    return _PLACES[n]


def products(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Product of each word's normalised feature vector with ``weights``; as from ``features``, word lengths at a time."""
    out = np.zeros(len(words))
    lengths = np.array([len(w) for w in words])
    decay = DECAY ** np.arange(SPAN - ORDER + 1)
    for n in np.unique(lengths).tolist():
        places, power = _places(n + 2)
        if not len(power):
            continue
        at = np.flatnonzero(lengths == n)
        a = np.full((len(at), n + 2), _EDGE, dtype=np.int64)
        a[:, 1:-1] = np.array([codes(words[i]) for i in at]).reshape(len(at), n)
        key = a[:, places[0]]
        for p in places[1:]:
            key = (key << 6) | a[:, p]
        key = (key * 0x9E3779B1 >> 12) & (BUCKETS - 1)
        # Sorted with their powers in the low bits, equal subsequences of a word lie together.
        packed = np.sort(((key << 4) | power).astype(np.int32), axis=1)
        key, value = packed >> 4, decay[packed & 15]
        new = np.ones(key.shape, bool)
        new[:, 1:] = key[:, 1:] != key[:, :-1]
        starts = np.flatnonzero(new)
        squares = np.add.reduceat(value.ravel(), starts) ** 2
        norm = np.bincount(starts // key.shape[1], squares, len(at))
        out[at] = (weights[key] * value).sum(axis=1) / np.sqrt(norm)
    return out


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised kernel of each word of ``a`` with each of ``b``."""
    row, key, value = features(b)
    known, at = np.unique(key, return_inverse=True)
    dense = np.zeros((len(known), len(b)))
    dense[at, row] = value
    out = np.zeros((len(a), len(b)))
    for start in range(0, len(a), 256):
        r, k, v = features(a[start : start + 256])
        place = np.searchsorted(known, k)
        ok = (place < len(known)) & (known[np.minimum(place, len(known) - 1)] == k)
        r, place, v = r[ok], place[ok], v[ok]
        starts = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else []
        if len(r):
            out[start + r[starts]] = np.add.reduceat(dense[place] * v[:, None], starts, axis=0)
    return out


def fit_machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and offset of the squared-hinge machine, by Newton steps on the active rows.

    Each side's weights are scaled to the same sum, so that rare toxic words count as much as
    all others.
    """
    x = np.column_stack([z, np.ones(len(z))])
    c = np.where(y > 0, weight / weight[y > 0].sum(), weight / weight[y < 0].sum()) * len(y) / 2
    w = np.zeros(x.shape[1])
    ridge = np.append(np.full(z.shape[1], penalty), 1e-6)
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, ca = x[active], c[active]
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + np.diag(ridge), (xa * ca[:, None]).T @ y[active])
        # Halve the step until the loss falls.
        loss = lambda v: (ridge * v * v).sum() + (c * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
        step, before = 1.0, loss(w)
        while step > 1e-3 and loss(w + step * (new - w)) > before:
            step /= 2
        moved = step * (new - w)
        w = w + moved
        if np.abs(moved).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Folded weights of all subsequences and an offset; slope and offset of the probability."""

    weights: np.ndarray | None
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    landmarks: tuple[str, ...] = ()
    alphas: np.ndarray | None = None

    def values(self, words: list[str]) -> np.ndarray:
        return products(words, self.weights) + self.offset

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * value + self.shift, -30, 30)))


def machine(landmarks: list[str], words: list[str], y: np.ndarray, weight: np.ndarray) -> Model:
    """Nyström features from the landmarks, the machine on them, and its weights folded."""
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    w, b = fit_machine(kernel(words, landmarks) @ root, y, weight)
    alphas = root @ w
    row, key, value = features(landmarks)
    return Model(np.bincount(key, value * alphas[row], minlength=BUCKETS), b, landmarks=tuple(landmarks), alphas=alphas)


class Scorer:
    """Most toxic word of texts; each distinct token is valued once as long as it is remembered."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def best(self, texts: Iterable[str | None]) -> tuple[np.ndarray, list[str | None]]:
        values, which, bags, size = [], [], [], 0
        for t in texts:
            bags.append(tokens_of(t) if t else ())
            size += len(t or "")
            if size >= CHUNK:
                self._value(bags, values, which)
                bags, size = [], 0
        self._value(bags, values, which)
        return np.array(values, dtype=float), which

    def _value(self, bags: list, values: list[float], which: list[str | None]) -> None:
        if len(self.memo) > MEMO:
            self.memo = {}
        memo = self.memo
        new = list(set().union(*bags) - memo.keys())
        for start in range(0, len(new), TOKENS):
            some = new[start : start + TOKENS]
            words, owner = [], []
            for k, t in enumerate(some):
                mine = words_of_token(t)
                words += mine
                owner += [k] * len(mine)
            top = np.full(len(some), EMPTY)
            if words:
                np.maximum.at(top, owner, self.model.values(words))
            memo.update(zip(some, top.tolist(), strict=True))
        for bag in bags:
            value = max(map(memo.__getitem__, bag), default=EMPTY)
            values.append(value)
            # The least of equal tokens, so that the choice doesn't depend on the order of a set.
            which.append(min(t for t in bag if memo[t] == value) if value > EMPTY else None)


def variants(words: list[str], rng: np.random.Generator) -> list[tuple[str, str]]:
    """(variant, word): each word of four letters or more with a letter doubled, with one inserted and, from five on, with one left out."""
    out = []
    for w in words:
        if len(w) >= 4:
            i, j, k = rng.integers(1, len(w) - 1, 3)
            out += [(w[:i] + w[i - 1] + w[i:], w), (w[:j] + chr(97 + rng.integers(0, 26)) + w[j:], w)]
            if len(w) >= 5:
                out.append((w[:k] + w[k + 1 :], w))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, label) of about ``fit_rows`` documents of each label, for ``fit``.

    Ids, labels and text hashes are joined first; the texts of the chosen ids, whose number
    is bounded, are then picked where they lie, so no text is shuffled.
    """
    ids = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(f"`{text}`", F.lit("fit")).alias("_h"))
    marks = labels.where(F.col(f"`{label}`").isNotNull()).select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label}`").alias("_y"))
    both = cut(ids.join(marks, "_id"))
    sizes = {r["_y"]: r["count"] for r in both.groupBy("_y").count().collect()}
    share = F.lit(1.0)
    for value, n in sizes.items():
        share = F.when(F.col("_y") == value, F.lit(min(1.0, fit_rows / n))).otherwise(share)
    chosen = both.where(F.pmod(F.col("_h"), F.lit(1 << 30)) < share * (1 << 30)).select("_id", "_y").distinct()
    picked = docs.join(F.broadcast(chosen), F.col(f"`{id_col}`") == F.col("_id"))
    return picked.select(F.col(f"`{text}`").alias(text), F.col("_y").alias(label))


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS, n_landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model:
    """A model from labelled texts (1 is toxic; rows without a label or a text are left out).

    About ``fit_rows`` texts of each label are used, chosen by a hash of the text. Spark
    counts their words and picks witnesses; the driver gets at most ``fit_rows`` words a
    label and round. Without texts of both labels the model has no weights.
    """
    rows = labelled.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    rows = rows.select((F.col(f"`{label}`") == 1).cast("int").alias("y"), F.col(f"`{text}`").alias("t"))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Model(None, 1.0 if 1 in sizes else 0.0)
    share = F.when(F.col("y") == 1, F.lit(min(1.0, fit_rows / sizes[1]))).otherwise(F.lit(min(1.0, fit_rows / sizes[0])))
    sample = cut(rows.where(F.pmod(F.xxhash64("t", F.lit("fit")), F.lit(1 << 30)) < share * (1 << 30)))

    def words(batches):
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                mine = sorted({w for x in tokens_of(t.as_py()) for w in words_of_token(x)})
                yield pa.RecordBatch.from_arrays([pa.array(mine, pa.string()), pa.array([y] * len(mine), pa.int32())], names=["word", "y"])

    counts = sample.mapInArrow(words, "word string, y int").groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    counts = cut(counts.withColumn("n", F.col("a") + F.col("b")))
    per = {r["y"]: float(r["count"]) for r in sample.groupBy("y").count().collect()}
    if len(per) < 2:
        return Model(None, 1.0 if 1 in per else 0.0)
    p = per[1] / (per[1] + per[0])
    part = lambda k, share: F.when(k > 0, k * F.log(k / (F.col("n") * share))).otherwise(0.0)
    counts = counts.withColumn("o", F.log((F.col("a") + 0.5) / per[1]) - F.log((F.col("b") + 0.5) / per[0]))
    # Seeds hold against as many chances as there are words.
    sure = np.log(max(counts.count(), 1)) + 2
    llr = part(F.col("a"), p) + part(F.col("b"), 1 - p)
    likely = counts.where((F.col("o") > ODDS) & (F.col("a") > 1)).withColumn("g", llr)
    seeds = likely.where(F.col("g") > sure).orderBy(F.desc("g"), "word").limit(4 * n_landmarks).toPandas()
    if seeds.empty:
        seeds = likely.orderBy(F.desc("g"), "word").limit(16).toPandas()
    if seeds.empty:
        seeds = counts.where("a > 0").orderBy(F.desc("o"), F.desc("a"), "word").limit(16).toPandas()
    if seeds.empty:
        return Model(None, 0.0)
    often = counts.where(F.col("o") <= 0).orderBy(F.desc("b"), "word").limit(fit_rows // 4).toPandas()
    other = counts.where("a = 0").orderBy(F.xxhash64("word", F.lit("other")), "word").limit(fit_rows // 2).toPandas()
    seeds = dict(zip(seeds["word"], seeds["a"].astype(float), strict=True))
    bad = {w: 1.0 for w in [*often["word"], *other["word"]] if w not in seeds} or {"": 1.0}
    good = dict(seeds)
    rng = np.random.default_rng(11)
    for turn in range(rounds + 1):
        ordered = sorted(good, key=lambda w: (-good[w], w))
        more = {v: w for _ in range(VARIANTS) for v, w in variants(ordered[:n_landmarks], rng) if v not in good and v not in bad}
        half = ordered[: n_landmarks // 2]
        hard = sorted(bad, key=lambda w: (-bad[w], zlib.crc32(w.encode())))[: n_landmarks - len(half)]
        rows_ = [*ordered, *more, *bad]
        y = np.array([1.0] * (len(ordered) + len(more)) + [-1.0] * len(bad))
        weight = np.array([good[w] for w in ordered] + [good[w] / VARIANTS / 2 for w in more.values()] + [1.0] * len(bad))
        model = machine([*half, *hard], rows_, y, np.minimum(weight, WEIGHT))
        if turn == rounds:
            break

        def pick(batches, shared=model):
            scorer = Scorer(shared)
            for b in batches:
                values, which = scorer.best(x.as_py() for x in b.column(1))
                out = []
                for y, v, w in zip(b.column(0).to_pylist(), values, which, strict=True):
                    if w is not None:
                        mine = words_of_token(w)
                        out.append((y, mine[int(np.argmax(shared.values(mine)))], v))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.int32(), pa.string(), pa.float64()), strict=True)], names=["y", "word", "v"])

        picked = sample.mapInArrow(pick, "y int, word string, v double").groupBy("y", "word").agg(F.count("*").alias("n"), F.max("v").alias("v"))
        picked = picked.join(counts.select("word", "o"), "word", "left").select("y", "word", "n", "v", F.coalesce("o", F.lit(0.0)).alias("o")).toPandas()
        toxic, harmless = picked[picked["y"] == 1], picked[picked["y"] == 0]
        # A witness stands out from what nearly all clean texts hold at most, and is rare in them.
        order = harmless.sort_values("v")
        limit = float(np.interp(0.98 * order["n"].sum(), order["n"].cumsum(), order["v"])) if len(order) else -np.inf
        chosen = toxic[(toxic["o"] > ODDS) & (toxic["v"] > limit)]
        for w, n in [*harmless[["word", "n"]].itertuples(index=False), *toxic[toxic["o"] <= 0][["word", "n"]].itertuples(index=False)]:
            bad[w] = bad.get(w, 1.0) + n
        good = dict(seeds)
        for w, n in chosen[["word", "n"]].itertuples(index=False):
            good[w] = max(good.get(w, 0.0), float(n))
        bad = {w: n for w, n in bad.items() if w not in good}

    final = model

    def top(batches):
        scorer = Scorer(final)
        for b in batches:
            value, _ = scorer.best(x.as_py() for x in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value)], names=["y", "v"])

    seen = sample.mapInArrow(top, "y int, v double").toPandas()
    model.slope, model.shift = platt(seen["v"].to_numpy(), seen["y"].to_numpy())
    return model


def platt(value: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve of the label over the value.

    The curve is one half in the middle of the values that set the labels apart with the
    fewest errors; its slope is the likeliest one, with labels drawn in by one case a side.
    """
    order = np.argsort(value, kind="stable")
    v, t = value[order], y[order]
    errors = np.append(0, np.cumsum(t == 1)) + np.append(np.cumsum((t == 0)[::-1])[::-1], 0)
    # A cut lies between different values, or beyond the last one on either side.
    edges = np.concatenate([[v[0] - 1], v, [v[-1] + 1]])
    gap = np.diff(edges)
    best = np.flatnonzero((errors == errors[gap > 0].min()) & (gap > 0))
    k = best[np.argmax(gap[best])]
    middle = (edges[k] + edges[k + 1]) / 2
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, slope = value - middle, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x, -30, 30)))
        step = ((p - target) * x).sum() / ((p * (1 - p) * x * x).sum() + 1e-3)
        slope = min(max(slope - np.clip(step, -2, 2), 0.5), 20.0)
        if abs(step) < 1e-8:
            break
    return float(slope), float(-slope * middle)


def sentence_of(text: str, token: str) -> str | None:
    """The first sentence that holds a token, spaced letters included."""
    for s in _SENTENCE.split(text):
        if token in tokens_of(s):
            return s.strip()
    return None


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text", sentences: bool = False) -> DataFrame:
    """``keep`` columns (all others than the text by default) with score, predicted and toxic_word.

    The score is the probability that the text's most toxic word makes; ``toxic_word`` is that
    word as the text has it in lower case, the least of equal ones, and ``toxic_sentence``, if
    wanted, the first sentence that holds it (null where the word spans sentences). A null or
    empty text and one without letters have the score of the value ``EMPTY`` and no word. A
    model without weights gives its offset as score to every text. Whole texts are read, of
    any length. Rows stay in place; an empty table gives no row; kept columns with an added
    name give way.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorer = None

    def make(columns):
        nonlocal scorer
        model = shared.value
        texts = columns[0]
        if model.weights is None:
            p, which = np.full(len(texts), model.offset), [None] * len(texts)
        else:
            scorer = scorer or Scorer(model)
            value, which = scorer.best(t.as_py() for t in texts)
            p = model.probability(value)
        out = [pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(which, pa.string())]
        if sentences:
            out.append(pa.array([sentence_of(t.as_py(), w) if w else None for t, w in zip(texts, which, strict=True)], pa.string()))
        return out

    added = [("score", T.DoubleType()), ("predicted", T.IntegerType()), ("toxic_word", T.StringType())]
    if sentences:
        added.append(("toxic_sentence", T.StringType()))
    return with_arrays(docs, keep, [F.col(f"`{text}`")], added, make)
