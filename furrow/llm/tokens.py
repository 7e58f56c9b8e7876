"""Token counts of a unigram vocabulary without building the tokens.

Aho-Corasick names every vocabulary piece that ends at a place; dynamic programming keeps
only the best score and the number of pieces up to each place.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the unigram tokenizer: the mark of a space, and what an unknown
# character costs beyond the lowest score.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 500_000


def load_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(sp.get_piece_size())
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class PieceCounter:
    """Counts pieces of one stretch of text.

    Ties follow the tokenizer: of equal scores for a place, the piece that starts first
    stays. An unknown character counts its UTF-8 bytes (``byte_fallback``), else a run of
    unknown characters counts one.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback

    def count(self, word: str) -> int:
        n = len(word)
        if not n:
            return 0
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        single = [False] * n
        if len(self.automaton):
            for end, (size, score) in self.automaton.iter(word):
                ending[end].append((size, score))
                if size == 1:
                    single[end] = True
        best, pieces, unknown_end = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            found = ending[end]
            if len(found) > 1:
                found.sort(reverse=True)  # the earliest start first; only a better score replaces it
            top = None
            for size, score in found:
                start = end + 1 - size
                total = best[start] + score
                if top is None or total > top:
                    top, count = total, pieces[start] + 1
            from_unknown = False
            if not single[end]:
                total = best[end] + self.unknown
                if top is None or total > top:
                    top, from_unknown = total, True
                    if self.byte_fallback:
                        count = pieces[end] + len(word[end].encode("utf-8", "surrogatepass"))
                    else:
                        count = pieces[end] + (0 if unknown_end[end] else 1)
            best[end + 1], pieces[end + 1], unknown_end[end + 1] = top, count, from_unknown
        return pieces[n]


class _Cache(dict):
    """Counts of words seen by one task; forgets all at a bound."""

    def __init__(self, counter: PieceCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self.counter.count(word)
        if len(word) <= 64:
            self[word] = n
        return n


def count_text(text: str | None, cache: dict[str, int]) -> int:
    """Pieces of a whole text: a mark before it and for each space; no piece crosses a mark."""
    if not text:
        return 0
    marked = text.replace(" ", "\0" + MARK) if "\0" not in text else None
    if marked is None:
        return sum(cache[MARK + part] for part in text.split(" "))
    start = "" if text[0] in (" ", MARK) else MARK
    parts = (start + marked).split("\0")
    return sum(map(cache.__getitem__, parts))


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id", text: str = "text", byte_fallback: bool = True) -> DataFrame:
    """(id, n_tokens) of every row of ``docs``.

    One narrow pass: no shuffle, texts are read in Arrow batches, and each task remembers the
    counts of the words it met up to a bound. A null or empty text has 0 tokens; repeated rows
    and null ids stay; other columns are not read. The vocabulary is a parameter whose size
    does not depend on the data.
    """
    given = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType

    def run(batches):
        cache = _Cache(PieceCounter(given.value, byte_fallback))
        for b in batches:
            counts = pa.array([count_text(t.as_py(), cache) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), counts], names=[id_col, "n_tokens"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_tokens bigint")
