"""Fill-in-the-middle: texts cut at two units and rearranged behind sentinels.

A text is divided by a rolling hash of its bytes into content-defined chunks. A chunk's
summary (units that start inside it, its first and its last byte) does not depend on where
it lies, so copies of a chunk are counted once per worker: the memo is keyed by the chunk's
own bytes, which verifies the match by content. Summaries combine from left to right: the
sum of the counts, and one more where a unit starts on a chunk's first byte. Running sums
locate the chunk that holds a cut; only that chunk is searched for the byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.frames import with_arrays

SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_FROM = 90  # of 100: a draw at or above it leaves the text as it is
SPM_BELOW = 20  # of 100: a draw below it puts the suffix first
# A chunk ends where the last 32 bytes' hash has these bits 0: 1,024 bytes on average.
MASK = np.uint32(((1 << 10) - 1) << 20)
WINDOW = 32
LEAST, MOST = 128, 8192
BLOCK = 1 << 22
MEMO_BYTES = 1 << 25

_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
_BYTES = np.arange(256)
# Whether a byte can start a unit, and whether the byte before lets one start.
_STARTS = {
    "codepoint": ((_BYTES & 0xC0) != 0x80, np.ones(256, bool)),
    "word": (~np.isin(_BYTES, [32, *range(9, 14)]), np.isin(_BYTES, [32, *range(9, 14)])),
}
UNITS = tuple(_STARTS)


def ends_of_chunks(data: bytes) -> list[int]:
    """End of each chunk of one text, the last one being the text's end.

    A boundary depends on the 32 bytes before it only, and none lies within a chunk's first
    ``LEAST`` bytes or later than ``MOST``: equal passages have equal chunks once they agree on
    a boundary.
    """
    n, ends, last = len(data), [], 0
    if n > LEAST:
        a = np.frombuffer(data, dtype=np.uint8)
        for start in range(0, n, BLOCK):
            lead = min(start, WINDOW - 1)
            h = _GEAR[a[start - lead : start + BLOCK]]
            shift = 1
            while shift < WINDOW:
                h[shift:] += h[:-shift] << np.uint32(shift)
                shift *= 2
            for at in np.flatnonzero((h[lead:] & MASK) == 0) + start + 1:
                while at - last > MOST:
                    last += MOST
                    ends.append(last)
                if at - last >= LEAST:
                    last = int(at)
                    ends.append(last)
        while n - last > MOST:
            last += MOST
            ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def unit_starts(chunk: bytes, unit: str) -> np.ndarray:
    """Whether a unit starts at each byte after the first."""
    can, lets = _STARTS[unit]
    a = np.frombuffer(chunk, dtype=np.uint8)
    return can[a[1:]] & lets[a[:-1]]


class Counter:
    """Chunk summaries of one worker, found again by content; old ones go at ``memo_bytes``."""

    def __init__(self, unit: str = "codepoint", memo_bytes: int = MEMO_BYTES):
        self.unit, self.room, self.held = unit, memo_bytes, 0
        self.memo: dict[bytes, int] = {}
        self.found = 0
        can, lets = _STARTS[unit]
        self.can, self.lets = can.tolist(), lets.tolist()

    def inner(self, chunk: bytes) -> int:
        """Units that start after the chunk's first byte."""
        n = self.memo.get(chunk)
        if n is None:
            n = int(np.count_nonzero(unit_starts(chunk, self.unit)))
            if self.held + len(chunk) > self.room:
                self.memo.clear()
                self.held = 0
            self.memo[chunk] = n
            self.held += len(chunk)
        else:
            self.found += 1
        return n

    def summaries(self, data: bytes) -> tuple[list[int], list[int]]:
        """(start of each chunk, units that start before it), with the text's end and total last.

        The text's first byte always starts a unit.
        """
        starts, before, total, at = [], [], 0, 0
        for end in ends_of_chunks(data):
            starts.append(at)
            before.append(total)
            joint = at == 0 or (self.can[data[at]] and self.lets[data[at - 1]])
            total += joint + self.inner(data[at:end])
            at = end
        return [*starts, at], [*before, total]

    def locate(self, data: bytes, starts: list[int], before: list[int], k: int) -> int:
        """Byte at which unit ``k`` (from 0) starts; the end of the text for the number of units."""
        if k >= before[-1]:
            return len(data)
        c = int(np.searchsorted(before, k, side="right")) - 1
        at, rest = starts[c], k - before[c]
        joint = at == 0 or (self.can[data[at]] and self.lets[data[at - 1]])
        if joint:
            if rest == 0:
                return at
            rest -= 1
        return at + 1 + int(np.flatnonzero(unit_starts(data[at : starts[c + 1]], self.unit))[rest])


def rearrange(data: bytes, draws: tuple[int, int, int, int], counter: Counter, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW):
    """(form, output, units, prefix units, middle units) of one text; the last two None if plain."""
    starts, before = counter.summaries(data)
    n = before[-1]
    if n == 0 or draws[2] % 100 >= plain_from or any(s.encode() in data for s in SENTINELS):
        return "plain", data, n, None, None
    lo, hi = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    i, j = counter.locate(data, starts, before, lo), counter.locate(data, starts, before, hi)
    prefix, middle, suffix = data[:i], data[i:j], data[j:]
    if draws[3] % 100 < spm_below:
        return "spm", b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle, n, lo, hi - lo
    return "psm", b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle, n, lo, hi - lo


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    unit: str = "codepoint",
    seed: int = 1,
    plain_from: int = PLAIN_FROM,
    spm_below: int = SPM_BELOW,
) -> DataFrame:
    """``docs`` with n_units, form (plain, psm or spm), prefix_units, middle_units and output.

    Cuts and form are drawn from the sha256 of ``seed:id``, so they depend on neither order
    nor partitioning; repeated ids are cut by the same draws, a null id counts as no digits.
    A null or empty text, and one that holds a sentinel, stay plain (a null gives the empty
    output). A text of any length is handled whole, at the memory of a few copies of it. A
    unit is a code point, or with ``word`` a word and the spaces after it. Rows stay in place;
    other columns pass through unless they have a name that is added; an empty table gives no
    row.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    counter = None

    def make(columns):
        nonlocal counter
        counter = counter or Counter(unit)
        rows = []
        for h, t in zip(columns[0].to_pylist(), columns[1].cast(pa.binary()), strict=True):
            draws = tuple(int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
            rows.append(rearrange(t.as_py() or b"", draws, counter, plain_from, spm_below))
        form, out, n, lo, mid = zip(*rows, strict=True) if rows else ((),) * 5
        return [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(lo, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]

    added = [("n_units", T.LongType()), ("form", T.StringType()), ("prefix_units", T.LongType()), ("middle_units", T.LongType()), ("output", T.StringType())]
    return with_arrays(docs, docs.columns, [drawn, F.coalesce(F.col(f"`{text}`"), F.lit(""))], added, make)


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` had, from its output and form alone.

    No part holds a sentinel and no sentinel overlaps itself, so the first place of each is
    the one that was written.
    """
    p, s, m = (F.locate(x, output) for x in SENTINELS)
    part = lambda a, b: F.substring(output, a + 3, b - a - 3)
    rest = F.substring(output, m + 3, F.length(output))
    psm = F.concat(part(p, s), rest, part(s, m))
    spm = F.concat(part(p, m), rest, part(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
