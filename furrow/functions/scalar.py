"""Row-level feature expressions; every function takes and returns columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den where den > 0, else null."""
    return F.when(den > 0, num / den)


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def daily_kilos(pred: Column, hours: Column) -> Column:
    """Rate x hours, four decimals half-even; null without hours."""
    return F.when(hours.isNotNull(), half_even(pred * hours, 4))


def iso_week(date: Column) -> Column:
    """ISO week label ``YYYY-Www``."""
    year = F.extract(F.lit("yearofweek"), date)
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def hash_bucket(key: Column, seed: object = 0) -> Column:
    """Uniform 32-bit integer from md5 of ``seed|key``: the same on every engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_order(key: Column, seed: object = 0) -> Column:
    """Text that sorts rows in a repeatable shuffled order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_uniform(key: Column, seed: object = 0) -> Column:
    return (hash_bucket(key, seed) + 0.5) / float(2**32)


def poisson_one(u: Column, most: int = 12) -> Column:
    """Poisson(1) count from a uniform number by its cumulative probabilities."""
    total, edges = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        edges.append(total)
    out = F.lit(0)
    for edge in edges:
        out = out + (u > F.lit(edge)).cast("int")
    return out


# Fixed odd multipliers of the replicate weights; products of 32-bit numbers stay in 63 bits.
WEIGHT_MIX = (1640531527, 1597334677, 2146121005)


def replicate_uniform(x: Column, y: Column, b: Column) -> Column:
    """Uniform number of a row (two 32-bit hashes) in replicate ``b``, in plain integers."""
    a, c, d = (F.lit(m).cast("bigint") for m in WEIGHT_MIX)
    size = F.lit(1 << 32).cast("bigint")
    h = (x * a + y + b.cast("bigint") * c) % size
    h = h.bitwiseXOR(F.shiftright(h, 15)) * d % size
    return (h.bitwiseXOR(F.shiftright(h, 13)) + 0.5) / float(2**32)


def replicate_weights(x: np.ndarray, y: np.ndarray, replicates: int, most: int = 12) -> np.ndarray:
    """Poisson(1) weights of rows (first axis) in replicates 1 and up; ``poisson_one`` of
    ``replicate_uniform`` for whole arrays."""
    a, c, d = WEIGHT_MIX
    bits = np.int64((1 << 32) - 1)
    b = (np.arange(1, replicates + 1, dtype=np.int64) * c & bits).astype(np.uint32)
    # Numbers of 32 bits wrap as the remainders of replicate_uniform do.
    h = (np.asarray(x * a + y, np.int64) & bits).astype(np.uint32)[:, None] + b[None, :]
    h ^= h >> np.uint32(15)
    h *= np.uint32(d)
    h ^= h >> np.uint32(13)
    out = np.zeros(h.shape, np.uint8)
    for edge in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(most)]):
        least = math.floor(edge * 2**32 - 0.5) + 1
        if least < 2**32:
            out += h >= np.uint32(least)
    return out.astype(np.float64)


def cyclic_date(date: Column, extra: bool = False) -> dict[str, Column]:
    """Month harmonics 1-3, ISO-week harmonic 1 (and 2), year."""
    month, week = F.month(date).cast("double"), F.weekofyear(date).cast("double")
    out = {}
    for h, suffix in ((1, ""), (2, "2"), (3, "3")):
        angle = F.lit(2 * h * math.pi) * month / 12.0
        out[f"mes_sin{suffix}"], out[f"mes_cos{suffix}"] = F.sin(angle), F.cos(angle)
    for h, suffix in ((1, ""), (2, "2")) if extra else ((1, ""),):
        angle = F.lit(2 * h * math.pi) * week / 52.0
        out[f"semana_sin{suffix}"], out[f"semana_cos{suffix}"] = F.sin(angle), F.cos(angle)
    out["anio"] = F.year(date)
    return out


def season_flags(date: Column, high, low) -> dict[str, Column]:
    return {
        "temporada_alta": F.month(date).isin(list(high)).cast("int"),
        "temporada_baja": F.month(date).isin(list(low)).cast("int"),
    }


def trend_index(date: Column, anchor: Column) -> dict[str, Column]:
    days = F.datediff(date, anchor).cast("double")
    return {"t_index_days": days, "t_index_years": days / 365.25}


def structural_ratios(kg_ha="kg_ha", ha="ha", indus="indus_pct", p_baya="p_baya", dpc="dpc") -> dict[str, Column]:
    c = F.col
    return {
        "kg_total": c(kg_ha) * c(ha),
        "indus_kg_ha": c(indus) * c(kg_ha),
        "kg_per_baya": safe_ratio(c(kg_ha), c(p_baya)),
        "kg_ha_per_dpc": safe_ratio(c(kg_ha), c(dpc)),
    }


def log_positive(x: Column) -> Column:
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def log_signed(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def width_bin_right(x: Column, low: Column, high: Column, bins: Column) -> Column:
    """0-based equal-width bin, right-closed, the lowest value in the first bin."""
    step = (high - low) / bins
    return F.when(high == low, F.floor((bins - 1) / 2)).otherwise(
        F.least(F.greatest(F.ceil((x - low) / step) - 1, F.lit(0)), bins - 1)
    ).cast("int")


def width_bin_left(x: Column, low: Column, high: Column, bins: Column) -> Column:
    """0-based equal-width bin, left-closed, the highest value in the last bin."""
    step = (high - low) / bins
    return F.when(high == low, F.floor(bins / 2)).otherwise(
        F.least(F.greatest(F.floor((x - low) / step), F.lit(0)), bins - 1)
    ).cast("int")


def edge_bin_right(x: Column, edges: Column) -> Column:
    """0-based bin by a sorted array of edges, right-closed, first bin closed."""
    below = F.size(F.filter(edges, lambda e: e < x))
    return F.when(x.isNotNull(), F.greatest(below - 1, F.lit(0)))


def edge_bin_left(x: Column, inner: Column) -> Column:
    """0-based bin by a sorted array of inner edges, left-closed, open ends."""
    return F.when(x.isNotNull(), F.size(F.filter(inner, lambda e: e <= x)))


def normalize_text(x: Column) -> Column:
    """Trim, upper case, single spaces."""
    return F.upper(F.trim(F.regexp_replace(x, r"\s+", " ")))


def catalog_value(x: Column, allowed: list[str], default: str | None = None) -> Column:
    """Normalised member of a closed catalog; blank gives the default, others null."""
    text = normalize_text(x)
    blank = text.isNull() | (text == "")
    return F.when(blank, F.lit(default)).when(text.isin(allowed), text)
