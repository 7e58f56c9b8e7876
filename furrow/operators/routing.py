"""Choosing a donor (anchor) for small varieties by distribution and by prediction."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from furrow.columns import ROW_ID, VARIETY
from furrow.functions.scalar import hash_bucket, replicate_weights
from furrow.functions.stats import binomial_tail, melt
from furrow.operators.groups import attach, quantiles
from furrow.operators.ordered import sliced
from furrow.operators.ranks import holm, mann_whitney_of
from furrow.session import cut

EFFECT_SMALL, EFFECT_MEDIUM, MIN_VALIDATE = 0.33, 0.474, 20
SIMILAR_PCT, NULL_PERCENTILE = 60.0, 0.90
GOOD_RATIO, FAIR_RATIO, MIN_OWN = 1.5, 2.0, 25


def viability_limits(test_size: float = 0.2, outer: int = 5, inner: int = 5, contamination: float = 0.02) -> dict[str, int]:
    """Rows needed per zone after the split, nested folds and outlier removal."""
    rf = (1 - test_size) * (outer - 1) / outer * (inner - 1) / inner * (1 - contamination)
    return {"conservative": math.ceil(40 / rf), "moderate": math.ceil(80 / rf), "robust": math.ceil(320 / rf)}


def viability(n: Column, limits: dict[str, int] | None = None) -> Column:
    t = limits or viability_limits()
    return F.when(n >= t["robust"], "robusto").when(n >= t["moderate"], "basico").when(n >= t["conservative"], "minimo").otherwise("insuficiente")


def pairwise_groups(df: DataFrame, anchors: Sequence[str], key: str = VARIETY) -> DataFrame:
    """Every non-anchor variety with every anchor; the anchor list is a short literal."""
    names = F.array(*[F.lit(a) for a in anchors])
    return df.select(key).where(~F.col(key).isin(list(anchors)) & F.col(key).isNotNull()).distinct().withColumn("anchor", F.explode(names))


def pair_sums(df: DataFrame, features: Sequence[str], anchors: Sequence[str], key: str = VARIETY) -> DataFrame:
    """(key, anchor, variable, n_a, n_b, w1, _r, _ties): what every statistic of a pair is made of.

    Values are counted per variety, which reads ``df`` once, and lie in order on one axis a
    feature, cut into slices. What each variety has before a slice comes from the slices'
    totals, so a slice is walked by itself for all pairs: a variety's counts are neither copied
    to the anchors nor an anchor's to the varieties. Nulls and NaN are left out.
    """
    anchors = list(anchors)
    every = cut(melt(df, [key], features, drop_null=False).groupBy(key, "variable", "value").agg(F.count(F.lit(1)).alias("w")).where(F.col(key).isNotNull()))
    counts = every.where(F.col("value").isNotNull() & ~F.isnan("value"))
    # Equal values of all varieties are in one slice.
    parts = sliced(counts, ["variable"], [F.col("value")])
    kind = every.schema[key].dataType.simpleString()
    totals = cut(parts.groupBy("variable", "_slice", key).agg(F.sum("w").alias("_w"), F.min("value").alias("_first")))
    # A row a slice and variety from here on, whether or not it has values there.
    edges = totals.groupBy("variable", "_slice").agg(F.min("_first").alias("_first"))
    edges = edges.withColumn("_end", F.lead("_first").over(Window.partitionBy("variable").orderBy("_slice")))
    full = attach(edges.join(every.select("variable", key).distinct(), "variable"), totals.select("variable", "_slice", key, "_w"), ["variable", "_slice", key])
    whole = Window.partitionBy("variable", key)
    before = F.coalesce(F.sum("_w").over(whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = full.select("variable", "_slice", "_first", "_end", key, before.alias("_before"), F.coalesce(F.sum("_w").over(whole), F.lit(0)).alias("_total"))

    def walk(data: pa.Table, mark: pa.Table) -> pa.Table:
        schema = pa.schema([(key, mark.schema.field(key).type), ("anchor", pa.string()), ("variable", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("_part", pa.float64()), ("_r", pa.float64()), ("_ties", pa.float64())])
        names = mark[key].to_pylist()
        base, total = ({n: int(v) for n, v in zip(names, mark[c].to_pylist(), strict=True)} for c in ("_before", "_total"))
        first, end = mark["_first"][0].as_py(), mark["_end"][0].as_py()
        coded = data[key].combine_chunks().dictionary_encode()
        code, x, w = coded.indices.to_numpy(), data["value"].to_numpy(), data["w"].to_numpy()
        order = np.lexsort((x, code))
        x, w = x[order], w[order]
        bounds = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        span = {n: slice(bounds[i], bounds[i + 1]) for i, n in enumerate(coded.dictionary.to_pylist())}
        none = slice(0, 0)
        donors = np.unique(np.concatenate([x[span.get(a, none)] for a in anchors]))
        cube = lambda t: t * t * t - t
        side = []  # of each anchor: its values, running counts from before the slice, ties by itself
        for a in anchors:
            wa = w[span.get(a, none)]
            side.append((x[span.get(a, none)], np.append(0, np.cumsum(wa)) + base.get(a, 0), wa, cube(wa.astype(float)).sum()))
        out = []
        for n in names:
            if n in anchors:
                continue
            xs, ws = x[span.get(n, none)], w[span.get(n, none)]
            run = np.append(0, np.cumsum(ws)) + base[n]
            axis = np.union1d(np.union1d(xs, donors), [first])
            step = np.diff(axis, append=axis[-1] if end is None else end)
            mine = run[np.searchsorted(xs, axis, "right")]
            for a, (xa, runs, wa, alone) in zip(anchors, side, strict=True):
                n_a, n_b = total[n], total.get(a, 0)
                if not (n_a or n_b):
                    continue
                area = float(np.abs(mine / n_a - runs[np.searchsorted(xa, axis, "right")] / n_b) @ step) if n_a and n_b else 0.0
                low, high = np.searchsorted(xa, xs, "left"), np.searchsorted(xa, xs, "right")
                same = np.where(high > low, wa[np.minimum(low, len(wa) - 1)], 0) if len(wa) else np.zeros(len(xs), np.int64)
                t = (ws + same).astype(float)
                ranks = run[1:] + runs[high] - (t - 1) / 2.0
                out.append((n, a, n_a, n_b, area, float(ws @ ranks), float(cube(t).sum() - cube(same.astype(float)).sum() + alone)))
        if not out:
            return schema.empty_table()
        cols = list(zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((*cols[:2], [mark["variable"][0].as_py()] * len(out), *cols[2:]), schema, strict=True)], schema=schema)

    schema = f"`{key}` {kind}, anchor string, variable string, n_a bigint, n_b bigint, _part double, _r double, _ties double"
    walked = parts.groupBy("variable", "_slice").cogroup(marks.groupBy("variable", "_slice")).applyInArrow(walk, schema)
    return cut(walked.groupBy(key, "anchor", "variable").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum("_part").alias("w1"), F.sum("_r").alias("_r"), F.sum("_ties").alias("_ties")))


def pair_distances(df: DataFrame, features: Sequence[str], anchors: Sequence[str], key: str = VARIETY, sums: DataFrame | None = None) -> DataFrame:
    """Per pair: mean W1, max and mean |Cliff's delta|."""
    keys = [key, "anchor", "variable"]
    sums = pair_sums(df, features, anchors, key) if sums is None else sums
    delta = mann_whitney_of(sums, keys).select(*keys, "delta")
    return attach(sums.where((F.col("n_a") > 0) & (F.col("n_b") > 0)), delta, keys).groupBy(key, "anchor").agg(
        F.avg("w1").alias("w1"), F.max(F.abs("delta")).alias("max_cliff"), F.avg(F.abs("delta")).alias("mean_cliff")
    )


def assign_to_anchor(distances: DataFrame, by: str = "effect", key: str = VARIETY) -> DataFrame:
    """Nearest anchor by max |delta| then W1 (or by W1 alone), with the second choice."""
    order = [F.asc("max_cliff"), F.asc("w1"), F.asc("anchor")] if by == "effect" else [F.asc("w1"), F.asc("anchor")]
    # One row per anchor in each variety.
    ranked = distances.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.groupBy(key).agg(
        *[F.max(F.when(F.col("_r") == i, F.col(c))).alias(n) for i, c, n in (
            (1, "anchor", "anchor"), (1, "w1", "w1"), (1, "max_cliff", "max_cliff"), (1, "mean_cliff", "mean_cliff"), (2, "anchor", "second"), (2, "w1", "w1_second"))]
    )


def mann_whitney_pairs(df: DataFrame, features: Sequence[str], anchors: Sequence[str], key: str = VARIETY, sums: DataFrame | None = None) -> DataFrame:
    sums = pair_sums(df, features, anchors, key) if sums is None else sums
    return mann_whitney_of(sums, [key, "anchor", "variable"])


def validate_mann_whitney(tests: DataFrame, assigned: DataFrame, key: str = VARIETY, alpha: float = 0.05) -> DataFrame:
    """Share of features that do not differ between a variety and its anchor."""
    own = tests.join(assigned.select(key, "anchor"), [key, "anchor"], "left_semi").where(F.col("p").isNotNull())
    out = own.groupBy(key, "anchor").agg(F.count_if(F.col("p") > alpha).alias("n_similar"), F.count(F.lit(1)).alias("n_total"))
    pct = F.col("n_similar") * 100.0 / F.col("n_total")
    return out.withColumn("pct_similar", pct).withColumn("ok", F.col("pct_similar") >= SIMILAR_PCT)


def mann_whitney_holm(tests: DataFrame, assigned: DataFrame, key: str = VARIETY, alpha: float = 0.05, null_q: float = NULL_PERCENTILE) -> DataFrame:
    """Holm-corrected similarity of each assignment, and the threshold from unassigned pairs."""
    judged = holm(tests.where(F.col("p").isNotNull()), "p", [key, "anchor"], alpha, ["variable"])
    pct = judged.groupBy(key, "anchor").agg((F.count_if(~F.col("rejected")) * 100.0 / F.count(F.lit(1))).alias("pct_similar_holm"), F.count(F.lit(1)).alias("n_valid"))
    mine = assigned.select(key, F.col("anchor"), F.lit(True).alias("_mine"))
    marked = attach(pct, mine, [key, "anchor"])
    limit = marked.where(F.col("_mine").isNull()).agg(F.coalesce(F.percentile("pct_similar_holm", F.lit(null_q)), F.lit(SIMILAR_PCT)).alias("threshold"))
    return attach(marked.where("_mine").drop("_mine"), limit)


def validate_effect_size(assigned: DataFrame, sizes: DataFrame, key: str = VARIETY, least: int = MIN_VALIDATE) -> DataFrame:
    """similar < .33, moderado < .474, diferente; too few rows are insufficient."""
    out = attach(assigned, sizes, [key])
    few = F.col("n") < least
    verdict = F.when(few, "insuficiente").when(F.col("max_cliff") < EFFECT_SMALL, "similar").when(F.col("max_cliff") < EFFECT_MEDIUM, "moderado").otherwise("diferente")
    return out.select(key, "anchor", "n", *[F.when(~few, F.col(c)).alias(c) for c in ("max_cliff", "mean_cliff")], verdict.alias("verdict"))


def bootstrap_distances(df: DataFrame, features: Sequence[str], anchors: Sequence[str], key: str = VARIETY, replicates: int = 100, seed: int = 42, row_id: str = ROW_ID) -> DataFrame:
    """(key, _rep, anchor, _w1): mean W1 over the features between each resample and each anchor.

    A row has one Poisson(1) weight a replicate for all its features, drawn from its hash, which
    is what travels; only where a task meets many equal values of a variety does it add their
    weights up first. Values lie in order on one axis a feature, cut into slices. Slice totals
    say where each variety begins, so every slice is walked by itself, for all varieties and
    replicates. Values are exact: nothing is snapped or capped. Nulls and NaN are left out.
    """
    anchors, features = list(anchors), list(features)
    is_anchor = F.col(key).isin(anchors)
    hashes = [F.when(~is_anchor, hash_bucket(F.col(row_id), s)).alias(n) for s, n in ((seed, "_hx"), (seed + 1, "_hy"))]
    rows = df.where(F.col(key).isNotNull()).select(key, is_anchor.alias("_a"), *hashes, *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)])
    kind = rows.schema[key].dataType.simpleString()
    columns = ["variable", key, "x", "h", "c", "w"]

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PACKED_ROWS:
                yield from packed(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, size = [], 0
        if size:
            yield from packed(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def packed(b):
        names = b.column(0).dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        donor = b.column(1).to_numpy(zero_copy_only=False)
        hx, hy = (b.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (2, 3))
        h = (hx << 32) | hy
        for i, name in enumerate(features):
            x = b.column(4 + i).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(~np.isnan(x))
            if not len(at):
                continue
            at = at[np.lexsort((x[at], code[at]))]
            first = np.flatnonzero(np.append(True, (x[at][1:] != x[at][:-1]) | (code[at][1:] != code[at][:-1])))
            times = np.diff(first, append=len(at))
            own = ~donor[at[first]].astype(bool)
            many = own & (times >= PACKED_LEAST)
            # Anchors' values are counted, equal values of a variety added up, others go as they are.
            single = np.repeat(own & ~many, times)
            kept = at[single]
            sums = [replicate_weights(hx[at[f : f + n]], hy[at[f : f + n]], replicates).sum(axis=0).astype(np.int32).tobytes() for f, n in zip(first[many], times[many], strict=True)]
            picks = np.concatenate([at[first[~own]], at[first[many]], kept])
            n_donor, n_many = int((~own).sum()), int(many.sum())
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * len(picks), pa.string()), names.dictionary.take(pa.array(code[picks])), pa.array(x[picks]), pa.array(h[picks]),
                pa.array(np.append(times[~own], np.zeros(len(picks) - n_donor, np.int64)).astype(np.int64)),
                pa.array([None] * n_donor + sums + [None] * (len(picks) - n_donor - n_many), pa.binary()),
            ], names=columns)

    def weights(h, w, start, end):
        out = replicate_weights((h[start:end] >> 32) & 0xFFFFFFFF, h[start:end] & 0xFFFFFFFF, replicates)
        for i in np.flatnonzero(w[start:end].is_valid().to_numpy(zero_copy_only=False)):
            out[i] = np.frombuffer(w[start + int(i)].as_buffer(), np.int32)
        return out

    schema = f"variable string, `{key}` {kind}, x double, h bigint, c bigint, w binary"
    # Equal values of all varieties are in one slice.
    parts = sliced(cut(rows.mapInArrow(pack, schema)), ["variable"], [F.col("x")])

    def add(batches):
        total: dict = {}
        for b in batches:
            labels = [b.column(i).dictionary_encode() for i in (0, 1)]
            codes = [c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in labels]
            where = b.column(6).to_numpy(zero_copy_only=False).astype(np.int64)
            label = (where * len(labels[0].dictionary) + codes[0]) * len(labels[1].dictionary) + codes[1]
            order = np.argsort(label, kind="stable")
            ends = np.flatnonzero(np.append(label[order][1:] != label[order][:-1], True)) + 1
            x, h, c, w = (b.column(i).to_numpy(zero_copy_only=False) if i < 5 else b.column(i) for i in (2, 3, 4, 5))
            for start, end in zip(np.append(0, ends[:-1]), ends, strict=True):
                at = order[start:end]
                name, group = (labels[i].dictionary[int(codes[i][at[0]])].as_py() for i in (0, 1))
                own = np.array([c[at].sum()], float) if c[at[0]] else sum(weights(h[at[s : s + 4096]], w.take(pa.array(at[s : s + 4096])), 0, 4096).sum(axis=0) for s in range(0, len(at), 4096))
                place = (name, int(where[at[0]]), group)
                low, before = total.get(place, (np.inf, 0.0))
                total[place] = (min(low, float(x[at].min())), before + own)
        if total:
            names, slices, groups = zip(*total, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(slices, pa.int32()), pa.array(groups, key_type), pa.array([v[0] for v in total.values()]), pa.array([v[1].tolist() for v in total.values()], pa.list_(pa.float64()))], names=["variable", "_slice", key, "_first", "t"])

    key_type = to_arrow_type(rows.schema[key].dataType)
    totals = cut(parts.select(*columns, "_slice").mapInArrow(add, f"variable string, _slice int, `{key}` {kind}, _first double, t array<double>"))
    # A row a slice and variety from here on, whether or not it has values there.
    edges = totals.groupBy("variable", "_slice").agg(F.min("_first").alias("_first"))
    edges = edges.withColumn("_end", F.lead("_first").over(Window.partitionBy("variable").orderBy("_slice")))
    everywhere = edges.join(totals.select("variable", key).distinct(), "variable")
    full = everywhere.join(totals.select("variable", "_slice", key, "t"), ["variable", "_slice", key], "left")

    def begin(t: pa.Table) -> pa.Table:
        """What a variety has before each slice, and in all."""
        t = t.sort_by("_slice")
        width = 1 if t[key][0].as_py() in anchors else replicates
        before, total = [], np.zeros(width)
        for v in t["t"]:
            before.append(total.tolist())
            if v.is_valid:  # tasks that shared a slice have a row each
                total = total + np.array(v.as_py())
        slices = t["_slice"].to_pylist()
        first = [i for i in range(len(slices)) if i == 0 or slices[i] != slices[i - 1]]
        out = t.select(["variable", "_slice", key, "_first", "_end"]).take(pa.array(first))
        return out.append_column("before", pa.array([before[i] for i in first], pa.list_(pa.float64()))).append_column("total", pa.array([total.tolist()] * len(first), pa.list_(pa.float64())))

    marks = full.groupBy("variable", key).applyInArrow(begin, f"variable string, _slice int, `{key}` {kind}, _first double, _end double, before array<double>, total array<double>")

    def walk(data: pa.Table, mark: pa.Table) -> pa.Table:
        names = mark[key].to_pylist()
        before, total = ({n: np.array(v) for n, v in zip(names, mark[c].to_pylist(), strict=True)} for c in ("before", "total"))
        first, end = mark["_first"][0].as_py(), mark["_end"][0].as_py()
        coded = data[key].combine_chunks().dictionary_encode()
        code, x, h, c = coded.indices.to_numpy(), data["x"].to_numpy(), data["h"].to_numpy(), data["c"].to_numpy()
        order = np.lexsort((x, code))
        x, h, c, w = x[order], h[order], c[order], data["w"].combine_chunks().take(pa.array(order))
        bounds = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        span = {n: slice(int(bounds[i]), int(bounds[i + 1])) for i, n in enumerate(coded.dictionary.to_pylist())}
        none = slice(0, 0)
        here = [a for a in anchors if a in total]
        donors = np.unique(np.concatenate([[first], *[x[span.get(a, none)] for a in here]]))
        shares = [(before[a][0] + np.append(0, np.cumsum(c[span.get(a, none)])))[np.searchsorted(x[span.get(a, none)], donors, side="right")] / total[a][0] for a in here]
        found = []
        for n in names:
            if n in anchors or not here:
                continue
            own = span.get(n, none)
            # Both in order; equal places are a step of length 0 apart.
            axis = np.concatenate([donors, x[own]])
            merged = np.argsort(axis, kind="stable")
            axis = axis[merged]
            step = np.diff(axis, append=axis[-1] if end is None else end)
            place = np.searchsorted(donors, axis, side="right") - 1
            all_ = total[n]
            run, area, done = before[n], np.zeros((replicates, len(here))), 0
            for start in range(0, len(axis), 4096):
                is_own = merged[start : start + 4096] >= len(donors)
                more = np.zeros((len(is_own), replicates))
                upto = done + int(is_own.sum())
                if upto > done:
                    more[is_own] = weights(h[own], w.slice(own.start, own.stop - own.start), done, upto)
                runs = run + np.cumsum(more, axis=0)
                run, done = runs[-1], upto
                share = runs / np.maximum(all_, 1)
                for j, of_anchor in enumerate(shares):
                    area[:, j] += step[start : start + 4096] @ np.abs(share - of_anchor[place[start : start + 4096], None])
            r, a = np.nonzero(np.broadcast_to((all_ > 0)[:, None], area.shape))
            found.append(pa.table({key: pa.array([n] * len(r), key_type), "variable": pa.array([mark["variable"][0].as_py()] * len(r), pa.string()), "_rep": pa.array(r.astype(np.int32) + 1), "anchor": pa.array([here[j] for j in a], pa.string()), "_part": pa.array(area[r, a])}))
        empty = pa.table({key: pa.array([], key_type), "variable": pa.array([], pa.string()), "_rep": pa.array([], pa.int32()), "anchor": pa.array([], pa.string()), "_part": pa.array([], pa.float64())})
        return pa.concat_tables(found) if found else empty

    pieces = parts.groupBy("variable", "_slice").cogroup(marks.groupBy("variable", "_slice")).applyInArrow(walk, f"`{key}` {kind}, variable string, _rep int, anchor string, _part double")
    each = pieces.groupBy(key, "variable", "_rep", "anchor").agg(F.sum("_part").alias("_w1"))
    return each.groupBy(key, "_rep", "anchor").agg(F.avg("_w1").alias("_w1"))


# Rows that a task looks at together for equal values, and how many of them are added up.
PACKED_ROWS, PACKED_LEAST = 1 << 18, 8


def bootstrap_stability(df: DataFrame, assigned: DataFrame, features: Sequence[str], anchors: Sequence[str], key: str = VARIETY, replicates: int = 100, seed: int = 42, alpha: float = 0.05, row_id: str = ROW_ID) -> DataFrame:
    """Share of resamples whose nearest anchor (by W1) is the assigned one, tested against chance."""
    dist = bootstrap_distances(df, features, anchors, key, replicates, seed, row_id)
    nearest = dist.groupBy(key, "_rep").agg(F.min_by("anchor", F.struct("_w1", "anchor")).alias("_near"))
    votes = nearest.groupBy(key, "_near").agg(F.count(F.lit(1)).alias("_c"))
    mine = assigned.select(key, F.col("anchor").alias("_mine"))
    tally = attach(votes, mine, [key])
    hit = F.col("_near") == F.col("_mine")
    out = tally.groupBy(key).agg(
        F.max("_mine").alias("anchor"), F.coalesce(F.sum(F.when(hit, F.col("_c"))), F.lit(0)).alias("_hits"),
        F.max_by("_near", F.when(~hit, F.struct("_c", "_near"))).alias("top_alternative"), F.coalesce(F.max(F.when(~hit, F.col("_c"))), F.lit(0)).alias("_alt"),
    )
    out = out.withColumn("p", binomial_tail(F.col("_hits").cast("double"), F.lit(float(replicates)), F.lit(1.0 / len(anchors))))
    out = holm(out, "p", (), alpha, [key], "significant")
    return out.select(key, "anchor", (F.col("_hits") * 100.0 / replicates).alias("stability_pct"), "top_alternative", (F.col("_alt") * 100.0 / replicates).alias("top_alt_pct"), "p", "significant")


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip").transform(df)


def silhouette(df: DataFrame, label: str, features: Sequence[str]) -> float:
    """Silhouette of a labelling over all rows (squared Euclidean, one pass per row)."""
    names = df.select(label).distinct()
    ids = names.withColumn("_label", F.row_number().over(Window.orderBy(label)).cast("double"))  # a row per label
    return ClusteringEvaluator(featuresCol="_v", predictionCol="_label").evaluate(_vectors(attach(df, ids, [label]), features))


def centroids(df: DataFrame, features: Sequence[str], key: str = VARIETY) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(f).alias(f) for f in features])


def centroid_silhouette(cents: DataFrame, features: Sequence[str], label: str, key: str = VARIETY) -> DataFrame:
    """Euclidean silhouette of the centroids, groups with two or more of them.

    The centroid table has one row per variety, so all of it fits one array.
    """
    point = F.struct(F.col(key).alias("k"), F.col(label).alias("g"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    size = cents.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    kept = cents.join(size.select(label), label, "left_semi")
    everyone = kept.agg(F.collect_list(point).alias("all"))
    rows = attach(kept.select(key, label, F.array(*[F.col(f).cast("double") for f in features]).alias("_v")), everyone)
    other = rows.select(key, label, "_v", F.explode("all").alias("_o")).where(F.col(key) != F.col("_o.k"))
    dist = F.sqrt(F.aggregate(F.zip_with("_v", F.col("_o.v"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    mean = other.withColumn("_d", dist).groupBy(key, label, F.col("_o.g").alias("_g")).agg(F.avg("_d").alias("_m"))
    both = mean.groupBy(key, label).agg(F.min(F.when(F.col("_g") == F.col(label), F.col("_m"))).alias("a"), F.min(F.when(F.col("_g") != F.col(label), F.col("_m"))).alias("b"))
    return both.withColumn("silhouette", F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))


def intra_inter_ratio(distances: DataFrame, assigned: DataFrame, key: str = VARIETY) -> DataFrame:
    """Mean W1 to the own anchor over the mean W1 to the others."""
    mine = assigned.select(key, F.col("anchor").alias("_mine"))
    own = F.col("anchor") == F.col("_mine")
    out = attach(distances, mine, [key]).agg(F.avg(F.when(own, F.col("w1"))).alias("mean_intra"), F.avg(F.when(~own, F.col("w1"))).alias("mean_inter"))
    return out.withColumn("ratio", F.try_divide(F.col("mean_intra"), F.col("mean_inter")))


def k_sweep(df: DataFrame, features: Sequence[str], low: int = 3, high: int = 15, seed: int = 42) -> DataFrame:
    """k-means silhouette per k and the best k."""
    data = cut(df.select(*features).dropna())
    vec = _vectors(data, features).select("_v")
    rows = []
    for k in range(low, high + 1):
        model = KMeans(featuresCol="_v", predictionCol="_label", k=k, seed=seed).fit(vec)
        rows.append((k, float(ClusteringEvaluator(featuresCol="_v", predictionCol="_label").evaluate(model.transform(vec)))))
    best = max(rows, key=lambda r: r[1])[0]
    return df.sparkSession.createDataFrame([(k, s, k == best) for k, s in rows], "k int, silhouette double, best boolean")


def routing_decisions(errors: DataFrame, own: DataFrame, anchors: Sequence[str], key: str = VARIETY) -> DataFrame:
    """Donor per variety from prediction errors.

    ``errors`` has one row per variety and anchor model with ``mape`` and ``n``; ``own``
    has the 5-fold error of a variety's own model where it has enough rows. The baseline is
    the mean in-sample error of the anchors.
    """
    is_anchor = F.col(key).isin(list(anchors))
    self_err = errors.where(is_anchor & (F.col(key) == F.col("anchor")))
    base = self_err.agg(F.avg("mape").alias("_base"))
    best = errors.where(~is_anchor).groupBy(key).agg(F.min_by("anchor", F.struct("mape", "anchor")).alias("trains_with"), F.min("mape").alias("mape_oos"), F.max("n").alias("n"))
    best = attach(attach(best, own.select(key, F.col("mape").alias("mape_own")), [key]), base)
    best = best.withColumn("mape_own", F.when(F.col("n") >= MIN_OWN, F.col("mape_own")))
    ratio = F.col("mape_oos") / F.col("_base")
    decision = F.when(ratio <= GOOD_RATIO, "bueno").when(ratio <= FAIR_RATIO, "aceptable").otherwise("revisar")
    routed = best.select(key, "trains_with", "n", "mape_oos", "mape_own", (F.col("mape_own") - F.col("mape_oos")).alias("gain"), ratio.alias("ratio"), decision.alias("decision"))
    kept = self_err.select(key, F.col("anchor").alias("trains_with"), "n", F.col("mape").alias("mape_oos"), F.col("mape").alias("mape_own"), F.lit(0.0).alias("gain"), F.lit(1.0).alias("ratio"), F.lit("ancla").alias("decision"))
    return kept.unionByName(routed)


def final_table(sizes: DataFrame, assigned: DataFrame, validation: DataFrame, anchors: Sequence[str], key: str = VARIETY) -> DataFrame:
    """Anchors with their zone and assigned varieties with their donor."""
    own = sizes.where(F.col(key).isin(list(anchors))).select(key, "n", viability(F.col("n")).alias("zone"), F.col(key).alias("trains_with"), F.lit(0.0).alias("w1"), F.lit(None).cast("double").alias("pct_similar"))
    rest = attach(attach(assigned.select(key, F.col("anchor").alias("trains_with"), "w1"), sizes, [key]), validation.select(key, "pct_similar"), [key])
    return own.unionByName(rest.select(key, "n", F.lit("agrupar").alias("zone"), "trains_with", "w1", F.coalesce("pct_similar", F.lit(0.0)).alias("pct_similar")))


def group_summary(table: DataFrame, key: str = VARIETY) -> DataFrame:
    """Own, assigned and total rows per anchor."""
    own = F.col(key) == F.col("trains_with")
    return table.groupBy(F.col("trains_with").alias("anchor")).agg(
        F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("own_rows"), F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0)).alias("assigned_rows"),
        F.count_if(~own).alias("n_assigned"), F.sum("n").alias("total"),
    )


def routing_kpis(decisions: DataFrame) -> DataFrame:
    """Counts by decision and the mean gain of routed varieties."""
    d = F.col("decision")
    return decisions.agg(
        F.count_if(d == "ancla").alias("n_anchor"), F.count_if(d != "ancla").alias("n_routed"), F.count_if(d != "revisar").alias("n_reliable"),
        F.count_if(d == "revisar").alias("n_review"), F.avg(F.when(d != "ancla", F.col("gain"))).alias("mean_gain"),
    )
