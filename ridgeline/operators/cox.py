"""Cox proportional hazards: risk sets per distinct time, and what a weighted least-squares round needs of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.links import WEIGHT_FLOOR, clamp

#: Buckets of time; a window then runs inside a bucket and bucket totals are added on.
BUCKETS = 64
#: Distinct times up to this many are summed on the driver, by a count of them.
LOCAL_TIMES = 200_000
#: For the concordance: distinct (time, event, score) counts a range should hold, and the most ranges of time or score.
RANGE_CELLS, MOST_RANGES = 100_000, 1000


def _bucketed(times: DataFrame) -> DataFrame:
    cuts = sorted(set(times.approxQuantile("time", [i / BUCKETS for i in range(1, BUCKETS)], 0.001)))
    bucket = F.lit(0)
    for c in cuts:
        bucket = bucket + (F.col("time") > c).cast("int")
    return times.withColumn("_bucket", bucket)


def _running(rows: DataFrame, values: list[str], backwards: bool) -> DataFrame:
    """Running sums of columns over time, from the start or the end, without one task seeing all times."""
    totals = {r["_bucket"]: r for r in rows.groupBy("_bucket").agg(*[F.sum(v).alias(v) for v in values]).collect()}
    order = sorted(totals, reverse=backwards)
    offsets, held = [], dict.fromkeys(values, 0.0)
    for b in order:
        offsets.append((b, *[float(held[v]) for v in values]))
        for v in values:
            held[v] += totals[b][v]
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_bucket int, " + ", ".join(f"_o_{v} double" for v in values)))
    inside = Window.partitionBy("_bucket").orderBy(F.desc("time") if backwards else F.col("time")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(table, "_bucket")
    for v in values:
        out = out.withColumn(f"cum_{v}", F.sum(v).over(inside) + F.col(f"_o_{v}"))
    return out.drop(*[f"_o_{v}" for v in values])


def _tie_sums(risk: np.ndarray, d: np.ndarray, de: np.ndarray, ties: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per time, over its events: sums of 1 / risk, 1 / risk^2 and log risk, the risk shrinking from event to event for efron."""
    if ties != "efron":
        return d / risk, d / risk**2, d * np.log(risk)
    k = d.astype(int)
    rows = np.repeat(np.arange(len(d)), k)
    frac = (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)) / np.maximum(d[rows], 1)
    left = np.maximum(risk[rows] - frac * de[rows], 1e-300)
    return tuple(np.bincount(rows, f(left), len(d)) for f in (lambda x: 1 / x, lambda x: 1 / x**2, np.log))


def _local_sets(df: DataFrame, times, ties: str) -> DataFrame:
    times = times.sort_values("time")
    mass, d, de = (times[c].to_numpy(float) for c in ("mass", "events", "event_risk"))
    risk = np.maximum(np.cumsum(mass[::-1])[::-1], 1e-300)
    h, h2, logs = _tie_sums(risk, d, de, ties)
    rows = np.column_stack([times["time"], d, risk, de, np.cumsum(h), np.cumsum(h2), logs])
    schema = "time double, events double, risk double, event_risk double, hazard double, hazard2 double, log_risk double"
    return F.broadcast(df.sparkSession.createDataFrame(rows.tolist(), schema))


def risk_sets(df: DataFrame, time: str, event: str, eta: Column, ties: str = "breslow") -> DataFrame:
    """One row per distinct time: events, risk (sum of exp(eta) still at risk), event_risk, hazard and hazard2 (sums up to the time), log_risk.

    log_risk is the time's share of the partial likelihood's log terms. Rows collapse to distinct times by a partially aggregated sum first.
    """
    e = F.exp(clamp(eta))
    d = F.col(event).cast("double")
    times = df.select(F.col(time).cast("double").alias("time"), e.alias("_e"), d.alias("_d")).groupBy("time").agg(F.sum("_e").alias("mass"), F.sum("_d").alias("events"), F.sum(F.col("_e") * F.col("_d")).alias("event_risk"))
    few = times.limit(LOCAL_TIMES + 1).toPandas()
    if len(few) <= LOCAL_TIMES:
        return _local_sets(df, few, ties)
    risk = _running(_bucketed(times), ["mass"], backwards=True).withColumnRenamed("cum_mass", "risk").withColumn("risk", F.greatest("risk", F.lit(1e-300)))
    if ties == "efron":
        steps = F.when(F.col("events") > 0, F.sequence(F.lit(0), F.col("events").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        left = lambda i: F.greatest(F.col("risk") - i / F.col("events") * F.col("event_risk"), F.lit(1e-300))
        h = F.aggregate(steps, F.lit(0.0), lambda s, i: s + 1 / left(i))
        h2 = F.aggregate(steps, F.lit(0.0), lambda s, i: s + 1 / (left(i) * left(i)))
        logs = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.log(left(i)))
    else:
        h, h2, logs = F.col("events") / F.col("risk"), F.col("events") / (F.col("risk") * F.col("risk")), F.col("events") * F.log("risk")
    out = _running(risk.withColumn("h", h).withColumn("h2", h2).withColumn("log_risk", logs), ["h", "h2"], backwards=False)
    return out.select("time", "events", "risk", "event_risk", F.col("cum_h").alias("hazard"), F.col("cum_h2").alias("hazard2"), "log_risk")


def surrogate(df: DataFrame, time: str, event: str, eta: Column, ties: str = "breslow") -> DataFrame:
    """df with _eta, _w and _z: the diagonal working weight and response at eta."""
    sets = risk_sets(df, time, event, eta, ties).select(F.col("time").alias("_t"), "hazard", "hazard2")
    rows = df.withColumn("_eta", clamp(eta)).join(sets, F.col(time).cast("double") == F.col("_t"))
    e = F.exp("_eta")
    w = F.greatest(e * F.col("hazard") - e * e * F.col("hazard2"), F.lit(WEIGHT_FLOOR))
    g = e * F.col("hazard") - F.col(event).cast("double")
    return rows.withColumn("_w", w).withColumn("_z", F.col("_eta") - g / F.col("_w")).drop("_t", "hazard", "hazard2")


def loss(df: DataFrame, time: str, event: str, eta: Column, ties: str = "breslow") -> float:
    """Minus the log partial likelihood, divided by the number of rows."""
    n, linear = df.agg(F.count("*"), F.sum(F.col(event).cast("double") * clamp(eta))).first()
    logs = risk_sets(df, time, event, eta, ties).agg(F.sum("log_risk")).first()[0]
    return (logs - linear) / n


def local_surrogate(eta: np.ndarray, time: np.ndarray, event: np.ndarray, ties: str = "breslow") -> tuple[float, np.ndarray, np.ndarray]:
    """(loss sum, weights, responses) for rows on the driver."""
    eta = np.clip(eta, -30, 30)
    e = np.exp(eta)
    distinct, at = np.unique(time, return_inverse=True)
    size = len(distinct)
    mass, d, de = np.bincount(at, e, size), np.bincount(at, event, size), np.bincount(at, e * event, size)
    risk = np.maximum(np.cumsum(mass[::-1])[::-1], 1e-300)
    h, h2, logs = _tie_sums(risk, d, de, ties)
    ch, ch2 = np.cumsum(h)[at], np.cumsum(h2)[at]
    w = np.maximum(e * ch - e * e * ch2, WEIGHT_FLOOR)
    return float(logs.sum() - (event * eta).sum()), w, eta - (e * ch - event) / w


def _repeated(cuts: list[float]) -> list[float]:
    return sorted({c for c, d in zip(cuts, cuts[1:], strict=False) if c == d})


def _place(value: Column, cuts: Column, full: Column) -> Column:
    """The range of a value; a value that fills a range by itself (in full) has one of its own."""
    return F.size(F.filter(cuts, lambda c: c < value)) + F.size(F.filter(full, lambda c: c <= value))


def concordance(df: DataFrame, time: str, event: str, score: str) -> DataFrame:
    """Harrell's c in one row (concordant, ties, pairs, c_index), as of concordances."""
    return concordances(df, time, event, [score]).drop("score_idx")


def concordances(df: DataFrame, time: str, event: str, scores: list[str]) -> DataFrame:
    """Harrell's c of each score column (score_idx, concordant, ties, pairs, c_index): of an event and a strictly later time, the event should score higher.

    Rows collapse to (time, event, score) counts, which are dealt to ranges of time and ranges of score. Pairs in one range of
    time are counted there by ranks, pairs in one range of score there, across times; the others follow from a table of
    counts by both ranges, at most MOST_RANGES squared for all scores together. No pair becomes a row. All scores share the
    passes. A null leaves a row out; without pairs c_index is 0.5.
    """
    each = F.posexplode(F.array(*[F.col(c).cast("double") for c in scores])).alias("k", "s")
    cells = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("d"), each).dropna()
    cells = cells.groupBy("k", "t", "d", "s").agg(F.count("*").cast("double").alias("n")).persist()
    try:
        found = _concordances(cells, len(scores))
    finally:
        cells.unpersist()
    rows = [(k, c, t, p, (c + t / 2) / p if p else 0.5) for k, (c, t, p) in enumerate(found.tolist())]
    return df.sparkSession.createDataFrame(rows, "score_idx int, concordant double, ties double, pairs double, c_index double")


def _concordances(cells: DataFrame, scores: int) -> np.ndarray:
    parts = int(min(MOST_RANGES / np.sqrt(scores), max(1, -(-cells.count() // (scores * RANGE_CELLS))))) or 1
    shares = [i / parts for i in range(1, parts)]
    full = []
    if shares:
        found = cells.groupBy("k").agg(F.percentile_approx("s", shares, 5 * parts).alias("c")).collect()
        own = [(r["k"], sorted(set(r["c"])), _repeated(r["c"])) for r in found]
        cuts = cells.approxQuantile("t", shares, 0.2 / parts)
        full = _repeated(cuts)
        values = lambda xs: F.array(*map(F.lit, xs)).cast("array<double>")
        table = cells.sparkSession.createDataFrame(own, "k int, _cuts array<double>, _full array<double>")
        at = cells.join(F.broadcast(table), "k").withColumn("_s", _place(F.col("s"), F.col("_cuts"), F.col("_full"))).drop("_cuts", "_full")
        at = at.withColumn("_t", _place(F.col("t"), values(sorted(set(cuts))), values(full)))
    else:
        at = cells.withColumn("_t", F.lit(0)).withColumn("_s", F.lit(0))

    def count(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        sums = count_pairs(*(group.column(c).to_numpy() for c in ("t", "d", "s", "n")))
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), **{c: [v] for c, v in zip(("concordant", "ties", "pairs"), sums, strict=True)}})

    schema = "k int, concordant double, ties double, pairs double"
    # A range of one time has no pairs of its own.
    near = at.filter(~F.col("t").isin(full) if full else F.lit(True)).groupBy("k", "_t").applyInArrow(count, schema)
    if shares:
        # Within a range of scores, times matter by their range alone.
        rough = at.groupBy("k", "_s", F.col("_t").cast("double").alias("t"), "d", "s").agg(F.sum("n").alias("n"))
        near = near.unionByName(rough.groupBy("k", "_s").applyInArrow(count, schema))
    out = np.zeros((scores, 3))
    for r in near.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("concordant", "ties", "pairs")]).collect():
        out[r["k"]] = r["concordant"], r["ties"], r["pairs"]
    if shares:
        grid = at.groupBy("k", "_t", "_s").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("d") != 0, F.col("n")).otherwise(0.0)).alias("e")).toPandas()
        for k, g in grid.groupby("k"):
            held = np.zeros((g["_t"].max() + 1, g["_s"].max() + 1))
            events = np.zeros_like(held)
            held[g["_t"], g["_s"]], events[g["_t"], g["_s"]] = g["n"], g["e"]
            later = np.cumsum(held[::-1], axis=0)[::-1] - held
            lower = np.cumsum(later, axis=1) - later
            out[k] += (events * lower).sum(), 0.0, (events * (later.sum(axis=1, keepdims=True) - later)).sum()
    return out


def count_pairs(t: np.ndarray, d: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """(concordant, ties, pairs) of counted rows. All rows are placed from the latest time back, events of a time before its rows;
    one stable split by each bit of the score's rank then counts, for all at once, the rows placed before an event with a smaller rank."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    hit = np.flatnonzero(d != 0)
    when = np.concatenate([t[hit], t])
    is_row = np.concatenate([np.zeros(len(hit), bool), np.ones(len(t), bool)])
    order = np.lexsort((is_row, -when))
    rank = np.concatenate([rank[hit], rank])[order]
    asks = np.concatenate([n[hit], np.zeros(len(t))])[order]
    holds = np.concatenate([np.zeros(len(hit)), n])[order]
    pairs = float(asks @ np.cumsum(holds))

    def placed_before(high: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in order of (high, place), and for each the sum of held placed before it among those with its value of high."""
        block = np.argsort(high, kind="stable")
        total = np.concatenate([[0.0], np.cumsum(held[block])])
        starts = np.flatnonzero(np.diff(high[block], prepend=-1))
        return block, total[:-1] - np.repeat(total[starts], np.diff(np.append(starts, len(block))))

    block, same = placed_before(rank, holds)
    ties = float(asks[block] @ same)
    concordant = 0.0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        # Ranks that agree above this bit: those with the bit are greater than those without.
        one = (rank >> bit) & 1
        block, low = placed_before(rank >> (bit + 1), np.where(one == 1, 0.0, holds))
        concordant += float((asks * one)[block] @ low)
    return concordant, ties, pairs
