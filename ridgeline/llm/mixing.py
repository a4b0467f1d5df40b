"""Mixing sources to target weights by entropy balancing; rates are rounded into whole copies."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import by_partition, materialize, read_table, ship, split_hot_join

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_COPIES = 2
TOLERANCE = 1e-10
MAX_STEPS = 60
#: Rates are whole numbers of 1 / UNIT, so running sums are exact and the same in any order of tasks.
UNIT = 1_000_000
#: Places where a source's running sum may start; the one that comes nearest to the target is taken.
OFFSETS = 32
#: A document with more than this share of its source's words is rounded before the others.
LARGE_SHARE = 0.01
#: Multiplier of a source that gives nothing.
NO_COPIES = -700.0

_WORD = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    """Number of words: a word starts where a character other than white space follows white space or the start."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_COPIES) -> DataFrame:
    """sources (source, source_size, ...) with source_no and target.

    target: words a source should give, `share` of all words by weight, at most `most` times its own; the excess is shared again by weight
    among the others until none is above. Weights repeat along the sources in code point order, null last, which is also their number.
    The order is a range sort; the level of the others rises by one aggregate a round until no more sources meet their cap.
    """
    spark = sources.sparkSession
    place = [F.col("source").isNull(), F.col("source")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sources.schema) + ", units long, part int, before long"
    ordered = materialize(sources.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("units", F.lit(1).cast("long")).mapInArrow(_running, schema), "sources")
    starts = by_partition(spark, _offsets([(r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()]), "part int, part_first long")
    numbered = ordered.join(starts, "part").withColumn("source_no", F.col("part_first") + F.col("before")).drop("units", "part", "before", "part_first")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("source_no", F.lit(len(weights))).cast("int"))
    numbered = materialize(numbered.withColumn("weight", weight), "numbered_sources")
    cap = float(most) * F.col("source_size")
    total, level, capped = None, 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > cap
        r = numbered.agg(F.sum("source_size").alias("all"), F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, cap)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        total = float(r["all"] or 0) * share
        if r["n"] == capped or not r["free"]:
            break
        capped, level = r["n"], max(total - (r["held"] or 0.0), 0.0) / r["free"]
    return numbered.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)) if r["free"] else cap).drop("weight")


def _joined(rows: DataFrame, per_source: DataFrame, n_rows: int) -> DataFrame:
    """rows with the columns of a table that has one row per source_no and the source's rows in `docs`."""
    return split_hot_join(rows, per_source, ["source_no"], "docs", n_rows).drop("docs")


def balance(cells: DataFrame, goals: DataFrame, *, n_rows: int, most: float = MAX_COPIES) -> DataFrame:
    """goals (source_no, goal, docs) with `multiplier`, the entropy-balancing dual of each source.

    Among all document rates r in [0, most] with sum(size * r) at each source's goal, the one closest in
    relative entropy (in words) to the base rates b is r = min(most, b * exp(multiplier)). The convex dual is
    maximised by Newton steps, all sources at a time; gradient and curvature are sums over cells (source_no, size, base, cell_docs). A step
    that leaves the interval known to hold the answer is replaced by its middle. The state, one row per source, is a table of the shared
    folder. A source that no multiplier brings to its goal (no words, or all at `most`) keeps its last finite one.
    """
    at, low, high = F.col("multiplier"), F.col("low"), F.col("high")
    raw, mass = F.col("base") * F.exp("multiplier"), F.col("size") * F.col("cell_docs")
    state = goals.select("source_no", "goal", "docs", F.lit(0.0).alias("multiplier"), F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), F.lit(True).alias("moved"))
    for _ in range(MAX_STEPS):
        now = _joined(cells, state.filter("moved").select("source_no", "multiplier", "docs"), n_rows)
        sums = now.groupBy("source_no").agg(F.sum(mass * F.least(raw, F.lit(float(most)))).alias("reached"), F.sum(F.when(raw < most, mass * raw).otherwise(0.0)).alias("curve"))
        met = state.join(sums, "source_no", "left").withColumn("gap", F.col("goal") - F.col("reached"))
        open_ = (F.abs("gap") > TOLERANCE * F.greatest(F.col("goal"), F.lit(1.0))) & (F.col("reached") != 0)
        met = met.withColumn("moved", F.coalesce(open_, F.lit(False)))
        met = met.withColumn("low", F.when(F.col("moved") & (F.col("gap") > 0), at).otherwise(low)).withColumn("high", F.when(F.col("moved") & (F.col("gap") <= 0), at).otherwise(high))
        newton = at + F.col("gap") / F.nullif(F.col("curve"), F.lit(0.0))
        bounded = (low > -math.inf) & (high < math.inf)
        middle = F.when(bounded, (low + high) / 2).otherwise(at + F.signum("gap"))
        new = F.when((low < newton) & (newton < high), newton).otherwise(middle)
        new = F.when(F.col("goal") <= 0, NO_COPIES).otherwise(new)
        state = materialize(met.select("source_no", "goal", "docs", F.when(F.col("moved"), new).otherwise(at).alias("multiplier"), "low", "high", (F.col("moved") & (F.col("goal") > 0)).alias("moved")), "multipliers")
        if state.filter("moved").isEmpty():
            break
    return state.select("source_no", "goal", "docs", "multiplier")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and the sum of units before each row in it."""
    part, held = TaskContext.get().partitionId(), 0
    for batch in batches:
        ends = held + np.cumsum(batch.column("units").to_numpy())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(ends - batch.column("units").to_numpy())], names=[*batch.schema.names, "part", "before"])
        held = int(ends[-1]) if len(ends) else held


def _offsets(totals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(number, sum of what comes before) of (number, sum)."""
    out, before = [], 0
    for k, n in sorted(totals):
        out.append((k, before))
        before += n
    return out


def _round(docs: DataFrame, rates: DataFrame, n_rows: int, most: int) -> DataFrame:
    """docs (source_no, size, base, doc_id, ...) with rate, copies and taken.

    Copies are the steps of the running sum of rates, rounded down, along each source's documents by size.
    rates: source_no, multiplier, docs, and in lo and hi the least and the most words a source should give; of OFFSETS starts of the running
    sum each takes the one that misses this least, then the one nearest to the middle. The order is a range sort by (source, size, hash of
    doc_id, doc_id), which a hot source doesn't unbalance; running sums are per-partition sums plus offsets.
    """
    spark = docs.sparkSession
    tilts = rates.select("source_no", F.exp("multiplier").alias("tilt"), "docs")
    units = F.round(F.least(F.lit(float(most)), F.col("base") * F.col("tilt")) * UNIT).cast("long")
    keys = ["source_no", "size", "_hash", "doc_id"]
    ranged = _joined(docs, tilts, n_rows).withColumn("units", units).withColumn("_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ordered = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_hash", "tilt", "base")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema) + ", part int, before long"
    placed = materialize(ordered.mapInArrow(_running, schema), "places")
    parts = placed.groupBy("part").agg(F.sum("units").alias("n")).collect()
    starts = by_partition(spark, _offsets([(r["part"], r["n"]) for r in parts]), "part int, part_first long")
    placed = placed.join(starts, "part").withColumn("_place", F.col("part_first") + F.col("before"))
    firsts = materialize(placed.groupBy("source_no").agg(F.min("_place").alias("_first"), F.count("*").alias("docs")), "source_places")
    near = _joined(placed, firsts, n_rows).withColumn("_start", F.col("_place") - F.col("_first"))

    def copies(offset: Column) -> Column:
        low = F.col("_start") + offset
        return F.floor((low + F.col("units")) / UNIT) - F.floor(low / UNIT)

    tried = [(2 * k + 1) * UNIT // (2 * OFFSETS) for k in range(OFFSETS)]
    taken = near.groupBy("source_no").agg(F.count("*").alias("_docs"), *[F.sum(copies(F.lit(o)) * F.col("size")).alias(f"_t{o}") for o in tried])
    taken = taken.join(rates.select("source_no", F.floor(F.col("lo") + 0.2837).cast("double").alias("_lo"), F.floor(F.col("hi") + 0.2837).cast("double").alias("_hi")), "source_no")

    def miss(t: Column) -> Column:
        return F.greatest(F.lit(0.0), F.col("_lo") - t, t - F.col("_hi"))

    best = F.array_min(F.array(*[F.struct(miss(F.col(f"_t{o}")).alias("miss"), F.abs(2 * F.col(f"_t{o}") - F.col("_lo") - F.col("_hi")).alias("off"), F.lit(o).alias("offset")) for o in tried]))
    chosen = materialize(taken.select("source_no", best["offset"].alias("_offset"), F.col("_docs").alias("docs")), "source_offsets")
    made = _joined(near, chosen, n_rows).withColumn("copies", copies(F.col("_offset")).cast("int"))
    return made.withColumn("rate", F.col("units") / UNIT).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_COPIES, text: str = "text", doc_id: str = "doc_id", source: str = "source", base: str | None = None, row: str | None = None) -> DataFrame:
    """One row per row of docs: (doc_id, source, size, source_size, target, rate, copies, taken) and the column `row`, if given.

    Sizes are counted once and written to the shared folder. Rates come from `balance` over cells of equal source,
    size and base, and `_round` makes copies of them. Documents with over LARGE_SHARE of their source's words, of which
    there are few, are rounded first; the rest is balanced again to what they leave of the target. So a source's words
    stay within about LARGE_SHARE of the target where copies can reach it. Sources may be as many as rows: what is known of them is a table,
    whose hot rows alone are broadcast. Equal input gives equal output; rows alike in source, size and doc_id are interchangeable.

    Null text has size 0 and takes no words; a null source is one source, last in order; null doc_ids and repeated
    rows are documents of their own; an empty table gives no row. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    carried = [] if row is None else [row]
    sized = materialize(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), text_size(F.col(text).cast("string")).alias("size"), (F.lit(1.0) if base is None else F.col(base).cast("double")).alias("base"), *carried),
        "sizes",
    )
    n = sized.count()
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, share, most)
    sources = materialize(sources, "source_targets")
    known = materialize(split_hot_join(sized, sources.select("source", "source_no", "source_size", "target", "docs"), ["source"], "docs", n).drop("docs"), "sourced")
    is_large = F.col("size") > F.col("source_size") * LARGE_SHARE
    cells = materialize(known.groupBy("source_no", "size", "base", is_large.alias("large")).agg(F.count("*").alias("cell_docs")), "cells")
    columns = ["doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken", *carried]
    few, many = cells.filter("large"), cells.filter("not large")
    small = many.groupBy("source_no").agg((float(most) * F.sum(F.col("size") * F.col("cell_docs"))).alias("small_most"))
    goals = sources.join(small, "source_no", "left").select("source_no", "docs", F.col("target").alias("goal"), F.coalesce("small_most", F.lit(0.0)).alias("small_most"))
    goals = materialize(goals, "goals")
    out = None
    if not few.isEmpty():
        tilts = balance(cells, goals, n_rows=n, most=most).join(goals.select("source_no", "small_most"), "source_no")
        out = materialize(_round(known.filter(is_large), tilts.withColumn("lo", F.col("goal") - F.col("small_most")).withColumn("hi", F.col("goal")), n, most).select("source_no", *columns), "large_documents")
        held = out.groupBy("source_no").agg(F.sum("taken").alias("held"))
        rest = F.least(F.greatest(F.col("goal") - F.col("held"), F.lit(0.0)), F.col("small_most"))
        goals = materialize(goals.join(held, "source_no", "left").withColumn("goal", F.when(F.col("held").isNull(), F.col("goal")).otherwise(rest)), "goals_left")
    tilts = balance(many, goals, n_rows=n, most=most)
    made = _round(known.filter(~is_large), tilts.withColumn("lo", F.col("goal")).withColumn("hi", F.col("goal")), n, most).select(*columns)
    return made if out is None else made.unionByName(out.select(*columns))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The rates have a closed form without base rates; the rest repeats the rounding.
_ROUNDED = """
{name}_units AS (SELECT *, round(least({most}, CASE WHEN source_size = 0 THEN 1.0 ELSE goal / part_size END) * {unit})::BIGINT AS units FROM {rows}),
{name}_run AS (SELECT *, sum(units) OVER (PARTITION BY source_no ORDER BY size, md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT - units AS before FROM {name}_units),
{name}_tried AS (SELECT source_no, o, lo, hi, sum(((before + o + units) // {unit} - (before + o) // {unit}) * size) AS t
  FROM {name}_run, (SELECT ((2 * k + 1) * {unit}) // (2 * {offsets}) AS o FROM range({offsets}) r(k)) GROUP BY ALL),
{name}_best AS (SELECT source_no, arg_min(o, (greatest(0, lo - t, t - hi), abs(2 * t - lo - hi), o)) AS o FROM {name}_tried GROUP BY source_no),
{name} AS (SELECT doc_id, source_no, size, source_size, target, (((before + o + units) // {unit} - (before + o) // {unit}) * size)::BIGINT AS taken FROM {name}_run JOIN {name}_best USING (source_no))"""


def _rounded(name: str, rows: str) -> str:
    return _ROUNDED.format(name=name, rows=rows, most=float(MAX_COPIES), unit=UNIT, offsets=OFFSETS)


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), w AS (
  SELECT *, CASE source_no % {len(WEIGHTS)} {" ".join(f"WHEN {i} THEN {x}::DOUBLE" for i, x in enumerate(WEIGHTS))} END AS weight FROM s
), q AS (
  SELECT *, {float(MAX_COPIES)}::DOUBLE * source_size AS most, row_number() OVER (ORDER BY source_size / weight, source_no) AS k FROM w
), l AS (
  SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q
), f AS (SELECT min(k) AS k FROM l WHERE weight * level <= most),
g AS (
  SELECT source, source_no, source_size, CASE WHEN l.k < coalesce(f.k, 1e18) THEN most ELSE weight * (SELECT level FROM l l2 WHERE l2.k = f.k) END AS target FROM l, f
), known AS (
  SELECT doc_id, d.size, source_no, source_size, target, d.size > source_size * {LARGE_SHARE} AS large FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), small AS (SELECT source_no, sum(size) FILTER (NOT large) AS small_size FROM known GROUP BY source_no),
large_rows AS (
  SELECT known.*, target AS goal, source_size::DOUBLE AS part_size, floor(target - {MAX_COPIES} * coalesce(small_size, 0) + 0.2837) AS lo, floor(target + 0.2837) AS hi
  FROM known JOIN small USING (source_no) WHERE large
), {_rounded("large_taken", "large_rows")},
left_over AS (
  SELECT source_no, small_size, least(greatest(g.target - coalesce((SELECT sum(taken) FROM large_taken x WHERE x.source_no = g.source_no), 0), 0), {MAX_COPIES} * coalesce(small_size, 0))::DOUBLE AS goal
  FROM g JOIN small USING (source_no)
), small_rows AS (
  SELECT known.*, CASE WHEN small_size = 0 AND source_size > 0 THEN 1.0 ELSE left_over.goal END AS goal, CASE WHEN small_size = 0 THEN 1.0 ELSE small_size::DOUBLE END AS part_size, floor(left_over.goal + 0.2837) AS lo, floor(left_over.goal + 0.2837) AS hi
  FROM known JOIN left_over USING (source_no) WHERE NOT large
), {_rounded("small_taken", "small_rows")}
SELECT doc_id, size, source_size, target, taken FROM large_taken UNION ALL SELECT doc_id, size, source_size, target, taken FROM small_taken
"""
