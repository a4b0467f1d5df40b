"""Multiple-testing adjustments of a table of p-values, for families of any size.

Null and NaN p-values are no tests: they don't count and their adjusted value is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of p that distinct values are dealt to; windows run inside a range of a family, and one row a range carries what lies outside.
RANGES = 256


def _tests(p: str) -> Column:
    """The p-value as double, null where there is none."""
    x = F.col(p).cast("double")
    return F.when(~F.isnan(x), x)


def _stepped(df: DataFrame, p: str, out: str, by: list[str], value, backwards: bool) -> DataFrame:
    """df with out = the running extreme of value(p, n, upto, m): the least from above if backwards, else the greatest from below.

    n tests of a family (`by`) have the p-value, upto have it or a smaller one, of m in all. Equal p-values are one row until
    the end. Cuts of p only say where the work is done.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.withColumn("_p", _tests(p))
    values = rows.filter(F.col("_p").isNotNull()).groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col("_p").alias("_x")).agg(F.count("*").alias("_n"))
    cuts = sorted(set(rows.approxQuantile("_p", [i / RANGES for i in range(1, RANGES)], 0.25 / RANGES)))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("_x"))) if cuts else F.lit(0)
    values = values.withColumn("_range", place)
    family, part = Window.partitionBy(*keys), Window.partitionBy(*keys, "_range")
    extreme, pick, order = (F.min, F.least, F.desc) if backwards else (F.max, F.greatest, F.asc)

    def carry(table: DataFrame, columns: list[Column], onto: DataFrame) -> DataFrame:
        held = table.select(*[F.col(c).alias(f"{c}_") for c in [*keys, "_range"]], *columns)
        return onto.join(held, [onto[c].eqNullSafe(held[f"{c}_"]) for c in [*keys, "_range"]]).drop(*[f"{c}_" for c in [*keys, "_range"]])

    counts = values.groupBy(*keys, "_range").agg(F.sum("_n").alias("_held"))
    below = (F.sum("_held").over(family.orderBy("_range")) - F.col("_held")).alias("_below")
    ranked = carry(counts, [F.sum("_held").over(family).alias("_m"), below], values)
    upto = F.sum("_n").over(part.orderBy("_x")) + F.col("_below")
    ranked = ranked.withColumn("_v", value(F.col("_x"), F.col("_n"), upto, F.col("_m")))
    best = ranked.groupBy(*keys, "_range").agg(extreme("_v").alias("_best"))
    past = extreme("_best").over(family.orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)).alias("_past")
    own = extreme("_v").over(part.orderBy(order("_x")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    done = carry(best, [past], ranked.withColumn("_own", own)).select(*keys, "_x", F.least(F.lit(1.0), pick("_own", "_past")).alias("_out"))
    on = [rows[c].eqNullSafe(done[k]) for c, k in zip(by, keys, strict=True)] + [rows["_p"] == done["_x"]]
    return rows.join(done, on, "left").withColumn(out, F.col("_out")).drop("_p", "_x", "_out", *keys)


def bh_adjust(df: DataFrame, p: str = "p_value", out: str = "p_adjusted", by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg: the running minimum from above of p * m / rank, at most 1. Families are the values of `by`."""
    return _stepped(df, p, out, by or [], lambda p, n, upto, m: p * m / upto, backwards=True)


def holm_adjust(df: DataFrame, p: str = "p_value", out: str = "p_adjusted", by: list[str] | None = None) -> DataFrame:
    """Holm: the running maximum of p * (m - rank + 1), at most 1."""
    return _stepped(df, p, out, by or [], lambda p, n, upto, m: p * (m - upto + n), backwards=False)


def bonferroni_adjust(df: DataFrame, p: str = "p_value", out: str = "p_adjusted", by: list[str] | None = None) -> DataFrame:
    """Bonferroni: p * m, at most 1; m comes from an aggregation per family."""
    rows = df.withColumn("_p", _tests(p))
    if not by:
        m = rows.agg(F.count("_p")).first()[0]
        return rows.withColumn(out, F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), F.col("_p") * m))).drop("_p")
    names = [f"_k{i}" for i in range(len(by))]
    each = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]).agg(F.count("_p").alias("_m"))
    on = [rows[c].eqNullSafe(each[n]) for c, n in zip(by, names, strict=True)]
    return rows.join(each, on).withColumn(out, F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), F.col("_p") * F.col("_m")))).drop("_p", "_m", *names)
