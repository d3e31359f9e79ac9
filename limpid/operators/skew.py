"""Problem 5: per-key results when a few keys hold most rows.

Value-frequency compression: rows are grouped by key *and* value first, then by key. The first
group-by combines on the map side and spreads a heavy key over as many groups as it has values;
the second sees one weighted row per distinct value, again combined before its shuffle, so that no
task receives the rows of a key. Counts, distinct counts, modes and percentiles stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compress(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value, n): how often each value occurs under each key; null values are kept as a value."""
    return df.select(key.alias("key"), value.alias("value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def profile(weighted: DataFrame) -> DataFrame:
    """(key, n_rows, n_distinct, mode, mode_rows) from weighted values.

    Nulls count as rows but neither as distinct values nor as mode; of equally frequent values the
    smallest is the mode; a key with only null values has a null mode with 0 rows; no rows, no keys.
    The mode is chosen as the least of (-n, value), which combines on the map side.
    """
    order = F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("m"), F.col("value").alias("v")))
    out = weighted.groupBy("key").agg(F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct"), F.min(order).alias("best"))
    return out.select("key", "n_rows", "n_distinct", F.col("best.v").alias("mode"), F.coalesce(-F.col("best.m"), F.lit(0)).alias("mode_rows"))


def percentiles(weighted: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """(key, p, value): exact lower percentiles of non-null weighted values, the least value whose cumulated weight reaches p.

    A window over a heavy key would gather all its distinct values in one task. Values are therefore cut
    into slices (a few thousand by magnitude), whose weights are cumulated per key; the slice that a
    percentile falls into is cut once more, evenly between its ends; only the values of one such part,
    some 1e-5 of the key's, are put in order.
    """
    value = F.col("value").cast("double")
    rows = weighted.where(F.col("value").isNotNull()).withColumn("slice", F.floor(F.signum(value) * F.log2(F.abs(value) + 1) * 64))  # monotone
    cut = rows.groupBy("key", "slice").agg(F.sum("n").alias("w"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    along = Window.partitionBy("key").orderBy("slice")
    cut = cut.select("key", "slice", "w", "lo", "hi", (F.sum("w").over(along) - F.col("w")).alias("before"), F.sum("w").over(Window.partitionBy("key")).alias("total"))
    cut = cut.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in levels]))).withColumn("need", F.greatest(F.col("p") * F.col("total"), F.lit(0.5)))
    wanted = cut.where((F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("w"))).drop("w", "total")
    part = F.when(F.col("hi") > F.col("lo"), F.floor((value - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1000)).otherwise(0)
    inside = rows.join(wanted, ["key", "slice"]).select("key", "p", "value", "n", "before", "need", part.alias("part"))
    fine = inside.groupBy("key", "p", "part", "before", "need").agg(F.sum("n").alias("w"))
    fine = fine.withColumn("before", F.col("before") + F.sum("w").over(Window.partitionBy("key", "p").orderBy("part")) - F.col("w"))
    fine = fine.where((F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("w"))).drop("w")
    last = inside.drop("before", "need").join(fine, ["key", "p", "part"])
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("key", "p").orderBy("value"))
    return last.withColumn("upto", upto).where(F.col("upto") >= F.col("need")).groupBy("key", "p").agg(F.min("value").alias("value"))


def heavy_keys(profiled: DataFrame, share: float, rows: DataFrame | None = None) -> DataFrame:
    """The keys with at least share of all rows. The total is one scalar subquery: over rows where those are
    given (a plain count of the scan, without a shuffle), else over the profile."""
    total = (rows.agg(F.count(F.lit(1)).alias("t")) if rows is not None else profiled.agg(F.sum("n_rows").alias("t"))).scalar()
    return profiled.where(F.col("n_rows") >= F.lit(share) * total)
