"""Problem 2: the most frequent values of a column, in bounded memory.

Lossy counting. Each partition keeps a dictionary of entries (count, maximum undercount); at every
bucket boundary entries whose count plus undercount does not exceed the number of buckets so far are
pruned. Summaries are merged by summing counts and undercounts, where a partition that lacks a value
contributes its own bound. Each value therefore gets a guaranteed interval [low, high] around its true
count, and every value with a share of at least ``support`` is among the entries.

The error is spent in three steps: a quarter of ``epsilon`` while a partition streams, half of it when
its summary is pruned at the end, all of it when the merged summary is. What remains of a partition and
of the whole are therefore at most ``2 / epsilon`` entries each, and a task never holds more than
``O(1/epsilon * log(epsilon * rows))``, whatever the number of distinct values. Partitions are put
together until there are ``most_partitions``, so that the merge does not grow with the data either; it
combines on the map side, so a value that holds a third of all rows costs no more than another.

Defined results: nulls and empty values are not counted; values are compared exactly; ties are all
reported; no rows, no values.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SUPPORT = 0.0025
#: epsilon as a share of support where none is given.
EPSILON_SHARE = 0.1
MOST_PARTITIONS = 4096
#: So many candidates at most are sent to all tasks; each is a value and its count.
MOST_BROADCAST = 20_000


def lossy_count(chunks: Iterable[list[str]], epsilon: float) -> tuple[dict[str, list[int]], int, int]:
    """(value -> [count, undercount], rows, bound on the count of any value left out); at most 2 / epsilon entries."""
    width = math.ceil(2 / epsilon)
    entries: dict[str, list[int]] = {}
    bucket, rows = 1, 0
    room = width
    for chunk in chunks:
        at = 0
        while at < len(chunk):
            part = chunk[at : at + room]
            at += len(part)
            room -= len(part)
            rows += len(part)
            for value, n in Counter(part).items():
                entry = entries.get(value)
                if entry is None:
                    entries[value] = [n, bucket - 1]
                else:
                    entry[0] += n
            if not room:
                entries = {v: e for v, e in entries.items() if e[0] + e[1] > bucket}
                bucket, room = bucket + 1, width
    bound = math.floor(epsilon * rows)
    return {v: e for v, e in entries.items() if e[0] + e[1] > bound}, rows, bound


def _summaries(epsilon: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries, rows, bound = lossy_count((b["value"].tolist() for b in batches), epsilon)
        if rows:
            yield pd.DataFrame({"value": [None], "n": [rows], "delta": [bound]})  # the partition's own line
            yield pd.DataFrame({"value": list(entries), "n": [e[0] for e in entries.values()], "delta": [e[1] - bound for e in entries.values()]})

    return run


def summarise(df: DataFrame, col: str, epsilon: float, most_partitions: int = MOST_PARTITIONS) -> DataFrame:
    """(value, low, high, rows): merged summary of at most 2 / epsilon entries; rows is the number of values counted.

    high - low is at most ``epsilon * rows``, and so is the count of any value left out. Per value, undercounts are
    summed as differences from the partitions' bounds, so that partitions without the value need not be listed.
    """
    if not 0 < epsilon < 1:
        raise ValueError("epsilon must lie between 0 and 1")
    values = df.select(F.col(col).cast("string").alias("value")).where(F.col("value") != "").coalesce(most_partitions)
    parts = values.mapInPandas(_summaries(epsilon / 2), "value string, n bigint, delta bigint")
    # the null group is the whole: rows and sum of bounds
    merged = parts.groupBy("value").agg(F.sum("n").alias("n"), F.sum("delta").alias("delta")).checkpoint()
    whole = merged.where(F.col("value").isNull()).first()
    rows, bound = (whole["n"], whole["delta"]) if whole else (0, 0)
    high = F.col("n") + F.col("delta") + F.lit(bound)
    kept = merged.where(F.col("value").isNotNull() & (high > F.lit(math.floor(epsilon * rows))))
    return kept.select("value", F.col("n").alias("low"), high.alias("high"), F.lit(rows).cast("bigint").alias("rows"))


def frequent(df: DataFrame, col: str, support: float = SUPPORT, epsilon: float | None = None) -> DataFrame:
    """(value, low, high, rows) of every value that may hold at least support of the rows."""
    epsilon = EPSILON_SHARE * support if epsilon is None else epsilon
    if epsilon >= support:
        raise ValueError("epsilon must be below support, or any value may be frequent")
    summary = summarise(df, col, epsilon)
    return summary.where(F.col("high") >= F.lit(support) * F.col("rows"))


def frequent_exact(df: DataFrame, col: str, support: float = SUPPORT, epsilon: float | None = None) -> DataFrame:
    """(value, n, rows): the values of frequent() counted exactly, without those below support.

    The candidates are at most ``1 / (support - epsilon)`` values; they are sent to all tasks if that is no more than
    MOST_BROADCAST, else joined as any table.
    """
    epsilon = EPSILON_SHARE * support if epsilon is None else epsilon
    may = frequent(df, col, support, epsilon).select("value", "rows")
    if 1 / (support - epsilon) <= MOST_BROADCAST:
        may = F.broadcast(may)
    counted = df.select(F.col(col).cast("string").alias("value")).join(may, "value").groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.first("rows").alias("rows"))
    return counted.where(F.col("n") >= F.lit(support) * F.col("rows"))
