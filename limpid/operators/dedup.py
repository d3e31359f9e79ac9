"""A3: one row per key, deterministically.

The row kept is the least by an explicit order, as the minimum of a struct: it combines on the map side, so a
key that holds a third of all rows never lies in one task, unlike a window over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Of the rows of each key the first by order, then by all other columns; a null key is a key of its own.

    Nulls in order come first. All columns of df are kept, none is added.
    """
    names = [*order, *[c for c in df.columns if c not in order]]
    # positions instead of names, so that no column of df can clash
    least = F.min(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]))
    kept = df.groupBy(key.alias("_key")).agg(least.alias("_row"))
    return kept.select(*[F.col(f"_row.c{names.index(c)}").alias(c) for c in df.columns])


def copies(df: DataFrame, key: Column, order: str) -> DataFrame:
    """(key, first, n_copies): the least order value and the number of rows of every key."""
    return df.groupBy(key.alias("key")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n_copies"))
