"""Reject reasons (L3-L6, U2, V1, V2, V5), quarantine (S9) and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.functions import lines, urls
from limpid.functions.text import keyed_hash
from limpid.operators.parse import URL_RULE


def url_reason(url: Column, max_bytes: int = 2048, known_only: bool = False) -> Column:
    """The first reason why a URL is refused, null for a good one: empty, too_long, scheme (if known_only), pattern."""
    reason = F.when(~urls.present(url) | url.isNull(), "empty").when(F.octet_length(url) > max_bytes, "too_long")
    if known_only:
        reason = reason.when(~urls.known_scheme(url), "scheme")
    return reason.when(~url.rlike(URL_RULE), "pattern")


def split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected with reject_reason); together they are df."""
    judged = df.withColumn("reject_reason", reason)
    # the column name is this operator's own: a column of that name in df is replaced
    return judged.where(F.col("reject_reason").isNull()).drop("reject_reason"), judged.where(F.col("reject_reason").isNotNull())


def quarantine(rejected: DataFrame, raw_col: str, keep: list[str], key: str) -> DataFrame:
    """Reason, where the line stood and its keyed hash (HMAC); never the raw line (a bare hash of a short line can be guessed)."""
    return rejected.select(F.col("reject_reason"), *keep, keyed_hash(F.col(raw_col), key).alias("line_hmac"))


def hygiene_lines(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The trimmed lines of a text column with their number from 1 and the reason to drop them."""
    each = df.select(*keep, F.posexplode(F.split(lines.line_ends(F.col(text_col)), "\n", -1)).alias("pos", "raw"))
    return each.select(*keep, (F.col("pos") + 1).alias("line_no"), lines.trim(F.col("raw")).alias("line")).withColumn("reject_reason", lines.reject_reason(F.col("line")))


def run_statistics(judged: DataFrame, bytes_col: str | None = None, n_bytes: Column | None = None) -> DataFrame:
    """One row of counters, by an aggregate (an accumulator would count retried tasks twice). Empty lines are no rejections."""
    reason = F.col("reject_reason")
    return judged.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(reason.isNull()).alias("n_kept"),
        F.count_if(reason == "empty").alias("n_empty"),
        F.count_if(reason.isNotNull() & (reason != "empty")).alias("n_rejected"),
        F.coalesce(F.sum((F.octet_length(bytes_col) if n_bytes is None else n_bytes).cast("bigint")), F.lit(0)).alias("n_bytes"),
    )


def by_reason(judged: DataFrame) -> DataFrame:
    """A2."""
    return judged.where(F.col("reject_reason").isNotNull()).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
