"""The stateless hygiene expressions on streams, and dedup under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions import urls
from limpid.operators import validate
from limpid.session import new_folder


def read(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """A stream over a table's files; path may be one file or a folder."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path[:-1] + f"[{path[-1]}]")


def clean_urls(rows: DataFrame, keep: list[str], url_col: str = "url") -> DataFrame:
    """keep, the cleaned URL, its host and the reject reason; stateless, the same for batch and stream."""
    cleaned = urls.clean(F.col(url_col))
    return rows.select(*keep, cleaned.alias("clean_url"), urls.authority_host(cleaned).alias("host"), validate.url_reason(cleaned).alias("reject_reason"))


def dedup(rows: DataFrame, key: list[str], time_col: str, delay: str) -> DataFrame:
    """One row per key among rows that arrive within delay of each other; the state is dropped behind the watermark."""
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(rows: DataFrame, time_col: str, delay: str, width: str, by: str) -> DataFrame:
    """Rows per time window and value; late rows count until the watermark passes their window."""
    counted = rows.withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), by, "n")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is available and returns what it wrote, from the shared folder."""
    spark = stream.sparkSession
    home = new_folder(spark, name)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def drain_last(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """As drain(), for an aggregate by keys: the last row of every key, those that the watermark has not passed included.

    Append mode gives a window only once the watermark is behind it, which the newest windows never see. Here each
    micro-batch writes the keys it touched (a repeated one overwrites), and of each key the latest is returned.
    """
    spark = stream.sparkSession
    home = new_folder(spark, name)
    out = f"{home}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if not query.lastProgress:  # nothing to read, so that no batch was written
        return spark.createDataFrame([], stream.schema)
    rest = [c for c in stream.columns if c not in keys]
    last = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)
    return last.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*[F.col(c if c in keys else f"_last.{c}").alias(c) for c in stream.columns])
