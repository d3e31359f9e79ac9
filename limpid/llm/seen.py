"""Problem 4: has this key been seen before?

A streaming query keeps, per key, the id of its first row and the micro-batch in which it came in a disk-backed state
store (RocksDB) with checkpoints; no watermark, so no key ever expires. Keys are stored whole and compared exactly, so
the rate of wrong answers is 0; ``rehearse`` measures it over several batches out of order with a restart between.

The state is an aggregate, combined before its shuffle, so that a key that holds a third of all rows reaches the store
as one row per task. A key whose rows all bear the time of the present micro-batch is new in it, and the store emits
its first id; the ids of the batch's own rows run beside it through the same query, and a row that the store does not
name is a repeat. They meet by id, which no key can skew; only the files of the batch are read, none of an earlier one.
A restart from the checkpoint goes on where the last batch was committed, and memory does not grow with the keys.

Defined results: rows in which the id or a field is null, or a field empty or blank, take no part; within a micro-batch
the row with the smaller id came earlier, across batches the row of the earlier batch; an id that occurs twice in a
batch is one row of it, a repeat if none of its keys is new by it.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.formatting import present
from limpid.session import new_folder

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    "spark.sql.streaming.metricsEnabled": "false",
}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _glob(path: str) -> str:
    """A pattern that matches just this path: a stream reads folders or patterns, the table may be one file."""
    return path[:-1] + f"[{path[-1]}]"


def _stream(spark: SparkSession, path: str, schema: T.StructType, id_col: str, key_cols: list[str], home: str, max_files: int | None) -> None:
    """Runs over the files at path that the checkpoint in home does not know yet and writes (id, repeat) of every row to home/decided, a folder per micro-batch."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(_glob(path)).select(F.col(id_col).cast("bigint").alias("id"), *[F.col(c).alias(f"key{i}") for i, c in enumerate(key_cols)])
    keys = [f"key{i}" for i in range(len(key_cols))]
    for c in keys:
        rows = rows.where(present(F.col(c)))
    rows = rows.where("id is not null")
    # within a stream the time is that of the micro-batch, also when a batch is repeated after a failure
    now = F.unix_micros(F.current_timestamp())
    state = rows.withColumn("now", now).groupBy(*keys).agg(F.min("id").alias("id"), F.min("now").alias("since"), F.max("now").alias("last"))
    # a key touched again tells nothing: it was new in an earlier batch
    first = state.where(F.col("since") == F.col("last")).select("id", F.lit(True).alias("first"))
    out = rows.select("id", F.lit(False).alias("first")).union(first)

    def keep(batch: DataFrame, number: int) -> None:
        # overwriting makes a repeated batch harmless
        decided = batch.groupBy("id").agg((~F.bool_or("first")).alias("repeat"))
        decided.write.mode("overwrite").parquet(f"{home}/decided/batch={number}")

    with _settings(spark, _STORE):
        query = out.writeStream.outputMode("update").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()


def decide(spark: SparkSession, path: str, id_col: str = "record_id", key_cols: tuple[str, ...] = ("url", "username"), checkpoint: str | None = None, max_files: int | None = None) -> DataFrame:
    """(id, repeat): for every row that takes part, whether its key had arrived before.

    With the same checkpoint a later call reads only new files, remembers all earlier keys and returns the answers of
    all its batches, the earlier ones as they were given.
    """
    home = checkpoint or new_folder(spark, "seen")
    _stream(spark, path, spark.read.parquet(path).schema, id_col, list(key_cols), home, max_files)
    try:
        decided = spark.read.schema("id bigint, repeat boolean, batch int").parquet(f"{home}/decided")
    except AnalysisException as e:  # no batch was run
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        decided = spark.createDataFrame([], "id bigint, repeat boolean")
    return decided.select(F.col("id").alias(id_col), "repeat")


def repeats(spark: SparkSession, path: str, id_col: str = "record_id", key_cols: tuple[str, ...] = ("url", "username"), **options) -> DataFrame:
    """(id): the rows whose key had arrived before."""
    return decide(spark, path, id_col, key_cols, **options).where("repeat").select(id_col)


def _file(path: Column) -> Column:
    """A file's URI; without an authority it is written with one slash or with three."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):///", "$1:/").alias("file")


def _arrivals(spark: SparkSession, home: str) -> DataFrame:
    """(file, arrived): in which micro-batch a file was read, by the log of the stream's source."""
    entry = F.from_json("value", "path string, batchId bigint")
    log = spark.read.text(f"{home}/checkpoint/sources/0").where(F.col("value").startswith("{")).select(entry.alias("e"))
    return log.groupBy(_file(F.col("e.path"))).agg(F.min("e.batchId").alias("arrived"))


def wrong_rate(spark: SparkSession, path: str, id_col: str = "record_id", key_cols: tuple[str, ...] = ("url", "username"), checkpoint: str | None = None, max_files: int | None = None) -> DataFrame:
    """One row: rows decided, repeats said, wrong answers of either kind against an exact batch count, and their rate.

    The truth takes the order of the micro-batches from the log of files read, not from the state.
    """
    home = checkpoint or new_folder(spark, "seen")
    said = decide(spark, path, id_col, key_cols, checkpoint=home, max_files=max_files)
    rows = spark.read.parquet(path).select(_file(F.col("_metadata.file_path")), F.col(id_col).cast("bigint").alias("id"), *key_cols).where("id is not null")
    for c in key_cols:
        rows = rows.where(present(F.col(c)))
    # as many lines as files; adaptive execution broadcasts them if they are few
    arrived = rows.join(_arrivals(spark, home), "file")
    truth = arrived.groupBy(*key_cols).agg(F.min(F.struct("arrived", "id")).alias("first")).select(F.col("first.id").alias("true_id"))
    both = said.join(truth, F.col(id_col) == F.col("true_id"), "left")
    wrong = F.count_if(F.col("repeat") != F.col("true_id").isNull())
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("repeat").alias("n_repeats"), wrong.alias("n_wrong"), (wrong / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("wrong_rate"))


def rehearse(spark: SparkSession, df: DataFrame, id_col: str = "record_id", key_cols: tuple[str, ...] = ("url", "username"), batches: int = 6) -> DataFrame:
    """wrong_rate() of rows that arrive in several batches, smaller ids often after larger ones, with a restart halfway.

    The rows are dealt to the batches by a hash of their id and written to the shared folder, half of them before the
    first run of the stream and half before the second, which takes up its checkpoint.
    """
    path, home = new_folder(spark, "arrivals"), new_folder(spark, "seen")
    dealt = df.select(id_col, *key_cols).withColumn("deal", F.pmod(F.xxhash64(id_col), F.lit(batches)))
    first = max(1, batches // 2)
    for low, high in ((0, first), (first, batches)):
        part = dealt.where((F.col("deal") >= low) & (F.col("deal") < high))
        part.repartition(high - low, "deal").drop("deal").write.mode("append").parquet(path)
        decide(spark, path, id_col, key_cols, checkpoint=home, max_files=1)
    return wrong_rate(spark, path, id_col, key_cols, checkpoint=home, max_files=1)
