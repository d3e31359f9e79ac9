from pyspark.sql import functions as F

from limpid.plans import reference
from limpid.streaming import hygiene


def counted(df):
    return sorted((str(r.window_start), r.event_type or "", r.n) for r in df.collect())


def write_events(spark, rows, path, mode="append"):
    df = spark.createDataFrame(rows, "ts string, user_id bigint, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.mode(mode).parquet(path)


def by_batch(spark, path):
    rows = spark.read.parquet(path).where("ts is not null")
    return rows.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("window_start"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def test_windows_hold_the_newest_too(spark, tmp_path):
    days = [f"2024-01-{d:02} {h:02}:59:25" for d in (1, 2, 3) for h in (0, 12, 23)]
    write_events(spark, [(t, i, k) for i, t in enumerate(days) for k in ("view", "buy", None)[: 1 + i % 3]] + [(None, 1, "view")], f"{tmp_path}/events.parquet")
    got = reference.QUERIES["T3_stream_windows"](spark, str(tmp_path))
    want = counted(by_batch(spark, f"{tmp_path}/events.parquet"))
    assert counted(got) == want and sum(n for *_, n in want) == 18


def test_windows_over_several_batches(spark, tmp_path):
    path = f"{tmp_path}/events.parquet"
    for day, hours in ((1, (1, 5)), (1, (9, 23)), (2, (0, 3)), (2, (4,))):
        write_events(spark, [(f"2024-01-{day:02} {h:02}:00:00", h, "view") for h in hours], path)
    rows = hygiene.read(spark, path, spark.read.parquet(path).schema, 1).withColumn("ts", F.col("ts").cast("timestamp"))
    got = hygiene.drain_last(hygiene.windowed_counts(rows, "ts", "1 day", "1 day", "event_type"), "windows", ["window_start", "event_type"])
    assert counted(got) == counted(by_batch(spark, path))


def test_windows_of_nothing(spark, tmp_path):
    path = f"{tmp_path}/events.parquet"
    write_events(spark, [], path)
    assert reference.QUERIES["T3_stream_windows"](spark, str(tmp_path)).count() == 0
