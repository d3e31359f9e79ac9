import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from limpid.functions.urls import authority_host
from limpid.operators import dedup, skew


def rows_of(seed, n=3000):
    r = random.Random(seed)
    # one key holds a third of the rows, some keys and values are null
    return [("hot" if r.random() < 0.34 else r.choice([None, *"abcdefgh"]), r.choice([None, *range(-3, 40)])) for _ in range(n)]


def test_profile_against_brute_force(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "key string, value int")
    got = {r.key: (r.n_rows, r.n_distinct, r.mode, r.mode_rows) for r in skew.profile(skew.compress(df, F.col("key"), F.col("value"))).collect()}
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    for k, values in by.items():
        c = Counter(v for v in values if v is not None)
        top = min(((-n, v) for v, n in c.items()), default=(0, None))
        assert got[k] == (len(values), len(c), top[1], -top[0])
    assert len(got) == len(by)


def test_percentiles_against_brute_force(spark):
    rows = rows_of(2)
    weighted = skew.compress(spark.createDataFrame(rows, "key string, value int"), F.col("key"), F.col("value")).where("key is not null")
    got = {(r.key, r.p): r.value for r in skew.percentiles(weighted, (0.0, 0.5, 0.9, 1.0)).collect()}
    by = defaultdict(list)
    for k, v in rows:
        if k is not None and v is not None:
            by[k].append(v)
    for k, values in by.items():
        values.sort()
        for p in (0.0, 0.5, 0.9, 1.0):
            at = next(i for i in range(len(values)) if (i + 1) >= p * len(values))
            assert got[(k, p)] == values[at], (k, p)


def test_edges(spark):
    empty = spark.createDataFrame([], "key string, value string")
    profiled = skew.profile(skew.compress(empty, F.col("key"), F.col("value")))
    assert profiled.count() == 0 and skew.heavy_keys(profiled, 0.01).count() == 0
    nulls = spark.createDataFrame([("k", None), ("k", None)], "key string, value string")
    assert skew.profile(skew.compress(nulls, F.col("key"), F.col("value"))).first()[1:] == (2, 0, None, 0)
    ties = spark.createDataFrame([("k", "b"), ("k", "a")], "key string, value string")
    assert skew.profile(skew.compress(ties, F.col("key"), F.col("value"))).first().mode == "a"
    # columns named like those of the operator do no harm
    clash = spark.createDataFrame([("u", 5, "x")], "n string, key int, value string")
    assert skew.compress(clash, F.col("n"), F.col("value")).first() == ("u", "x", 1)


def test_heavy_keys(spark):
    df = spark.createDataFrame([("http://A.x:80/p",)] * 50 + [(f"http://h{i}.x",) for i in range(50)], "url string")
    profiled = skew.profile(skew.compress(df, authority_host(F.col("url")), F.col("url")))
    assert [r.key for r in skew.heavy_keys(profiled, 0.02).collect()] == ["a.x"]
    assert skew.heavy_keys(profiled, 0.01).count() == 51


def test_keep_first(spark):
    rows = [("a", 2, 1, "x"), ("a", 1, 9, "y"), ("a", None, 5, "z"), (None, 3, 1, "p"), (None, 3, 0, "q"), ("b", 1, 1, None), ("b", 1, 1, None)]
    df = spark.createDataFrame(rows, "key string, source int, c0 int, _row string")
    got = sorted(dedup.keep_first(df, F.col("key"), ["source", "c0"]).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([("a", None, 5, "z"), (None, 3, 0, "q"), ("b", 1, 1, None)], key=str)
    again = sorted(dedup.keep_first(df.repartition(7), F.col("key"), ["source", "c0"]).collect(), key=str)
    assert got == again
