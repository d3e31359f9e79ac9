"""Queries of the operators for training data, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.llm import formatting, frequent, leakage, lookalike, mojibake, packing, pii, seen
from limpid.session import prepare, table


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    names = mojibake.find_garbled(table(spark, d, "ulp_records"), "record_id", "username", "username")
    return names.unionByName(mojibake.find_garbled(table(spark, d, "ulp_secrets"), "secret_id", "password", "password"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("field_name", "row_id")


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    """The restored account names; of password values only whether they changed and their length."""
    g = _garbled(spark, d)
    name = F.when(F.col("field_name") == "username", F.col("restored"))
    return g.select("field_name", "row_id", name.alias("restored"), (F.col("restored") != F.col("original")).alias("changed"), F.length("restored").alias("n_chars"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent.frequent_exact(table(spark, d, "ulp_secrets"), "password").select(F.col("value").alias("password"))


def p2_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Values for a blocklist with guaranteed count intervals."""
    return frequent.frequent(table(spark, d, "ulp_secrets"), "password").select(F.col("value").alias("password"), "low", "high")


def p2_covered(spark: SparkSession, d: str) -> DataFrame:
    """The frequent values with their exact counts, and whether the interval guaranteed for each covers it."""
    rows = table(spark, d, "ulp_secrets")
    exact = frequent.frequent_exact(rows, "password").select(F.col("value").alias("password"), "n")
    narrow = F.col("high") - F.col("low") <= frequent.EPSILON_SHARE * frequent.SUPPORT * F.col("rows")
    spans = frequent.frequent(rows, "password").select(F.col("value").alias("password"), "low", "high", narrow.alias("narrow"))
    return exact.join(spans, "password", "left").select("password", "n", F.coalesce(F.col("n").between(F.col("low"), F.col("high")) & F.col("narrow"), F.lit(False)).alias("covered"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.members(table(spark, d, "ulp_records"))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return formatting.collapse(table(spark, d, "ulp_records")).select("first_record_id", "n_copies")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.repeats(spark, f"{d}/ulp_records.parquet")


def p4_decided(spark: SparkSession, d: str) -> DataFrame:
    return seen.decide(spark, f"{d}/ulp_records.parquet")


def p4_wrong_rate(spark: SparkSession, d: str) -> DataFrame:
    """Of the whole table, arriving in six batches out of order, with a restart halfway."""
    return seen.rehearse(spark, table(spark, d, "ulp_records"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalike.same_reading_pairs(table(spark, d, "ulp_exposures"), "exposure_id", "url", "username")
    return pairs.select(F.col("id_a").alias("exposure_id_a"), F.col("id_b").alias("exposure_id_b"))


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_reading_classes(table(spark, d, "ulp_exposures"), "exposure_id", "url", "username").withColumnRenamed("id", "exposure_id")


def p7_consistent(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent(table(spark, d, "ulp_exposures").select("exposure_id", "url", "username"), "url", "username")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "n_tokens")
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p8_pack(spark, d))


def p8_sound(spark: SparkSession, d: str) -> DataFrame:
    """Packed by the table's own counts: what SQL can say about every item of a sound packing."""
    docs = table(spark, d, "documents").select("doc_id", "n_tokens")
    return packing.sound(packing.pack(docs, size=packing.size_column(docs, tokenizer=None))).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(p9_found(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_personal(table(spark, d, "documents"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"))


def p10_labelers(spark: SparkSession, d: str) -> DataFrame:
    return pii.labelers(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: (lambda s, d, f=f: f(prepare(s), d))
    for name, f in globals().copy().items()
    if name[0] == "p" and name[1:2].isdigit() and callable(f)
}

_PRESENT = r"url is not null and username is not null and regexp_replace(url, '[\s\p{Z}\x{85}\x{0b}]', '', 'g') <> '' and regexp_replace(username, '[\s\p{Z}\x{85}\x{0b}]', '', 'g') <> ''"
_PLAIN = r"regexp_replace(lower({}), '[\s\p{{Z}}\p{{P}}\x{{85}}\x{{0b}}]', '', 'g')"
_KEYED = f"""
with k as (
  select record_id, least(a, b) as x, greatest(a, b) as y
  from (select record_id, {_PLAIN.format("url")} as a, {_PLAIN.format("username")} as b from ulp_records where {_PRESENT})
), g as (select x, y, min(record_id) as first_record_id, count(*) as n_copies from k group by x, y)
"""

_GRAMS = """select {0}, unnest(list_transform(generate_series(1, len(w) - 12), lambda k: array_to_string(w[k : k + 12], ' '))) as g
  from (select {0}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from {1} where {0} is not null)"""
_LEAKS = f"with d as ({_GRAMS.format('doc_id', 'documents')}), i as ({_GRAMS.format('item_id', 'benchmark')}) "

SQL: dict[str, str] = {
    "p2_found": """
        select password from ulp_secrets where password <> '' group by password
        having count(*) >= 0.0025 * (select count(*) from ulp_secrets where password <> '')""",
    "p2_covered": """
        select password, count(*) as n, true as covered from ulp_secrets where password <> '' group by password
        having count(*) >= 0.0025 * (select count(*) from ulp_secrets where password <> '')""",
    "p3_found": _KEYED + "select g.first_record_id, k.record_id from k join g using (x, y) where k.record_id <> g.first_record_id",
    "p3_collapsed": _KEYED + "select first_record_id, n_copies from g",
    "p4_found": f"""
        select record_id from (
          select record_id, min(record_id) over (partition by url, username) as first_id from ulp_records where {_PRESENT}
        ) where record_id > first_id""",
    "p4_decided": f"""
        select record_id, record_id > min(record_id) over (partition by url, username) as repeat from ulp_records where {_PRESENT}""",
    "p4_wrong_rate": f"""
        select count(*) as n_rows, count(*) filter (record_id > first_id) as n_repeats, cast(0 as bigint) as n_wrong, cast(0 as double) as wrong_rate from (
          select record_id, min(record_id) over (partition by url, username) as first_id from ulp_records where {_PRESENT})""",
    "p9_found": _LEAKS + "select distinct doc_id, item_id from d join i using (g)",
    "p9_items": _LEAKS + "select item_id, count(distinct doc_id) as n_docs from d join i using (g) group by item_id",
    "p8_sound": "select doc_id, cast(ceil(coalesce(n_tokens, 0) / 2048) as bigint) as n_parts, coalesce(n_tokens, 0)::bigint as n_tokens, true as fits from documents",
}
