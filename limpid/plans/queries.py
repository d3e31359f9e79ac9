"""Queries of the core operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.functions import urls
from limpid.operators import parse, skew
from limpid.session import prepare, table

# ---------------------------------------------------------------- problems 5 and 6


def _host_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ulp_records").where(urls.present(F.col("url")))
    return skew.profile(skew.compress(rows, urls.authority_host(F.col("url")), F.col("username"))).where(F.col("key").isNotNull())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ulp_records").where(urls.present(F.col("url")))
    profiled = skew.profile(skew.compress(rows, urls.authority_host(F.col("url")), F.col("username")))
    return skew.heavy_keys(profiled, 0.01, rows).where(F.col("key").isNotNull()).select(F.col("key").alias("host"))


def p5_hosts(spark: SparkSession, d: str) -> DataFrame:
    return _host_profile(spark, d).select(F.col("key").alias("host"), "n_rows", F.col("n_distinct").alias("n_usernames"))


def p5_modes(spark: SparkSession, d: str) -> DataFrame:
    """Per host the most frequent account name and how often it occurs."""
    return _host_profile(spark, d).select(F.col("key").alias("host"), F.col("mode").alias("username"), F.col("mode_rows").alias("n_rows"))


def p5_name_length(spark: SparkSession, d: str) -> DataFrame:
    """Per host the exact median and 90th percentile of the length of account names."""
    rows = table(spark, d, "ulp_records").where(urls.present(F.col("url")) & urls.authority_host(F.col("url")).isNotNull())
    weighted = skew.compress(rows, urls.authority_host(F.col("url")), F.length("username"))
    return skew.percentiles(weighted, (0.5, 0.9)).select(F.col("key").alias("host"), "p", F.col("value").alias("n_chars"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return parse.bad_lines(table(spark, d, "ulp_raw"), "raw_id")


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    rows = parse.good_lines(table(spark, d, "ulp_raw"), "raw_id")
    return rows.withColumns({"source_id": F.col("source_id").cast("bigint"), "hits": F.col("hits").cast("bigint")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: (lambda s, d, f=f: f(prepare(s), d))
    for name, f in globals().copy().items()
    if name[0] == "p" and name[1:2].isdigit() and callable(f)
}

_BLANK = r"regexp_replace({}, '[\s\p{{Z}}\x{{85}}\x{{0b}}]', '', 'g') = ''"
_HOST = r"nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '')"
_HOSTS = f"""
with r as (select {_HOST} as host, username from ulp_records where url is not null and not ({_BLANK.format("url")}))"""
_QUOTED = r'"(?:[^"]|"")*"|[^",]*'

SQL: dict[str, str] = {
    "p5_found": _HOSTS + " select host from r where host is not null group by host having count(*) >= 0.01 * (select count(*) from r)",
    "p5_hosts": _HOSTS + " select host, count(*) as n_rows, count(distinct username) as n_usernames from r where host is not null group by host",
    "p5_modes": _HOSTS
    + """, c as (select host, username, count(*) as n from r where host is not null group by host, username),
        m as (select host, username, case when username is null then 0 else n end as n from c)
        select host, username, n as n_rows from m qualify row_number() over (partition by host order by username is null, n desc, username) = 1""",
    "p5_name_length": _HOSTS
    + """, l as (select host, length(username) as n from r where host is not null and username is not null)
        select host, 0.5::double as p, quantile_disc(n, 0.5)::int as n_chars from l group by host
        union all select host, 0.9::double, quantile_disc(n, 0.9)::int from l group by host""",
    "p6_found": rf"""
        with q as (
          select raw_id, raw, regexp_matches(raw, '(?s)^(?:{_QUOTED})(?:,(?:{_QUOTED}))*$') as quoted, regexp_extract_all(',' || raw, '(?s),({_QUOTED})', 1) as f from ulp_raw
        ), u as (
          select raw_id, raw, quoted, list_transform(f, lambda x: case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end) as f from q
        ), c as (
          select raw_id, case
            when raw is null then 'columns' when not quoted then 'quoting' when len(f) <> 5 then 'columns'
            when not (octet_length(encode(f[1])) <= 2048 and regexp_matches(f[1], '(?s)^[A-Za-z0-9_]+://[A-Za-z0-9.\-]+(:[0-9]{{1,5}})?(/.*)?$')
              and octet_length(encode(f[2])) between 1 and 128 and not regexp_matches(f[2], '[\x00-\x1f\x7f-\x9f]')
              and regexp_matches(f[3], '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}$') and try_strptime(f[3], '%Y-%m-%dT%H:%M:%S') is not null
              and regexp_matches(f[4], '^[0-9]*$') and regexp_matches(f[5], '^[0-9]*[1-9][0-9]*$')) then 'value'
          end as reason_code from u
        ) select raw_id, reason_code from c where reason_code is not null""",
}
SQL["p6_loaded"] = (
    SQL["p6_found"].rpartition(") select")[0]
    + """) select u.raw_id, f[1] as url, f[2] as username, strptime(f[3], '%Y-%m-%dT%H:%M:%S')::timestamp as first_seen, try_cast(f[4] as bigint) as source_id, try_cast(f[5] as bigint) as hits
        from u join c using (raw_id) where c.reason_code is null"""
)
