"""One query per operator of the inventory, by its ID, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.functions import encoding, lines, text, urls
from limpid.operators import dedup, parse, validate
from limpid.plans import queries as core
from limpid.session import prepare, table
from limpid.sources import files
from limpid.sources.config import Config
from limpid.streaming import hygiene

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY = "fixture-key"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda s, d: f(prepare(s), d)
        if sql:
            SQL[name] = sql
        return f

    return add


def _each(name: str, source: str, key: str, col: str, function, sql: str, out: str = "result") -> None:
    """A query that applies one Column function to a column of a whole table."""
    query(name, f"select {key}, {sql} as {out} from {source}")(lambda s, d: table(s, d, source).select(key, function(F.col(col)).alias(out)))


def _lines(s: SparkSession, d: str) -> DataFrame:
    return validate.hygiene_lines(table(s, d, "documents"), "text", ["doc_id"])


def _hmac(sql: str) -> str:
    """HMAC-SHA256 of a text under KEY."""
    outer, inner = ("".join(f"\\x{x ^ pad:02X}" for x in KEY.encode().ljust(64, b"\0")) for pad in (0x5C, 0x36))
    return f"sha256('{outer}'::blob || unhex(sha256('{inner}'::blob || encode({sql}))))"


class _T(str):
    """SQL with a place for an expression; the braces of regular expressions stay."""

    def format(self, *args: str) -> str:
        return self.replace("{0}", args[0]).replace("{}", args[0])


_W = r"[\s\p{Z}\x{85}\x{0b}]"
_TRIM = _T(rf"regexp_replace({{}}, '^{_W}+|{_W}+$', '', 'g')")
_BLANK = _T(rf"regexp_replace({{}}, '{_W}', '', 'g') = ''")
#: The trimmed lines of documents.
_LINES = rf"""
with s as (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as a from documents),
e as (select doc_id, unnest(a) as raw, generate_subscripts(a, 1) as line_no from s),
l as (select doc_id, line_no, {_TRIM.format("raw")} as line from e)
"""
_BARE = _T("lower({}) in (" + ", ".join(f"'{x}'" for x in lines.BARE_SCHEMES) + ")")
_REASON = f"case when line = '' then 'empty' when {_BARE.format('line')} then 'bare_scheme' when octet_length(encode(line)) > 4096 then 'too_long' when starts_with(line, '#') or starts_with(line, '//') or starts_with(line, '--') then 'prefix' end"
_SHAPE = _T(
    "case when {0} is null then null when octet_length(encode({0})) < 4 then 'unknown' when "
    + " or ".join(f"starts_with(lower({{0}}), '{p}')" for p in lines.URL_PREFIXES)
    + " then 'url_first' when starts_with(lower({0}), 'www.') then 'www_first' when starts_with({0}, '//') then 'slash_slash' when regexp_matches({0}, '(?s)^\\.[^./]') then 'leading_dot' else 'unknown' end"
)
_SCHEMES = ", ".join(f"'{x}'" for x in urls.SCHEMES)
_SCHEME = _T("nullif(lower(regexp_extract({}, '(?s)^(.*?)://', 1)), '')")

# ---------------------------------------------------------------- 2.1 sources and sinks

query("S1_inputs", "select source_id, file_path from source_files where lower(regexp_extract(file_path, '\\.([^./\\\\]+)$', 1)) in ('txt', 'csv', 'log', 'dat') order by file_path")(
    lambda s, d: table(s, d, "source_files").where(files.is_input(F.col("file_path"))).select("source_id", "file_path").orderBy("file_path")
)


def _marked(s: SparkSession, d: str) -> DataFrame:
    """Texts as bytes, a quarter of them behind each kind of byte order mark or none."""
    kind = F.pmod("doc_id", F.lit(4))
    mark = F.when(kind == 1, "EFBBBF").when(kind == 2, "FFFE").when(kind == 3, "FEFF").otherwise("")
    return table(s, d, "documents").select("doc_id", F.concat(F.unhex(mark), F.encode("text", "UTF-8")).alias("content"))


query("S2_bom", "select doc_id, case doc_id % 4 when 1 then 'utf-8' when 2 then 'utf-16le' when 3 then 'utf-16be' end as result from documents")(
    lambda s, d: _marked(s, d).select("doc_id", encoding.bom(F.col("content")).alias("result"))
)
query(
    "S3_labels",
    "select source_id, case when lower(trim(encoding)) in ('utf-8', 'utf8') then 'utf-8' when lower(trim(encoding)) in ('windows-1252', 'cp1252') then 'windows-1252' when lower(trim(encoding)) in ('latin-1', 'iso-8859-1') then 'iso-8859-1' when lower(trim(encoding)) in ('windows-1251', 'cp1251') then 'windows-1251' when lower(trim(encoding)) in ('utf-16le', 'utf-16-le') then 'utf-16le' when lower(trim(encoding)) in ('utf-16be', 'utf-16-be') then 'utf-16be' when lower(trim(encoding)) in ('us-ascii', 'gbk', 'shift_jis', 'koi8-r', 'iso-8859-15') then lower(trim(encoding)) else 'utf-8' end as result from source_files",
)(lambda s, d: table(s, d, "source_files").select("source_id", encoding.resolved(F.col("encoding")).alias("result")))


@query("S4_detected", r"select doc_id, case when doc_id % 2 = 1 and regexp_matches(text, '[^\x00-\x7f]') and not regexp_matches(text, '[^\x00-\x{ff}]') then 'windows-1252' when text is not null then 'utf-8' end as encoding, false as had_bom from documents")
def _detected(s: SparkSession, d: str) -> DataFrame:
    latin = (F.pmod("doc_id", F.lit(2)) == 1) & ~F.col("text").rlike(r"[^\x00-\x{FF}]")
    content = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return table(s, d, "documents").select("doc_id", encoding.detected(content).alias("d")).select("doc_id", "d.encoding", "d.had_bom")


query("S5_lossy", "select doc_id, text || chr(65533) || 'x' as result from documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", encoding.decode_utf8(F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF78")))).alias("result"))
)


@query("S5_charsets", "select doc_id, text as result from documents")
def _charsets(s: SparkSession, d: str) -> DataFrame:
    name = F.when(F.pmod("doc_id", F.lit(2)) == 1, "utf-16le").otherwise("utf-16be")
    content = F.when(name == "utf-16le", F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-16BE"))
    return table(s, d, "documents").select("doc_id", encoding.decode_lossy(content, name).alias("result"))


query(
    "S7_chunks",
    "select source_id, cast(least(268435456, greatest(4194304, floor(n_lines * 1000 / greatest(6 * 64, 32)))) as bigint) as result from source_files",
)(lambda s, d: table(s, d, "source_files").select("source_id", files.chunk_bytes(F.col("n_lines") * 1000, F.lit(6)).alias("result")))


_JUDGED = _LINES + f", j as (select *, {_REASON} as reject_reason from l) "


@query("S9_quarantine", _JUDGED + f"select reject_reason, doc_id, line_no, {_hmac('line')} as line_hmac from j where reject_reason <> 'empty'")
def _quarantine(s: SparkSession, d: str) -> DataFrame:
    _, bad = validate.split(_lines(s, d), F.col("reject_reason"))
    return validate.quarantine(bad.where("reject_reason <> 'empty'"), "line", ["doc_id", "line_no"], KEY)


@query("S9_bad_lines", f"select reason_code as reject_reason, file_path, line_no, {_hmac('raw')} as line_hmac from ulp_raw join ({core.SQL['p6_found']}) using (raw_id)")
def _bad_lines(s: SparkSession, d: str) -> DataFrame:
    judged = parse.classify(table(s, d, "ulp_raw")).where("reason_code is not null").withColumnRenamed("reason_code", "reject_reason")
    return validate.quarantine(judged, "raw", ["file_path", "line_no"], KEY)

query(
    "S10_statistics",
    _JUDGED
    + "select count(*) as n_lines, count(*) filter (reject_reason is null) as n_kept, count(*) filter (reject_reason = 'empty') as n_empty, count(*) filter (reject_reason <> 'empty') as n_rejected, sum(octet_length(encode(line)))::bigint as n_bytes from j",
)(lambda s, d: validate.run_statistics(_lines(s, d), "line"))
query("S11_config")(lambda s, d: s.createDataFrame(sorted(Config().flat().items()), "name string, value string"))

# ---------------------------------------------------------------- 2.2 line hygiene

_each("L1_line_ends", "documents", "doc_id", "text", lines.line_ends, r"regexp_replace(text, '\r\n?', chr(10), 'g')")
_each("L2_trim", "ulp_records", "record_id", "username", lines.trim, _TRIM.format("username"))
query("L3_not_empty", _LINES + "select doc_id, line_no from l where line <> ''")(lambda s, d: _lines(s, d).where(lines.not_empty(F.col("line"))).select("doc_id", "line_no"))
_each("L4_bare_scheme", "ulp_records", "record_id", "url", lines.bare_scheme, _BARE.format("url"))
_each("L5_too_long", "documents", "doc_id", "text", lines.too_long, "octet_length(encode(text)) > 4096")
query("L6_skipped", _LINES + "select doc_id, line_no, line from l where starts_with(line, '#') or starts_with(line, '//') or starts_with(line, '--')")(
    lambda s, d: _lines(s, d).where(lines.skipped(F.col("line"))).select("doc_id", "line_no", "line")
)
_each("L7_unquote", "ulp_records", "record_id", "username", lines.unquote, """case when length(username) >= 2 and left(username, 1) = right(username, 1) and left(username, 1) in ('"', '''') then substring(username, 2, length(username) - 2) else username end""")
_each("L8_nfc", "ulp_exposures", "exposure_id", "username", text.nfc, "nfc_normalize(username)")
_each("L9_printable", "ulp_records", "record_id", "username", lines.printable, r"regexp_replace(username, '[^\x20-\x7E]', '', 'g')")
_each("L10_controls", "ulp_records", "record_id", "username", lines.drop_controls, r"regexp_replace(username, '[\x00-\x08\x0a-\x1f\x7f-\x{9f}]', '', 'g')")
query(
    "L11_guard",
    _LINES + r"select doc_id, line_no, regexp_replace(case when regexp_matches(line, '^[=+@-]') then '''' || line else line end, '[\x00-\x08\x0a-\x1f\x7f-\x{9f}]', '', 'g') as result from l",
)(lambda s, d: _lines(s, d).select("doc_id", "line_no", lines.guard_cell(F.col("line")).alias("result")))
_each("L12_shape", "ulp_records", "record_id", "url", lines.shape, _SHAPE.format("url"))
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})\.){3}0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:[:/].*)?$"
query("L13_shape_or_ip", _LINES + f"select doc_id, line_no, case when {_SHAPE.format('line')} = 'unknown' and regexp_matches(line, '{_OCTETS}') then 'ip_first' else {_SHAPE.format('line')} end as result from l")(
    lambda s, d: _lines(s, d).select("doc_id", "line_no", lines.shape_or_ip(F.col("line")).alias("result"))
)
_each("L15_line_scheme", "ulp_records", "record_id", "url", lambda c: urls.line_scheme(urls.scheme(c)), _SCHEME.format("url") + " in (" + ", ".join(f"'{x}'" for x in urls.LINE_SCHEMES) + ")")

# ---------------------------------------------------------------- 2.3 parsing and extraction

query("P1_patterns")(lambda s, d: s.createDataFrame([("url", text.url_pattern()), ("email", text.email_pattern())], "name string, pattern string"))
#: RE2 looks neither ahead nor repeats more than 1000 times: a port counts with what follows it, which is not taken along.
_IN_URL = r"[^\s@,|{}\\:/?#]+"
_ON_URL = r"[^\s@,|{}\\:]"
_START = "(?i)(?:" + "|".join(text.FIND_SCHEMES) + ")://" + _IN_URL
_PATH = "[/?#]" + f"{_ON_URL}{{0,1000}}" * 2 + f"{_ON_URL}{{0,48}}"
_FIND = (f"({_START}(?::[0-9]{{1,5}})?{_PATH})|({_START}:[0-9]{{1,5}})(?:[\\s\"'<>,|;)\\]]|$)|({_START})").replace("'", "''")
query("P2_first_url", f"with u as (select raw_id, coalesce(nullif(regexp_extract(raw, '{_FIND}', 1), ''), nullif(regexp_extract(raw, '{_FIND}', 2), ''), nullif(regexp_extract(raw, '{_FIND}', 3), '')) as url from ulp_raw) select * from u where url is not null")(
    lambda s, d: table(s, d, "ulp_raw").select("raw_id", text.first_url(F.col("raw")).alias("url")).where("url is not null")
)
query(
    "P3_entropy",
    """
    with c as (select record_id, unnest(string_split(username, '')) as ch, length(username) as n from ulp_records where username <> ''),
    f as (select record_id, ch, count(*)::double / max(n) as p from c where ch <> '' group by record_id, ch),
    h as (select record_id, sum(-p * log2(p)) as h from f group by record_id)
    select record_id, case when username is null then null else round(coalesce(h, 0), 6) end as result from ulp_records left join h using (record_id)""",
)(lambda s, d: table(s, d, "ulp_records").select("record_id", F.round(lines.entropy(F.col("username")), 6).alias("result")))
query("P4_email", _LINES + rf"select doc_id, line_no from l where regexp_matches(line, '{text.EMAIL}')")(lambda s, d: _lines(s, d).where(text.has_email(F.col("line"))).select("doc_id", "line_no"))
_RED = "text"
for _, _pattern, _marker, _ in text.REDACTIONS:
    _RED = f"regexp_replace({_RED}, '{_pattern.replace(chr(39), chr(39) * 2)}', '{_marker.replace('$', chr(92))}', 'g')"
_BITS = "list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: -((length(x) - length(replace(x, c, '')))::double / length(x)) * log2((length(x) - length(replace(x, c, '')))::double / length(x))))"
_TOKENS = f"list_filter(list_distinct(regexp_extract_all(t, '{text.TOKEN}')), lambda x: regexp_matches(x, '[A-Z]') and regexp_matches(x, '[a-z]') and regexp_matches(x, '[0-9]') and not regexp_matches(x, '{text._WORDY}') and {_BITS} >= {text.TOKEN_BITS})"
_REDACTED = f"""
with r as (select doc_id, {_RED} as t from documents), k as (select doc_id, t, list_reverse(list_sort(list_transform({_TOKENS}, lambda x: {{'n': length(x), 't': x}}))) as tokens from r),
e as (select doc_id, list_reduce(list_prepend(t, list_transform(tokens, lambda x: x.t)), lambda a, x: replace(a, x, '[TOKEN]')) as t from k) """
query("R1_redacted", _REDACTED + "select doc_id, t as redacted from e")(lambda s, d: table(s, d, "documents").select("doc_id", text.redact(F.col("text")).alias("redacted")))
query("R2_redactions", _REDACTED + "select " + ", ".join(rf"sum(len(regexp_extract_all(t, '\[{k}\]')))::bigint as n_{k.lower()}" for k in text.KINDS) + " from e")(
    # exploding an array of one keeps the redaction from being repeated by each count
    lambda s, d: table(s, d, "documents").select(F.explode(F.array(text.redact(F.col("text")))).alias("t")).select(*[c.alias(k) for k, c in text.redaction_counts(F.col("t")).items()]).agg(*[F.sum(k.lower()).alias(f"n_{k.lower()}") for k in text.KINDS])
)
#: RE2 has no other need than Java here, so both take the same patterns; what they are to find is in tests/test_lines.py.
_JOINED = " or ".join(f"regexp_matches(raw, '{p}')" for p in text.CREDENTIALS)
query("R3_credential_lines", f"select raw_id from ulp_raw where {_JOINED}")(lambda s, d: table(s, d, "ulp_raw").where(text.credential_line(F.col("raw"))).select("raw_id"))

# ---------------------------------------------------------------- 2.4 URL, host and e-mail

_U1 = f"case when lower(regexp_extract(url, '(?s)^(.*?)://', 1)) in ({_SCHEMES}) then lower(regexp_extract(url, '(?s)^(.*?)://', 1)) || substring(url, length(regexp_extract(url, '(?s)^(.*?)://', 1)) + 1) else url end"
_each("U1_scheme_case", "ulp_records", "record_id", "url", urls.lower_scheme, _U1)
query("U2_unknown_scheme", f"select record_id, url from ulp_records where url is not null and coalesce({_SCHEME.format('url')} not in ({_SCHEMES}), true)")(
    lambda s, d: table(s, d, "ulp_records").where(F.col("url").isNotNull() & ~urls.known_scheme(F.col("url"))).select("record_id", "url")
)
_each("U3_scheme", "ulp_records", "record_id", "url", urls.scheme, _SCHEME.format("url"))
_U4 = _T("case when contains({0}, '://') then lower(regexp_replace(regexp_replace(regexp_extract({0}, '(?s)^.*?://([^/]*)', 1), '(?s)^.*@', ''), ':[0-9]*$', '')) else lower({0}) end")
_each("U4_host", "ulp_records", "record_id", "url", urls.host, _U4.format("url"))
_U5 = _T(r"""case when regexp_matches({0}, '(?i)^http://[^/:]+:80([^0-9]|$)') then regexp_replace({0}, '(?i)^http://([^/:]+):80', 'http://\1')
  when regexp_matches({0}, '(?i)^https://[^/:]+:443([^0-9]|$)') then regexp_replace({0}, '(?i)^https://([^/:]+):443', 'https://\1') else {0} end""")
_each("U5_default_port", "ulp_records", "record_id", "url", urls.strip_default_port, _U5.format("url"))
_each("U6_no_path", "ulp_records", "record_id", "url", urls.strip_path, r"regexp_replace(url, '^([A-Za-z0-9_]+://[^/]+)/[^\n]*$', '\1')")
_U7 = _T("case when contains({0}, '://') then regexp_extract({0}, '(?s)^(.*?://)[^/]*', 1) || lower(regexp_extract({0}, '(?s)^.*?://([^/]*)', 1)) || substring({0}, length(regexp_extract({0}, '(?s)^(.*?://[^/]*)', 1)) + 1) else {0} end")
_each("U7_host_case", "ulp_records", "record_id", "url", urls.lower_host, _U7.format("url"))
_MAIL = rf"regexp_replace({_TRIM.format('username')}, '{_W}*@{_W}*', '@', 'g')"
query(
    "U8_email",
    rf"""
    with m as (select record_id, {_MAIL} as j from ulp_records where contains(username, '@')),
    c as (select record_id, left(j, strpos(j, '@')) || lower(regexp_replace(substring(j, strpos(j, '@') + 1), '{_W}*\.{_W}*', '.', 'g')) as e from m)
    select record_id, substring(e, strpos(e, '@') + 1) as domain, {_hmac('e')} as address_hmac from c""",
)(
    lambda s, d: table(s, d, "ulp_records").where(F.col("username").contains("@")).select("record_id", urls.email_domain(F.col("username")).alias("domain"), text.keyed_hash(urls.clean_email(F.col("username")), KEY).alias("address_hmac"))
)
_CLEAN = _U7.format("(" + _U5.format("(" + _U1 + ")") + ")")
_each("U_clean", "ulp_records", "record_id", "url", urls.clean, _CLEAN, "clean_url")

# ---------------------------------------------------------------- 2.5 predicates

_each("V1_url_bytes", "ulp_records", "record_id", "url", lambda c: F.octet_length(c) <= 2048, "octet_length(encode(url)) <= 2048")
_VALID = _T(r"(octet_length(encode({0})) <= 2048 and regexp_matches({0}, '(?s)^[A-Za-z0-9_]+://[A-Za-z0-9.\-]+(:[0-9]{1,5})?(/.*)?$'))")
_each("V2_url_pattern", "ulp_records", "record_id", "url", parse.valid_url, _VALID.format("url"))
_each("V3_length", "ulp_records", "record_id", "username", lambda c: urls.fits(c, 1, 128), "octet_length(encode(username)) between 1 and 128")
query("V5_no_url", f"select record_id from ulp_records where url is null or {_BLANK.format('url')}")(lambda s, d: table(s, d, "ulp_records").where(~F.coalesce(urls.present(F.col("url")), F.lit(False))).select("record_id"))
_URL_REASON = f"case when url is null or {_BLANK.format('url')} then 'empty' when octet_length(encode(url)) > 2048 then 'too_long' when coalesce({_SCHEME.format('url')} not in ({_SCHEMES}), true) then 'scheme' when not {_VALID.format('url')} then 'pattern' end"
query("V_url_reasons", f"with j as (select {_URL_REASON} as reject_reason from ulp_records) select reject_reason, count(*) as n from j where reject_reason is not null group by reject_reason")(
    lambda s, d: validate.by_reason(table(s, d, "ulp_records").withColumn("reject_reason", validate.url_reason(F.col("url"), known_only=True)))
)

# ---------------------------------------------------------------- 2.6 aggregation and dedup

query(
    "A1_counts",
    f"""
    with j as (select url, case when url is null or {_BLANK.format("url")} then 'empty' when octet_length(encode(url)) > 2048 then 'too_long' when not {_VALID.format("url")} then 'pattern' end as r from ulp_records)
    select count(*) as n_lines, count(*) filter (r is null) as n_kept, count(*) filter (r = 'empty') as n_empty, count(*) filter (r <> 'empty') as n_rejected, sum(octet_length(encode(url)))::bigint as n_bytes from j""",
)(lambda s, d: validate.run_statistics(table(s, d, "ulp_records").select("url", validate.url_reason(F.col("url")).alias("reject_reason")), "url"))
query("A2_reasons", _JUDGED + "select reject_reason, count(*) as n from j where reject_reason is not null group by reject_reason")(lambda s, d: validate.by_reason(_lines(s, d)))
query(
    "A3_first_url",
    f"""
    with k as (select *, {_CLEAN} as k from ulp_records)
    select record_id, url, source_id, line_no from k qualify row_number() over (partition by k order by source_id nulls first, line_no nulls first, record_id) = 1""",
)(lambda s, d: dedup.keep_first(table(s, d, "ulp_records").select("record_id", "url", "source_id", "line_no"), urls.clean(F.col("url")), ["source_id", "line_no", "record_id"]))
_CONTENT = r"sha256(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '" + rf"^{_W}+|{_W}+$" + "', '', 'g'))"
query("A3_content", f"select {_CONTENT} as key, min(doc_id) as first, count(*) as n_copies from documents group by 1")(
    lambda s, d: dedup.copies(table(s, d, "documents"), F.sha2(lines.trim(lines.line_ends(F.col("text"))), 256), "doc_id")
)
query(
    "A_hosts",
    f"""
    with c as (select {_CLEAN} as url from ulp_records), v as (select url from c where {_VALID.format("url")})
    select {_U4.format("url")} as host, count(*) as n_urls from v group by 1""",
)(  # exploding an array of one keeps the cleaning from being repeated by what follows
    lambda s, d: table(s, d, "ulp_records").select(F.explode(F.array(urls.clean(F.col("url")))).alias("url")).where(parse.valid_url(F.col("url"))).groupBy(urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n_urls")))

# ---------------------------------------------------------------- streams

_AUTH = _T(r"nullif(lower(regexp_replace(regexp_replace(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), '(?s)^.*@', ''), ':[0-9]*$', '')), '')")


@query(
    "T1_stream_urls",
    f"""
    with c as (select record_id, {_CLEAN} as clean_url from ulp_records)
    select record_id, clean_url, {_AUTH.format("clean_url")} as host,
      case when clean_url is null or {_BLANK.format("clean_url")} then 'empty' when octet_length(encode(clean_url)) > 2048 then 'too_long' when not {_VALID.format("clean_url")} then 'pattern' end as reject_reason from c""",
)
def _stream_urls(s: SparkSession, d: str) -> DataFrame:
    schema = table(s, d, "ulp_records").schema
    return hygiene.drain(hygiene.clean_urls(hygiene.read(s, f"{d}/ulp_records.parquet", schema), ["record_id"]), "urls")


@query("T2_stream_dedup", "select distinct user_id, event_type from events")
def _stream_dedup(s: SparkSession, d: str) -> DataFrame:
    rows = hygiene.read(s, f"{d}/events.parquet", table(s, d, "events").schema).select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return hygiene.drain(hygiene.dedup(rows, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type"), "events")


@query("T3_stream_windows", "select date_trunc('day', ts)::timestamp as window_start, event_type, count(*) as n from events where ts is not null group by 1, 2")
def _stream_windows(s: SparkSession, d: str) -> DataFrame:
    rows = hygiene.read(s, f"{d}/events.parquet", table(s, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return hygiene.drain_last(hygiene.windowed_counts(rows, "ts", "1 hour", "1 day", "event_type"), "windows", ["window_start", "event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
