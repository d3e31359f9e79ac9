"""Problem 6: rows that fail to parse, apart with the reason, and the valid ones typed.

The line is read permissively under an explicit schema that retains corrupt text. Lines that the
reader calls corrupt are taken apart again and reclassified: quoting, then number of columns, then
casts and checks of values. Of lines that it could read, the typed fields are checked by the rules,
and the raw text for what the reader forgives (a quote inside an unquoted field, a sign before a
number, the 30th of February). All of it is built-in expressions over one row; no shuffle.

Defined results: a null line has no fields, hence ``columns``; so has an empty one (one empty
field); lines of any length are judged whole; duplicates are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Typed fields of a good line; digits beyond 38 do not fit a number and come out null.
LINE_SCHEMA = "url string, username string, first_seen timestamp_ntz, source_id decimal(38,0), hits decimal(38,0)"
FIELDS = ("url", "username", "first_seen", "source_id", "hits")
#: A line with as many commas or more is not given to the reader; it cannot be one of five fields but inside quotes.
READER_COLUMNS = 1024
_FIELD = r'"(?:[^"]|"")*+"|[^",]*+'
WELL_QUOTED = rf"(?s)^(?:{_FIELD})(?:,(?:{_FIELD}))*+\z"
EACH_FIELD = rf'(?s),("(?:[^"]|"")*+"|[^",]*+)'
#: Fixed: the rule of V2; \w is restricted to ASCII.
URL_RULE = r"(?s)^[\w&&[^\x80-\x{10FFFF}]]+://[A-Za-z0-9.\-]+(?::[0-9]{1,5})?(?:/.*)?\z"
_TIME = "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
#: The last three fields as they must stand in a line, quoted or not.
TAIL_RULE = rf'(?s),("?)({_TIME})\1,("?)[0-9]*\3,("?)[0-9]*[1-9][0-9]*\4\z'
TIME_RULE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\z"


def split_fields(line: Column) -> Column:
    """Array of the unquoted fields of a well-quoted CSV line."""
    # a comma in front makes every match begin with one, so that none is empty
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(EACH_FIELD), 1)
    return F.transform(raw, lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def valid_url(url: Column, max_bytes: int = 2048) -> Column:
    """Scheme of word characters, ://, host of ASCII letters, digits, dots and hyphens, port, path; at most max_bytes."""
    return (F.octet_length(url) <= max_bytes) & url.rlike(URL_RULE)


def valid_time(text: Column) -> Column:
    return text.rlike(TIME_RULE) & F.try_to_timestamp(F.replace(text, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()


def classify(lines: DataFrame, raw_col: str = "raw") -> DataFrame:
    """The rows with ``record`` (typed struct) and ``reason_code`` (null for good lines)."""
    raw = F.col(raw_col)
    # the reader stops the job at a line of more columns than it was told, so such a line goes to the second look at once
    readable = F.when(F.length(raw) - F.length(F.replace(raw, F.lit(","), F.lit(""))) < READER_COLUMNS, raw)
    read = F.from_csv(readable, F.lit(f"{LINE_SCHEMA}, corrupt string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "maxColumns": str(READER_COLUMNS), "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"})
    # exploding an array of one keeps filters above from being pushed into, and so repeating, what is exploded
    out = lines.withColumn("record", F.explode(F.array(read)))
    r = F.col("record")
    # of a line without any text the reader makes a row of nulls, and it drops NUL, without calling either corrupt
    corrupt = r.isNull() | r["corrupt"].isNotNull() | raw.rlike(r"\p{Cc}") | (r["url"].isNull() & r["username"].isNull() & r["first_seen"].isNull())
    quoted = raw.rlike(WELL_QUOTED)
    out = out.withColumn("_fields", F.explode(F.array(F.when(corrupt & quoted, split_fields(raw)))))
    typed = valid_url(r["url"]) & F.octet_length(r["username"]).between(1, 128) & valid_time(F.regexp_extract(raw, TAIL_RULE, 2))
    f = [F.element_at("_fields", k + 1) for k in range(5)]
    again = (
        valid_url(f[0])
        & F.octet_length(f[1]).between(1, 128)
        & ~f[1].rlike(r"\p{Cc}")
        & valid_time(f[2])
        & f[3].rlike(r"^[0-9]*\z")
        & f[4].rlike(r"^[0-9]*[1-9][0-9]*\z")
    )
    forgiven = F.when(~quoted, "quoting").when(~F.coalesce(typed, F.lit(False)), "value")
    reclassified = F.when(F.col("_fields").isNull(), "quoting").when(F.size("_fields") != 5, "columns").when(~F.coalesce(again, F.lit(False)), "value")
    reason = F.when(raw.isNull(), "columns").when(corrupt, reclassified).otherwise(forgiven)
    return out.withColumn("reason_code", F.explode(F.array(reason)))


def bad_lines(lines: DataFrame, id_col: str, raw_col: str = "raw") -> DataFrame:
    """(id, reason_code) of every line that is no valid record; the raw text itself is not handed on."""
    return classify(lines.select(id_col, raw_col), raw_col).where(F.col("reason_code").isNotNull()).select(id_col, "reason_code")


def good_lines(lines: DataFrame, id_col: str, raw_col: str = "raw") -> DataFrame:
    """The valid lines as typed rows: the id and the five fields.

    A good line that the reader could not take in (digits beyond its number type) gets its fields from the second look.
    """
    rows = classify(lines.select(id_col, raw_col), raw_col).where(F.col("reason_code").isNull())
    f = [F.element_at("_fields", k + 1) for k in range(5)]
    time = F.try_to_timestamp(F.replace(f[2], F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    again = [f[0], f[1], time, f[3].try_cast("decimal(38,0)"), f[4].try_cast("decimal(38,0)")]
    return rows.select(id_col, *[F.when(F.col("_fields").isNotNull(), a).otherwise(F.col(f"record.{n}")).alias(n) for n, a in zip(FIELDS, again, strict=True)])
