"""Line hygiene: pure Column -> Column. Null in, null out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: what opens a line that begins with a URL.
URL_PREFIXES = (
    "https://", "http://", "ftp://", "ftps://", "sftp://", "ssh://", "smtp://", "smtps://", "imap://", "imaps://", "pop3://", "pop://", "irc://",
    "telnet://", "android://", "mysql://", "mssql://", "postgresql://", "redis://", "mongodb://", "ldap://", "vnc://", "rdp://", "socks5://", "socks4://",
)
#: Fixed: lines that are nothing but a scheme (L4).
BARE_SCHEMES = (
    "https://", "http://", "ftp://", "ftps://", "sftp://", "pop3://", "pop://", "smtp://", "imap://", "irc://", "ssh://", "telnet://",
)
#: Fixed: defaults of L6 and L5.
SKIP_PREFIXES = ("#", "//", "--")
MAX_LINE_BYTES = 4096


def line_ends(text: Column) -> Column:
    """L1: CRLF and CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def trim(text: Column) -> Column:
    """L2: without white space of any script at both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+\z", "")


def not_empty(text: Column) -> Column:
    """L3: False for empty lines, which are dropped without counting as rejected."""
    return text != ""


def bare_scheme(text: Column) -> Column:
    """L4, its generic half: nothing but a scheme."""
    return F.lower(text).isin(*BARE_SCHEMES)


def too_long(text: Column, most: int = MAX_LINE_BYTES) -> Column:
    """L5, in bytes."""
    return F.octet_length(text) > most


def skipped(text: Column, prefixes: tuple[str, ...] = SKIP_PREFIXES) -> Column:
    """Begins with a prefix of comments or headings."""
    out = F.lit(False)
    for p in prefixes:
        out = out | text.startswith(p)
    return out


def unquote(text: Column) -> Column:
    """Without one pair of equal quotes around the whole; a single quote mark stays."""
    return F.regexp_replace(text, r"""(?s)^(["'])(.*)\1\z""", "$2")


def printable(text: Column) -> Column:
    """Only the characters from space to tilde."""
    return F.regexp_replace(text, r"[^\x20-\x7E]", "")


def drop_controls(text: Column) -> Column:
    """Without NUL and control characters other than tab."""
    return F.regexp_replace(text, r"[\p{Cc}&&[^\t]]", "")


def guard_cell(text: Column) -> Column:
    """Trimmed, with a quote before what a spreadsheet would take for a formula, without control characters."""
    trimmed = trim(text)
    return drop_controls(F.when(trimmed.rlike(r"^[=+@-]"), F.concat(F.lit("'"), trimmed)).otherwise(trimmed))


_URL_FIRST = "(?i)^(?:" + "|".join(p.removesuffix("://") for p in URL_PREFIXES) + ")://"


def _shape(text: Column, ip: Column | None = None) -> Column:
    out = (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(F.octet_length(text) < 4, "unknown")
        .when(text.rlike(_URL_FIRST), "url_first")
        .when(text.rlike(r"(?i)^www\."), "www_first")
        .when(text.startswith("//"), "slash_slash")
        .when(text.rlike(r"(?s)^\.[^./]"), "leading_dot")
    )
    return (out if ip is None else out.when(ip, "ip_first")).otherwise("unknown")


def shape(text: Column) -> Column:
    """url_first, www_first, slash_slash, leading_dot or unknown; lines under 4 bytes are unknown."""
    return _shape(text)


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def shape_or_ip(text: Column) -> Column:
    """As shape(), but ip_first where a line of no other shape begins with an IPv4 address up to a colon, slash or the end."""
    return _shape(text, text.rlike(rf"(?s)^(?:{_OCTET}\.){{3}}{_OCTET}(?:[:/].*)?\z"))


def reject_reason(line: Column, most: int = MAX_LINE_BYTES, prefixes: tuple[str, ...] = SKIP_PREFIXES) -> Column:
    """The first reason to drop a trimmed line, null for lines kept: empty, bare_scheme, too_long, prefix."""
    return F.when(line == "", "empty").when(bare_scheme(line), "bare_scheme").when(too_long(line, most), "too_long").when(skipped(line, prefixes), "prefix")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty text. A signal for redaction.

    The characters are put in order and the lengths of their runs summed up in one pass, so that the cost is that of
    sorting, however many different ones there are.
    """
    n = F.length(text)
    state = F.struct(F.lit(0.0).alias("sum"), F.lit("").alias("last"), F.lit(0.0).alias("run"))

    def term(run: Column) -> Column:
        return F.when(run > 0, (run / n) * F.log2(run / n)).otherwise(0.0)

    def step(s: Column, c: Column) -> Column:
        same = s["last"] == c
        return F.struct(F.when(same, s["sum"]).otherwise(s["sum"] - term(s["run"])).alias("sum"), c.alias("last"), F.when(same, s["run"] + 1.0).otherwise(1.0).alias("run"))

    each = F.filter(F.array_sort(F.split(text, "")), lambda c: c != "")
    return F.when(n == 0, 0.0).when(n > 0, F.aggregate(each, state, step, lambda s: s["sum"] - term(s["run"])))
