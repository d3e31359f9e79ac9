"""URL, host and e-mail functions: pure Column -> Column, inside whole-stage code generation.

Null in, null out; an empty string stays empty unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: schemes whose case is normalised.
SCHEMES = (
    "http", "https", "ftp", "ftps", "sftp", "android", "socks5", "socks4", "ssh", "mysql", "mssql", "postgresql", "redis", "smtp", "smtps",
    "imap", "imaps", "pop3", "pop3s", "ldap", "ldaps", "vnc", "rdp", "telnet", "mongodb", "couchdb", "cassandra",
)
#: Fixed: schemes that may open a line.
LINE_SCHEMES = (
    "http", "https", "ftp", "ftps", "sftp", "pop3", "pop", "smtp", "smtps", "imap", "imaps", "irc", "ssh", "telnet", "android", "mysql",
    "mssql", "postgresql", "redis", "mongodb", "ldap", "vnc", "rdp",
)
BLANK = r"^[\s\p{Z}\x{85}\x{1C}-\x{1F}]*\z"


def present(c: Column) -> Column:
    """Neither null nor blank."""
    return c.isNotNull() & ~c.rlike(BLANK)


def authority_host(url: Column) -> Column:
    """What follows :// up to the next /, ?, # or the end, without login part and port, in lower case; null without :// or host."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*\z", "")), F.lit(""))


def scheme(url: Column) -> Column:
    """What stands before the first ://, in lower case; null without one or when nothing stands before it."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)), F.lit(""))


def lower_scheme(url: Column) -> Column:
    """The scheme in lower case if it is a known one, else the URL as it is."""
    found = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    return F.when(F.lower(found).isin(*SCHEMES), F.concat(F.lower(found), F.substring(url, F.length(found) + 1, F.length(url)))).otherwise(url)


def known_scheme(url: Column) -> Column:
    """Has the URL a known scheme? False without ://."""
    return F.coalesce(scheme(url).isin(*SCHEMES), F.lit(False))


def line_scheme(name: Column) -> Column:
    """Is it a scheme that may open a line, letter case aside?"""
    return F.lower(name).isin(*LINE_SCHEMES)


def host(url: Column) -> Column:
    """U4: between :// and the next /, without login part (it may hold a secret) and numeric port, in lower case.

    ? and # do not end it; without :// the whole string counts as host.
    """
    authority = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://([^/]*)", 1), r"(?s)^.*@", "")
    return F.when(url.contains("://"), F.lower(F.regexp_replace(authority, r":[0-9]*\z", ""))).otherwise(F.lower(url))


def strip_default_port(url: Column) -> Column:
    """Without :80 after http and :443 after https; the scheme of a URL so changed is lower case."""
    http = r"(?i)^http://([^/:]+):80(?![0-9])"
    https = r"(?i)^https://([^/:]+):443(?![0-9])"
    return F.when(url.rlike(http), F.regexp_replace(url, http, "http://$1")).when(url.rlike(https), F.regexp_replace(url, https, "https://$1")).otherwise(url)


def strip_path(url: Column) -> Column:
    """Scheme and host only."""
    return F.regexp_replace(url, r"^([A-Za-z0-9_]+://[^/]+)/[^\n]*\z", "$1")


def lower_host(url: Column) -> Column:
    """The host in lower case, path and scheme as they are."""
    head = F.regexp_extract(url, r"(?s)^(.*?://)[^/]*", 1)
    middle = F.regexp_extract(url, r"(?s)^.*?://([^/]*)", 1)
    rest = F.substring(url, F.length(head) + F.length(middle) + 1, F.length(url))
    return F.when(url.contains("://"), F.concat(head, F.lower(middle), rest)).otherwise(url)


def clean(url: Column) -> Column:
    """U1, U5 and U7 at once: the same as lower_host(strip_default_port(lower_scheme(url))).

    The URL is taken apart once, as nesting the three would repeat each inner expression many times.
    """
    parts = r"(?s)^(.*?)://([^/]*)(.*)\z"
    found, authority, rest = (F.regexp_extract(url, parts, k) for k in (1, 2, 3))
    low = F.lower(found)
    port = F.when(low == "http", F.regexp_replace(authority, r"^([^:]+):80(?![0-9])", "$1")).when(low == "https", F.regexp_replace(authority, r"^([^:]+):443(?![0-9])", "$1")).otherwise(authority)
    return F.when(url.contains("://"), F.concat(F.when(low.isin(*SCHEMES), low).otherwise(found), F.lit("://"), F.lower(port), rest)).otherwise(url)


_SPACE = r"[\s\p{Z}\x{85}]"


def clean_email(address: Column) -> Column:
    """U8: trimmed, no spaces around @; in the domain no spaces around dots and lower case; the local part keeps its case."""
    joined = F.regexp_replace(F.regexp_replace(address, rf"^{_SPACE}+|{_SPACE}+\z", ""), rf"{_SPACE}*@{_SPACE}*", "@")
    at = F.instr(joined, "@")
    local, domain = F.substring(joined, F.lit(1), at), F.substring(joined, at + 1, F.length(joined))
    return F.when(at > 0, F.concat(local, F.lower(F.regexp_replace(domain, rf"{_SPACE}*\.{_SPACE}*", ".")))).otherwise(F.lower(joined))


def email_domain(address: Column) -> Column:
    """The domain of a cleaned address, null without @: with a keyed hash all that is surfaced of an address."""
    cleaned = clean_email(address)
    return F.when(cleaned.contains("@"), F.regexp_extract(cleaned, r"(?s)@(.*)\z", 1))


def fits(c: Column, least: int, most: int) -> Column:
    """V3, generic: is the length in bytes within the range?"""
    return F.octet_length(c).between(least, most)
