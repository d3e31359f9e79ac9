"""Patterns (P1, P2, P4), Unicode NFC (L8), keyed hashes and redaction."""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from limpid.functions import lines

#: Fixed: the default pattern of an e-mail address.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
#: Finds the same as EMAIL: only where a run of its characters begins, and without going back in it.
_EMAIL_ONCE = r"(?<![a-zA-Z0-9._%+\-])[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
#: Fixed: schemes of URLs that are looked for in lines.
FIND_SCHEMES = (
    "http", "https", "ftp", "ftps", "sftp", "android", "socks5", "socks4", "ssh", "mysql", "mssql", "postgresql", "redis", "smtp", "imap", "pop3", "ldap", "vnc", "rdp", "telnet", "mongodb",
)


#: What a URL in running text ends at.
_NOT_URL = r"\s@,|{}\\:"


def url_pattern(schemes: tuple[str, ...] | None = FIND_SCHEMES, override: str | None = None, most: int | None = 2048) -> str:
    """The pattern of a URL in running text, from configuration; an override is taken as it is and must compile.

    A colon belongs to a URL only before a port, so that what is joined to it by colons is no part of it. Without
    schemes any is found, without most a path of any length.
    """
    scheme = "[a-z][a-z0-9+.\\-]*+" if schemes is None else f"(?:{'|'.join(map(re.escape, schemes))})"
    port = r"(?::[0-9]{1,5}(?=[/?#\s\"'<>,|;)\]]|$))?"
    pattern = override or rf"(?i){scheme}://[^{_NOT_URL}/?#]++{port}(?:[/?#][^{_NOT_URL}]{{0,{most or ''}}})?"
    re.compile(pattern)
    return pattern


def email_pattern(override: str | None = None) -> str:
    """The pattern of an e-mail address."""
    pattern = override or EMAIL
    re.compile(pattern)
    return pattern


def first_url(line: Column, pattern: str | None = None) -> Column:
    """The first URL of a line, null without one."""
    return F.nullif(F.regexp_extract(line, pattern or url_pattern(), 0), F.lit(""))


def has_email(line: Column, pattern: str | None = None) -> Column:
    """P4."""
    return line.rlike(pattern or _EMAIL_ONCE)


def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield values.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode NFC. Texts without a character that could combine or change are not sent to Python."""
    stable = text.rlike(r"^[\x00-\x{2FF}]*\z")
    return F.when(stable, text).otherwise(F.pandas_udf(_nfc, "string")(F.when(~stable, text)))


def keyed_hash(text: Column, key: str) -> Column:
    """HMAC-SHA256 in hexadecimal digits: without the key a short text cannot be guessed from it. Null for null."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    outer, inner = (F.lit(bytearray(x ^ pad for x in raw)) for pad in (0x5C, 0x36))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)


#: Order matters: what is replaced first is not looked at again. Kind, pattern, marker, and what every match contains (any of several).
REDACTIONS = (
    ("URL_LOGIN", r"://[^\s/@:]+:[^\s/@]+@", "://[URL_LOGIN]@", ("@",)),
    ("EMAIL", EMAIL, "[EMAIL]", ("@",)),
    ("JOINED", r"\[EMAIL\]([:;|])[^\s,\"'<>()\[\]]+", "[EMAIL]$1[JOINED]", ("[EMAIL]",)),
    ("SECRET", r"""(?i)((?:password|passwd|pwd|secret|token|api_?key)["']?\s*[:=]\s*["']?)[^\s"',;]{4,}""", "$1[SECRET]", (":", "=")),
    ("BEARER", r"(?i)\b(bearer\s+)[a-z0-9._~+/\-]{16,}=*", "$1[BEARER]", ("earer", "EARER")),
    ("CARD", r"\b(?:[0-9]{4}[ \-]){3}[0-9]{4}\b", "[CARD]", ()),
    ("IPV4", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[IPV4]", (".",)),
    ("PHONE", r"\+[0-9]{1,3}[ \-]?(?:\([0-9]{1,4}\)[ \-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}\b", "[PHONE]", ("+",)),
)
#: The same by one first letter instead of seven words tried at every place.
_FASTER = {
    REDACTIONS[3][1]: r"""(?i)([psta](?:(?<=p)assword|(?<=p)asswd|(?<=p)wd|(?<=s)ecret|(?<=t)oken|(?<=a)pi_?key)["']?\s*[:=]\s*["']?)[^\s"',;]{4,}""",
}
#: Tokens of a random look: so long, of capital and small letters and digits, of so many bits a character at least.
TOKEN, TOKEN_BITS = r"[A-Za-z0-9+/_\-]{24,}", 4.0
#: Holds a text a token of capitals, small letters and digits at all? Most long tokens are hashes of small letters only.
_MAY_BE_TOKEN = r"(?<![A-Za-z0-9+/_\-])(?=[a-z0-9+/_\-]*[A-Z])(?=[A-Z0-9+/_\-]*[a-z])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{24}"
#: A path is no token: with so many parts of letters only.
_WORDY = r"(?:^|[/_\-])[A-Za-z]{4,}(?:[/_\-]|$)"


def _random_tokens(text: Column) -> Column:
    """The tokens of a random look, longest first, so that one inside another is replaced with it."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1))
    # a commit's hash is of small letters only, a path is of words
    mixed = F.filter(found, lambda t: t.rlike("[A-Z]") & t.rlike("[a-z]") & t.rlike("[0-9]") & ~t.rlike(_WORDY))
    kept = F.filter(mixed, lambda t: lines.entropy(t) >= TOKEN_BITS)
    return F.transform(F.sort_array(F.transform(kept, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))), asc=False), lambda x: x["t"])


def redact(text: Column, email: str | None = None) -> Column:
    """Secrets, login parts of URLs, what is joined to addresses, tokens of a random look and simple personal data replaced by fixed markers.

    Runs before any sink. email overrides the pattern of addresses. A pattern is tried only on texts that hold what every match contains.
    """

    def one(pattern: str, marker: str, holds: tuple[str, ...]) -> Callable[[Column], Column]:
        found = email or _EMAIL_ONCE if pattern == EMAIL else _FASTER.get(pattern, pattern)

        def use(t: Column) -> Column:
            replaced = F.regexp_replace(t, found, marker)
            may = functools.reduce(lambda a, b: a | b, [t.contains(h) for h in holds]) if holds and not (pattern == EMAIL and email) else None
            return replaced if may is None else F.when(may, replaced).otherwise(t)

        return use

    for _, pattern, marker, holds in REDACTIONS:
        text = lines.once(text, one(pattern, marker, holds))
    tokens = lambda t: F.aggregate(_random_tokens(t), t, lambda out, x: F.replace(out, x, F.lit("[TOKEN]")))
    return lines.once(text, lambda t: F.when(t.rlike(_MAY_BE_TOKEN), tokens(t)).otherwise(t))


#: Lines in which a site, a name and a secret are joined: detected and set aside whole, never taken apart.
_FIELD = r"[^\s:;|]+"
CREDENTIALS = (
    rf"://[^\s:;|]+(?::[0-9]{{1,5}})?(?:/[^\s:;|]*)?[:;|]\s?{_FIELD}\s?[:;|]\s?\S",  # url:name:secret
    rf"(?:^|\s){_FIELD}[:;|]\s?{_FIELD}[:;|]\s?(?:[A-Za-z][A-Za-z0-9+.\-]*://|www\.)",  # name:secret:url
    rf"^(?:www\.)?[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{{2,}}(?:/[^\s:;|]*)?[:;|]{_FIELD}[:;|]\S+$",  # host:name:secret
    r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}[:;|,\t ]\s?\S+$",  # address:secret
    r"^[A-Za-z][A-Za-z0-9+.\-]*://[^\s|;,]+[|;,\t ]\s?[^\s|;,]+[|;,\t ]\s?[^\s|;,]+$",  # url name secret, in three fields
    r"^[^\s|;,]+[|;,\t]\s?[^\s|;,]+[|;,\t]\s?[A-Za-z][A-Za-z0-9+.\-]*://[^\s|;,]+$",  # name secret url
    r"^[^\s|;,]+ [^\s|;,]*[0-9][^\s|;,]* [A-Za-z][A-Za-z0-9+.\-]*://[^\s|;,]+$",  # the same with blanks, unless the second is a plain word
)


def credential_line(line: Column) -> Column:
    """Does a line look like a record of a site, an account and its secret?"""
    return line.rlike("|".join(f"(?:{p})" for p in CREDENTIALS))


KINDS = (*[r[0] for r in REDACTIONS], "TOKEN")


def redaction_counts(redacted: Column) -> dict[str, Column]:
    """How many markers of each kind a redacted text holds."""
    return {kind.lower(): F.regexp_count(redacted, F.lit(rf"\[{kind}\]")) for kind in KINDS}
