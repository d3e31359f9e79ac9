"""Bytes to text: byte order marks (S2), labels (S3), detection (S4), lossy decoding."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from limpid.functions import charset

SAMPLE_BYTES = 8192
FALLBACK = "utf-8"


def bom(content: Column) -> Column:
    """Utf-8, utf-16le or utf-16be by its byte order mark, else null; takes priority over everything."""
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head.startswith("EFBBBF"), "utf-8").when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be")


def resolve_label(label: str | None) -> str:
    """S3: the codec of a label; UTF-8 for an unknown one."""
    try:
        return codecs.lookup((label or "utf-8").strip().lower()).name
    except LookupError:
        return "utf-8"


#: Fixed: names of the charsets that the JVM decodes.
LABELS = {
    "utf-8": "utf-8", "utf8": "utf-8", "windows-1252": "windows-1252", "cp1252": "windows-1252", "latin-1": "iso-8859-1", "iso-8859-1": "iso-8859-1", "windows-1251": "windows-1251", "cp1251": "windows-1251",
    "utf-16le": "utf-16le", "utf-16-le": "utf-16le", "utf-16be": "utf-16be", "utf-16-be": "utf-16be", "us-ascii": "us-ascii", "gbk": "gbk", "shift_jis": "shift_jis", "koi8-r": "koi8-r", "iso-8859-15": "iso-8859-15",
}


def resolved(label: Column) -> Column:
    """S3 as an expression: the name of the charset of a label, letter case aside; utf-8 for null or unknown ones."""
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(label))), F.lit("utf-8"))


def detect_bytes(content: bytes | None, label: str = "auto", sample: int = SAMPLE_BYTES, fallback: str = FALLBACK) -> tuple[str | None, bool, bool]:
    """(encoding, had_bom, confident). BOM, then a forced label, then UTF-8, then what the bytes look like, then the fallback.

    Whether a charset fits is judged on the whole content; which of those that fit is likeliest by a sample, from the first byte beyond ASCII on.
    """
    if content is None:
        return None, False, False
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be")):
        if content.startswith(mark):
            return name, True, True
    if label != "auto":
        return resolve_label(label), False, True
    if charset.plain(content):
        return "utf-8", False, True
    name, sure = charset.guess(content, sample)
    return (name, False, sure) if name else (fallback, False, False)


def detected(content: Column, label: str = "auto", sample: int = SAMPLE_BYTES, fallback: str = FALLBACK) -> Column:
    """S4 as struct<encoding, had_bom, confident>: the same as detect_bytes. What is plain UTF-8 or bears a mark stays in the JVM."""
    mark = bom(content)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            found = [detect_bytes(None if v is None else bytes(v), "auto", sample, fallback) for v in values]
            yield pd.DataFrame({"encoding": [f[0] for f in found], "confident": [f[2] for f in found]})

    if label != "auto":
        name, sure = F.lit(resolve_label(label)), F.lit(True)
    else:
        text = content.cast("string")
        plain = F.is_valid_utf8(text) & ~text.rlike(r"[\x00-\x08\x0E-\x1A]")
        other = F.pandas_udf(run, "encoding string, confident boolean")(F.when(~plain & mark.isNull(), content))
        name, sure = F.when(plain, "utf-8").otherwise(other["encoding"]), plain | other["confident"]
    name, sure = F.when(content.isNotNull(), F.coalesce(mark, name)), mark.isNotNull() | F.coalesce(sure & content.isNotNull(), F.lit(False))
    return F.struct(name.alias("encoding"), mark.isNotNull().alias("had_bom"), sure.alias("confident"))


def decode_utf8(content: Column) -> Column:
    """S5 for UTF-8: text with U+FFFD for bad bytes."""
    return F.make_valid_utf8(content.cast("string"))


def decode_lossy(content: Column, encoding: Column) -> Column:
    """S5 for any charset, without the byte order mark."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, names in batches:
            yield pd.Series([None if v is None else v.decode(resolve_label(n), errors="replace").removeprefix("﻿") for v, n in zip(values, names, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(content, encoding)
