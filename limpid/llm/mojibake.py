"""Problem 1: text that was decoded with a wrong character encoding.

Round-trip repair. A value is re-encoded under every candidate legacy encoding and strictly decoded as the
encoding it was probably written in; what decodes is taken as a candidate and treated the same way again, so
that nested layers come off one by one, however many there are: a layer makes the text shorter, which ends the
search by itself. Of all candidates the one of least garbling cost is the restored text; the value counts as
garbled if that cost lies below its own by a margin.

The unit of strict decoding is the run of characters outside ASCII, since a multi-byte sequence never reaches
into ASCII: a run decodes as a whole or not at all, and runs that do not (a quotation mark beside a garbled
word) stay. Only values for which that finds nothing go through a second, looser pass, for values that were
changed *after* they were garbled: letter case folded throughout, a no-break space made a plain one, bytes
lost. It decodes sequence by sequence; its result can differ from the original in a character.

Everything here is a pure function of one value, so the operator is a map: no shuffle, and values that are pure
ASCII never leave the JVM.

Defined results: null and empty values are clean (``None`` / unchanged); a value with U+FFFD, C1 controls or
private-use characters is garbled even when it cannot be restored (``restored`` then holds the best partial
repair); rows without an id are left out; repeated rows are each reported.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Encodings of one byte a character that UTF-8 is wrongly read as.
READ_AS = ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp1250", "cp1253")
#: (read as, written as), both of one byte a character.
LEGACY_PAIRS = (
    ("cp1252", "cp1251"), ("cp1252", "cp1253"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp866", "cp1251"),
)
#: Encodings of several bytes a character that are wrongly read as cp1252.
MULTI_BYTE = ("gbk", "shift_jis", "euc_jp", "euc_kr")
#: By how much the cost must drop: for UTF-8 read as one byte a character, for pairs of encodings, for UTF-8 read as GBK.
#: The last two are strict, since legitimate text converts by chance now and then.
UTF8_MARGIN, PAIR_MARGIN, GBK_MARGIN = 0.9, 1.4, 2.4
#: Candidates that are carried on from one layer to the next, the cheapest.
BEAM = 64

#: Relative frequency of Russian letters in per mille (public corpus statistics).
_RUSSIAN = {
    "о": 110, "е": 85, "а": 80, "и": 74, "н": 67, "т": 63, "с": 55, "р": 47, "в": 45, "л": 43, "к": 35, "м": 32, "д": 30, "п": 28, "у": 26, "я": 20,
    "ы": 19, "ь": 17, "г": 17, "з": 16, "б": 16, "ч": 14, "й": 12, "х": 10, "ж": 9, "ш": 7, "ю": 6, "ц": 5, "щ": 4, "э": 3, "ф": 3, "ъ": 0.4, "ё": 4,
}
#: The same for Greek.
_GREEK = {
    "α": 95, "ο": 85, "ι": 65, "τ": 75, "ε": 65, "ν": 62, "σ": 45, "ρ": 43, "π": 40, "κ": 39, "υ": 36, "η": 35, "ς": 34, "μ": 33, "λ": 29, "ό": 22, "ί": 22,
    "έ": 20, "ω": 19, "δ": 17, "γ": 17, "ή": 16, "ά": 16, "θ": 12, "χ": 11, "φ": 9, "ύ": 8, "ώ": 8, "β": 7, "ξ": 4, "ζ": 4, "ψ": 2,
}


@functools.cache
def _byte_of(encoding: str) -> dict[str, int]:
    """Character -> byte; bytes that cp1252 leaves undefined stand for themselves."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    if encoding == "cp1252":
        for b in range(0x80, 0xA0):
            table.setdefault(chr(b), b)
    return table


@functools.cache
def _alternatives(encoding: str) -> dict[str, tuple[int, ...]]:
    """Character -> possible bytes, its own first, then that of the other letter case."""
    own = _byte_of(encoding)
    table = {}
    for c in set(own) | {c.swapcase() for c in own if len(c.swapcase()) == 1}:
        found = [own[x] for x in (c, c.swapcase()) if x in own]
        table[c] = tuple(dict.fromkeys(found))
    return table


def _han_cost(c: str) -> float:
    """By how common a Chinese character is: of the first level of a national character set, of another level, of none."""
    cost = 2.9
    for encoding, low, high in (("gb2312", 0xB0, 0xD7), ("shift_jis", 0x88, 0x97), ("big5", 0xA4, 0xC6)):
        try:
            lead = c.encode(encoding)[0]
        except UnicodeEncodeError:
            continue
        if low <= lead <= high:
            return 2.2
        cost = 2.6
    return cost


@functools.lru_cache(1 << 16)
def _kind(c: str) -> tuple[str, float, str]:
    """(script class, base cost, case) of one character; case is u, l or empty."""
    o = ord(c)
    if o < 0x80:
        return ("L" if c.isalpha() else "d" if c.isdigit() else ".", 0.0, "u" if c.isupper() else "l" if c.islower() else "")
    cat = unicodedata.category(c)
    case = "u" if cat in ("Lu", "Lt") else "l" if cat == "Ll" else ""
    if cat == "Cc":
        return "?", 4.0, ""
    if cat in ("Co", "Cn", "Cs"):
        return "?", 5.0, ""
    if o == 0xFFFD:
        return "?", 6.0, ""
    if cat[0] == "L":
        if o in (0xAA, 0xB5, 0xBA, 0x2C6, 0x2C7):
            return "S", 0.0, ""
        if 0xC0 <= o <= 0x17F:
            return "A", 1.0 if o not in (0xD0, 0xDD, 0xDE, 0xF0, 0xFD, 0xFE, 0xFF, 0x178, 0x192) else 1.6, case
        if o in (0x1A0, 0x1A1, 0x1AF, 0x1B0, 0x218, 0x219, 0x21A, 0x21B) or 0x1E00 <= o < 0x1F00:
            return "A", 1.4, case
        if o < 0x370:
            return "A", 4.0, case
        if o < 0x400:
            p = _GREEK.get(c.lower())
            return "G", 2.6 if p is None else 0.25 * -math.log2(p / 1000), case
        if o < 0x530:
            p = _RUSSIAN.get(c.lower())
            return "C", 2.4 if p is None else 0.25 * -math.log2(p / 1000), case
        if 0x3040 <= o < 0x3100:
            return "K", 1.2, ""
        if 0x4E00 <= o < 0xA000:
            return "H", _han_cost(c), ""
        if 0xAC00 <= o < 0xD7B0:
            return "O", 1.5, ""
        if 0xFB00 <= o <= 0xFB06 or 0xFF61 <= o < 0xFFA0 or 0x3400 <= o < 0x4E00:
            return "A" if o > 0xF000 else "H", 3.2, ""
        if 0x1F00 <= o < 0x2000:
            return "G", 2.0, case
        # scripts of today's names before those that hardly occur
        return "Z", 1.3 if o < 0x700 or 0x900 <= o < 0x1200 else 2.0 if o < 0x3000 else 3.0, case
    if cat[0] == "M":
        return "M", 3.4, ""
    if cat == "Cf":
        return "S", 2.0, ""
    if 0x2B0 <= o < 0x300 and not 0x2D8 <= o < 0x2DE:
        return "S", 3.0, ""
    if 0x2500 <= o < 0x25A0:
        return "S", 1.6, ""
    if o >= 0x1F000 or 0x2600 <= o < 0x27C0:
        return "E", 0.4, ""
    if cat[0] == "Z" or o in (0x2019, 0x2018, 0x201C, 0x201D, 0x2026, 0x2013, 0x2014, 0xAB, 0xBB) or 0x3000 <= o < 0x3040:
        return "F", 0.3, ""
    return "S", 0.3, ""


def garbling_cost(text: str) -> float:
    """How unlikely the characters of text stand beside each other; 0 for ASCII."""
    cost, n = 0.0, len(text)
    kinds = [_kind(c) for c in text]
    run = 0
    for i, (script, base, case) in enumerate(kinds):
        cost += base
        before = kinds[i - 1] if i else (".", 0.0, "")
        after = kinds[i + 1] if i + 1 < n else (".", 0.0, "")
        if script in "SF" and base < 6:
            sides = (before[0] not in ".dF?ES") + (after[0] not in ".dF?ES")
            if script == "S":
                cost += (0.5, 1.0, 2.4)[sides]
                if before[0] in "S?" or (before[0] == "A" and before[2] == "u") or after[0] == "S":
                    cost += 0.9
            elif sides == 2:
                cost += 2.0
            elif before[0] == "S" or after[0] == "S":
                cost += 0.7
            elif before[0] in "A" and before[2] == "u" and i and text[i] in "…‘’“”–—":
                cost += 1.2
        if script == "A":
            if before[0] == "A":
                cost += 0.9
                if i > 1 and kinds[i - 2][0] == "A":
                    cost += 0.9
            if case == "u" and before[2] == "l":
                cost += 1.6
            if case == "l" and before[2] == "u" and i > 1 and kinds[i - 2][2] == "u":
                cost += 1.6
        elif script in "CG":
            if case == "u" and before[0] == script:
                cost += 1.5 if before[2] == "l" else 0.1
            elif case == "l" and before[0] == script and before[2] == "u" and i > 1 and kinds[i - 2][0] == script:
                cost += 1.0
        letter, prior = script in "LACGKHOZ", before[0] in "LACGKHOZ"
        if letter and prior:
            a, b = ("L" if script in "LA" else script), ("L" if before[0] in "LA" else before[0])
            if a != b and {a, b} != {"K", "H"}:
                cost += 1.0
                if a == "L" and run <= 2:
                    cost += 1.2
            run = run + 1 if a == b else 1
        elif letter:
            run = 1
        if letter and script not in "LA" and after[0] in "LA" and run == 1 and i == 0:
            cost += 0.4
    return cost


@functools.cache
def _pair_table(read_as: str, written_as: str) -> dict[int, str]:
    """For str.translate: what each character becomes; NUL where it may not be part of such text."""
    table = {}
    for c, b in _byte_of(read_as).items():
        script = _kind(c)[0]
        if script in "FE":
            continue
        try:
            new = bytes([b]).decode(written_as)
        except UnicodeDecodeError:
            new = "\0"
        # strict: what was a letter when written must come out as one
        table[ord(c)] = new if _kind(new)[0] in "ACGKHO" else "\0"
    return table


def _c1(error: UnicodeError) -> tuple[bytes, int]:
    """Encodes C1 controls, by which readers show bytes that their encoding leaves undefined, as those bytes."""
    bad = error.object[error.start : error.end] if isinstance(error, UnicodeEncodeError) else ""
    if not bad or any(not "\x80" <= c < "\xa0" for c in bad):
        raise error
    return bytes(map(ord, bad)), error.end


codecs.register_error("limpid_c1", _c1)
_RUN, _TWO, _FOUR = re.compile(r"[^\x00-\x7f]+"), re.compile(r"[^\x00-\x7f]{2}"), re.compile(r"[^\x00-\x7f]{4}")


_ASCII = frozenset(map(chr, range(128)))


def _strict(text: str, read_as: str) -> str | None:
    """text with every run outside ASCII that re-encodes and strictly decodes as UTF-8 replaced; None if none does."""
    hit, errors = False, "limpid_c1" if read_as == "cp1252" else "strict"

    def one(run: re.Match) -> str:
        nonlocal hit
        try:
            fixed = run[0].encode(read_as, errors).decode("utf-8")
        except UnicodeError:
            return run[0]
        hit = hit or fixed != run[0]
        return fixed

    fixed = _RUN.sub(one, text)
    return fixed if hit else None


def _strict_multi(text: str, written_as: str) -> str | None:
    """All runs re-encoded as cp1252 and strictly decoded as an encoding of several bytes; two characters of it at least.

    Called for texts with four characters outside ASCII in a row.
    """

    def one(run: re.Match) -> str:
        return run[0].encode("cp1252", "limpid_c1").decode(written_as)

    try:
        fixed = _RUN.sub(one, text)
    except UnicodeError:
        return None
    kinds = [_kind(c)[0] for c in fixed if c > "\x7f"]
    return fixed if fixed != text and len(kinds) > 1 and set(kinds) <= set("HKO") else None


@functools.cache
def _pair_chars(read_as: str, written_as: str) -> tuple[frozenset[str], frozenset[str]]:
    """(characters that convert, characters that may not be part of such text)."""
    table = _pair_table(read_as, written_as)
    return frozenset(chr(o) for o, new in table.items() if new != "\0"), frozenset(chr(o) for o, new in table.items() if new == "\0")


def _as_pair(text: str, chars: set[str], read_as: str, written_as: str) -> str | None:
    """All letters and symbols of text under one pair of encodings; spaces and quotes that do not convert are passed on.

    chars are its characters outside ASCII. Latin letters become another alphabet only if there are four or more: three
    in a row also occur in Latin words.
    """
    good, bad = _pair_chars(read_as, written_as)
    if not chars & good or chars & bad or any(_kind(c)[0] not in "FE" for c in chars - good):
        return None
    if written_as != "cp1252" and read_as == "cp1252" and sum(c > "\x7f" for c in text) < 4:
        return None
    return text.translate(_pair_table(read_as, written_as))


def _layer(text: str) -> list[tuple[str, float]]:
    """What text may have been one layer of UTF-8 before, and the margin that this asks for."""
    found = {}
    if any("⺀" <= c < "ﬀ" for c in text):
        found[_strict(text, "gb18030")] = GBK_MARGIN
    if _TWO.search(text):  # a sequence has two bytes at least
        for encoding in READ_AS:
            found[_strict(text, encoding)] = UTF8_MARGIN
    found.pop(None, None)
    return [*found.items()]


def _round_trips(text: str) -> tuple[str, float, bool] | None:
    """The candidate that lowers the cost most over any number of layers: text, cost, whether it is UTF-8 throughout; None if there is none."""
    before: float | None = None
    best, layer, known = (0.0, "", 0.0, True), [(0.0, text, 0.0)], {text}

    def consider(state: str, margin: float, utf8: bool) -> float:
        nonlocal before, best
        before = garbling_cost(text) if before is None else before
        cost = garbling_cost(state)
        best = max(best, (before - cost - margin + 1e-6, state, cost, utf8), key=lambda b: b[0])
        return cost

    while layer:
        further = []
        for _, state, margin in layer:
            for fixed, own in _layer(state):
                if fixed not in known:
                    known.add(fixed)
                    own = max(own, margin)
                    further.append((consider(fixed, own, True), fixed, own))
            chars = set(state) - _ASCII
            for read_as, written_as in LEGACY_PAIRS:
                fixed = _as_pair(state, chars, read_as, written_as)
                if fixed is not None and fixed not in known and fixed != state:
                    # a Cyrillic word stays one under another Cyrillic encoding, only its letters get rarer
                    consider(fixed, margin + PAIR_MARGIN + (0.3 if read_as != "cp1252" and written_as in ("cp1251", "koi8_r") else 0.0), False)
            for written_as in MULTI_BYTE if _FOUR.search(state) else ():
                fixed = _strict_multi(state, written_as)
                if fixed is not None and fixed not in known:
                    consider(fixed, margin + PAIR_MARGIN, False)
        layer = sorted(further)[:BEAM]
    return (best[1], best[2], best[3]) if best[0] > 0 else None


# ---------------------------------------------------------------- values changed after they were garbled


def _sequence(options: list[tuple[int, ...]], at: int) -> tuple[str, int, int, float] | None:
    """The most likely strictly valid UTF-8 sequence that begins at options[at]: character, length, bytes of changed case, score."""
    best = None
    for k, lead in enumerate(options[at]):
        size = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        if not size or at + size > len(options):
            continue
        tails = [[(j, x) for j, x in enumerate(o) if 0x80 <= x < 0xC0] for o in options[at + 1 : at + size]]
        for tail in itertools.product(*tails):
            try:
                c = bytes([lead, *(x for _, x in tail)]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            changed = (k > 0) + sum(j > 0 for j, _ in tail)
            script, base, _ = _kind(c)
            if not changed and (base < 2.0 or script in "HE"):
                return c, size, 0, base
            score = base + 0.4 * changed
            if best is None or score < best[3]:
                best = c, size, changed, score
    return best


def _loose(text: str, read_as: str, folded: bool, lost: bool) -> tuple[str, int] | None:
    """text with its decodable sequences replaced, and how many bytes were changed for that; None without any.

    folded: a letter may stand for the byte of the other letter case; a plain space for a no-break one in any
    case. Unless bytes were lost, every character of a run must belong to a sequence.
    """
    table = _alternatives(read_as) if folded else {c: (b,) for c, b in _byte_of(read_as).items()}
    none = ()
    options = [table.get(c, none) if c > "\x7f" else (0xA0,) if c == " " else none for c in text]
    out, i, n, hit, changed = [], 0, len(text), False, 0
    while i < n:
        if text[i] > "\x7f" and options[i] and i + 1 < n and options[i + 1]:
            found = _sequence(options, i)
            if found:
                out.append(found[0])
                changed += found[2] + text[i : i + found[1]].count(" ")
                i += found[1]
                hit = True
                continue
        if text[i] > "\x7f" and options[i] and not lost and _kind(text[i])[0] not in "FE":
            return None
        out.append(text[i])
        i += 1
    return ("".join(out), changed) if hit else None


def _changed_later(text: str) -> tuple[str, float] | None:
    """The second pass: what a value may have been that was changed after it was garbled, and its cost."""
    cased = [c for c in text if c.lower() != c.upper()]
    folded = len(cased) > 1 and (all(c.islower() for c in cased) or all(c.isupper() for c in cased))
    lost = _LOST.search(text) is not None
    if not (folded or lost or " " in text):
        return None
    best, before = None, garbling_cost(text)
    for encoding in READ_AS:
        found = _loose(text, encoding, folded, lost)
        if found is not None and found[0] != text:
            fixed = found[0]
            if folded:  # what is restored was of that case too when the value was folded
                cased_too = fixed.lower() if text.lower() == text else fixed.upper()
                fixed = cased_too if len(cased_too) == len(fixed) else fixed
            cost = garbling_cost(fixed) + 0.2 * found[1]
            if before - cost >= UTF8_MARGIN and (best is None or cost < best[1]):
                best = fixed, cost
    return best


#: What no text holds that was decoded rightly: replacement characters, C1 controls, private use.
_LOST = re.compile("[\ufffd\x80-\x9f\ue000-\uf8ff]")


def repair(text: str | None) -> tuple[bool, str | None]:
    """(is it garbled, the restored text as far as possible)."""
    if not text or text.isascii():
        return False, text
    # names repeat, long texts hardly do and would fill the memory
    return _short(text) if len(text) <= 200 else _repaired(text)


def _repaired(text: str) -> tuple[bool, str]:
    now, garbled = text, _LOST.search(text) is not None
    found = _round_trips(text)
    if found is not None:
        later = None if found[2] else _changed_later(text)
        now, garbled = later[0] if later is not None and later[1] < found[1] else found[0], True
    while (later := _changed_later(now)) is not None:  # each step lowers the cost
        now, garbled = later[0], True
    return garbled, now


_short = functools.lru_cache(1 << 15)(_repaired)


def _repair_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for values in batches:
        done = [repair(v) if isinstance(v, str) else (False, None) for v in values]
        yield pd.DataFrame({"garbled": [d[0] for d in done], "restored": [d[1] for d in done]})


def repaired(value: Column) -> Column:
    """struct<garbled: boolean, restored: string> of a text column; only values outside ASCII reach Python."""
    udf = F.pandas_udf(_repair_batches, "garbled boolean, restored string")
    return udf(value)


def find_garbled(df: DataFrame, id_col: str, text_col: str, field_name: str) -> DataFrame:
    """field_name, row_id, original and restored text of every garbled value of one column.

    A map over the column: the filter on characters outside ASCII runs in the scan's stage, so that Python sees
    only the rows that can be garbled at all.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("original")).where(F.col("row_id").isNotNull() & F.col("original").rlike(r"[^\x00-\x7F]"))
    return rows.withColumn("r", repaired(F.col("original"))).where(F.col("r.garbled")).select(F.lit(field_name).alias("field_name"), "row_id", "original", F.col("r.restored").alias("restored"))
