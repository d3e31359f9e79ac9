"""Which charset bytes without a mark are in, by how likely the text is that each candidate makes of them.

A candidate must decode the whole content strictly. Among those that do, the characters beyond ASCII of a sample are
charged by how rare they are and by what they stand beside (an accented capital inside a word, a Cyrillic letter
joined to a Latin one, a control character), and the candidate of least charge is taken.
"""

from __future__ import annotations

import codecs
import functools
import math
import re
import unicodedata

CANDIDATES = ("windows-1252", "windows-1251", "koi8-r", "windows-1253", "gb18030", "shift_jis", "euc_jp", "euc_kr", "big5", "utf-16le", "utf-16be")
#: Letters of Russian and Greek, from frequent to rare.
_ORDER = {c: k for letters in ("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфёъ", "αοιετνσηρπκμλυςόίέδωγήάθχύφώβξζψ") for k, c in enumerate(letters)}
#: Charge for each alternative of a charset before its text is looked at; Western text is the most frequent.
_PRIOR = {"utf-8": -0.5, "windows-1252": 0.0, "windows-1253": 1.0}
#: So much a character the charge must lie below the next best candidate's for the answer to be sure.
SURE = 0.25
_ODD = re.compile(rb"[\x00-\x08\x80-\xff]")


@functools.lru_cache(1 << 14)
def _charge(c: str) -> tuple[float, str]:
    """(charge, kind): L Latin, C other alphabets with letter case, H characters without spaces, S all else."""
    o, cat = ord(c), unicodedata.category(c)
    if cat in ("Cc", "Co", "Cn", "Cs"):
        return 4.0, "S"
    if c in "ªºµ":
        return 0.6, "S"
    if 0x2500 <= o < 0x25A0:
        return 2.5, "S"
    if cat[0] == "L":
        if 0xC0 <= o < 0x250:
            return (1.0 if c not in "ÐÞðþÿŸƒÝý" else 1.8), "L"
        if 0x370 <= o < 0x530:
            return 0.4 + 0.05 * _ORDER.get(c.lower(), 60), "C"
        if 0x3040 <= o < 0x3100:
            return 0.6, "H"
        if 0x4E00 <= o < 0xA000:
            for name, low, high in (("gb2312", 0xB0, 0xD7), ("shift_jis", 0x88, 0x97), ("big5", 0xA4, 0xC6)):
                try:
                    if low <= c.encode(name)[0] <= high:
                        return 1.0, "H"
                except UnicodeEncodeError:
                    pass
            return 2.6, "H"
        if 0xAC00 <= o < 0xD7B0:
            try:
                c.encode("euc_kr")
                return 0.8, "H"
            except UnicodeEncodeError:
                return 2.6, "H"
        return 2.5, "S"
    if 0x3000 <= o < 0x3020 or 0xFF00 <= o < 0xFF5F or c in "‘’“”–—…•€«»\xa0°§":
        return 0.5, "S"
    return 1.8, "S"


def _cost(text: str) -> tuple[float, int]:
    """(charge of all characters beyond ASCII, their number)."""
    total, n, before, low, run = 0.0, 0, "", False, 0
    for c in text:
        if c < "\x80":
            kind = "L" if c.isalpha() else "S"
            if c < " " and c not in "\t\n\r\f\x1b":
                total, n = total + 4.0, n + 1
            if kind == "L" and before in ("C", "H"):
                total += 1.5 if before == "C" else 1.0
        else:
            charge, kind = _charge(c)
            total, n = total + charge, n + 1
            if kind == "S" and charge > 1 and before == "L":
                total += 1.0
            elif before == "L" and kind in "CH":
                total += 1.5 if kind == "C" else 1.0
            if low and c.isupper():
                total += 1.5
        if kind == "C":
            run += 1
        else:  # a word of one letter
            total, run = total + (0.9 if run == 1 else 0.0), 0
        low = c.islower() if kind in "LC" else False
        before = kind
    return total, n


def _strictly(content: bytes, codec: str) -> bool:
    try:
        content.decode(codec)
        return True
    except UnicodeError:
        return False


def plain(content: bytes) -> bool:
    """UTF-8 without control characters other than those of lines and terminals: no other charset is considered."""
    return not content.translate(None, bytes(b for b in range(256) if not (b < 9 or 13 < b < 27))) and _strictly(content, "utf-8")


def guess(content: bytes, sample: int) -> tuple[str | None, bool]:
    """(charset, is it sure); None where no candidate decodes the content."""
    odd = _ODD.search(content)
    first = odd.start() if odd else 0
    found = []
    for name in (*CANDIDATES, "utf-8"):
        wide = name.startswith("utf-16")
        if wide and len(content) < 8:
            continue  # nearly any few bytes are UTF-16
        at = max(0, first - 64) // 2 * 2 if wide else max(0, first - 16)  # with what stands before
        try:  # a sample may end inside a character
            text = codecs.getincrementaldecoder(name)().decode(content[at : at + sample], final=False)
        except UnicodeError:
            continue
        cost, n = _cost(text)
        found.append((cost + _PRIOR.get(name, 0.5), n, name))
    found = [f for f in sorted(found) if _strictly(content, f[2])]
    if not found:
        return None, False
    cost, n, name = found[0]
    if cost > 3.0 * max(n, 1):
        return None, False
    gap = found[1][0] - cost if len(found) > 1 else math.inf
    return name, n > 0 and cost <= 2.0 * n and gap >= SURE * max(n, 4)
