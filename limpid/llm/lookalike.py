"""Problem 7: visually identical text with different characters.

Normalisation by quick check: a character that is ASCII, or that neither changes nor combines, is
stable. Only the unstable segments of a text are normalised, each with the context of its boundary
(the starter before it and the combining marks after it), and the canonical segments are spliced into
the unchanged text. The consistent form folds width, ligatures, dashes and dots of the same look,
kinds of space, invisible characters and look-alike letters of other alphabets, and composes accents
(NFC). Letter case, visible accents, digits for letters and different punctuation stay different.

Look-alikes are all letters of other alphabets that the public table of confusable characters, as it comes
with the ICU library of Spark, takes for one letter of ASCII, and a few phonetic letters. They are folded to
that letter wherever they occur, also in words of another script, so that the form does not depend on
what surrounds a letter: texts are equal in it just if they read alike.

Spark plan: the forms are computed once and written; groups with two spellings or more are found by a
combined aggregate over hashes of form and spelling, and only their rows go on. Every side that joins
is written before, so that adaptive execution can split a hot partition.

Defined results: null stays null, empty stays empty; byte-equal rows are no pair; rows with a null
field or id are in no pair and no class; the form of a form is itself.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.session import written

#: Fixed: phonetic and other letters that look like one of ASCII and are not among the confusable ones of other alphabets.
PHONETIC = {"ɑ": "a", "ɡ": "g", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ӏ": "l", "Ԛ": "Q"}
#: Fixed: dashes and dots of the same look as the ASCII one.
SAME_LOOK = {**dict.fromkeys("‐‑‒–−⁃˗﹣－", "-"), **dict.fromkeys("․．﹒", "."), "＇": "'", "＂": '"'}
_FOLDED_COMPAT = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<small>")


def _invisible(c: str) -> bool:
    o = ord(c)
    return unicodedata.category(c) == "Cf" or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180E or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


@functools.cache
def lookalikes(spark: SparkSession) -> dict[str, str]:
    """Letter -> the letter of ASCII that it looks like, for all letters of alphabets other than Latin."""
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    plain = [chr(o) for o in range(0x21, 0x7F)]
    # Chinese characters and Korean syllables look like no letter
    letters = [chr(o) for o in range(0x80, 0x20000) if not (0x3400 <= o < 0xA000 or 0xAC00 <= o < 0xE000) and unicodedata.category(chr(o))[0] == "L"]
    shapes = checker.getSkeleton("\n".join(plain + letters)).split("\n")
    named: dict[str, list[str]] = {}
    for c, shape in zip(plain, shapes, strict=False):
        if c.isalpha():
            named.setdefault(shape, []).append(c)
    table = dict(PHONETIC)
    for c, shape in zip(letters, shapes[len(plain) :], strict=True):
        if shape in named and not unicodedata.name(c, "").startswith("LATIN"):
            # a capital I and a small l have one shape
            table.setdefault(c, next((x for x in named[shape] if x.isupper() == c.isupper()), named[shape][-1]))
    return table


class Form:
    """The consistent form under a table of look-alikes."""

    def __init__(self, table: Mapping[str, str]):
        self.table = table
        self.folds: dict[str, str] = {}
        self.stable: dict[str, bool] = {}

    def fold(self, c: str) -> str:
        """The consistent form of one character, before composition."""
        known = self.folds.get(c)
        if known is None:
            self.folds[c] = known = self._fold(c)
        return known

    def _fold(self, c: str) -> str:
        if c <= "\x7f":
            return c
        if c in SAME_LOOK:
            return SAME_LOOK[c]
        if c in self.table:
            return self.table[c]
        if _invisible(c):
            return ""
        if unicodedata.category(c) == "Zs":
            return " "
        d = unicodedata.decomposition(c)
        if d and (d.split(" ")[0] in _FOLDED_COMPAT or 0xFB00 <= ord(c) <= 0xFB06 or 0xFB13 <= ord(c) <= 0xFB17 or 0x2160 <= ord(c) < 0x2180):
            return "".join(self.fold(chr(int(x, 16))) for x in d.split(" ")[1:])
        # a letter with an accent: its base may be a look-alike
        if d and d[0] != "<":
            parts = unicodedata.normalize("NFD", c)
            return unicodedata.normalize("NFC", "".join(self.fold(x) if x != c else x for x in parts))
        return c

    def unstable(self, c: str) -> bool:
        """Quick check: may c change, or combine with what stands before it?"""
        known = self.stable.get(c)
        if known is None:
            self.stable[c] = known = self.fold(c) != c or unicodedata.combining(c) > 0 or not unicodedata.is_normalized("NFC", c) or 0x1161 <= ord(c) <= 0x11C2
        return known

    def canonical(self, text: str | None) -> str | None:
        """The consistent form of text; unchanged stretches are copied as they are."""
        if text is None or text.isascii():
            return text
        out, done = [], 0
        for run in _OUTSIDE.finditer(text):
            i, stop = run.span()
            while i < stop:
                if not self.unstable(text[i]):
                    i += 1
                    continue
                begin = i
                while begin > done and (unicodedata.combining(text[begin]) or _invisible(text[begin])):
                    begin -= 1  # back to the starter that marks may join
                end = i + 1
                while end < len(text) and text[end] > "\x7f" and self.unstable(text[end]):
                    end += 1
                segment = "".join(map(self.fold, text[begin:end]))
                out += [text[done:begin], unicodedata.normalize("NFC", segment)]
                done = i = end
        spliced = "".join([*out, text[done:]])
        # an invisible character between a starter and its mark is gone now; rare, so the check is cheap
        return spliced if unicodedata.is_normalized("NFC", spliced) else self.canonical(unicodedata.normalize("NFC", spliced))


_OUTSIDE = re.compile(r"[^\x00-\x7f]+")


@functools.lru_cache(4)
def _form(table: tuple[tuple[str, str], ...]) -> Form:
    """One form, with what it has learnt of characters, for all batches of a worker."""
    return Form(dict(table))


def canonical_form(c: Column, table: Mapping[str, str]) -> Column:
    """The consistent form of a column; texts in ASCII are handed over as null and stay in the JVM."""
    items = tuple(table.items())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        canonical = _form(items).canonical
        for values in batches:
            yield values.map(canonical, na_action="ignore")

    # called nondeterministic, so that no inferred filter is pushed below it and makes it run again
    udf = F.pandas_udf(run, "string").asNondeterministic()
    return F.coalesce(udf(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def consistent(df: DataFrame, *cols: str) -> DataFrame:
    """df with every named column in its consistent form."""
    table = lookalikes(df.sparkSession)
    return df.withColumns({c: canonical_form(F.col(c), table) for c in cols})


def _forms(df: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """(id, a, b, ka, kb), and (h, s): hashes of the form and of the spelling, all of rows without nulls; written."""
    table = lookalikes(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("id").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull())
    rows = rows.withColumns({"ka": canonical_form(F.col("a"), table), "kb": canonical_form(F.col("b"), table)})
    return written(rows.withColumns({"h": F.xxhash64("ka", "kb"), "s": F.xxhash64("a", "b"), "s2": F.xxhash64("b", "a")}), "forms")


def same_reading_pairs(df: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """(id_a, id_b), smaller id first: rows whose two fields read the same while at least one is stored differently.

    Pairs are formed between spellings first and rows are joined to them afterwards, so that exact copies, however
    many, are never compared with each other: the joins produce just the rows of the result. Where a class is so
    large that its pairs are too many, same_reading_classes() has the same in a row per member.
    """
    forms = _forms(df, id_col, a, b)
    # a form's hash may be shared by chance, which lets in a few rows too many; a spelling is told by two
    several = forms.groupBy("h").agg(*[f(c).alias(f"{n}_{c}") for c in ("s", "s2") for n, f in (("low", F.min), ("high", F.max))])
    several = several.where("low_s <> high_s or low_s2 <> high_s2").select("h").checkpoint()
    inside = written(forms.join(several.hint("merge"), "h").select("id", "a", "b", "ka", "kb"), "spelt")
    spellings = inside.select("ka", "kb", "a", "b").distinct().checkpoint()
    x, y = spellings.alias("x"), spellings.alias("y")
    on = (F.col("x.ka") == F.col("y.ka")) & (F.col("x.kb") == F.col("y.kb")) & (F.struct("x.a", "x.b") < F.struct("y.a", "y.b"))
    two = x.join(y, on).select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.a").alias("c"), F.col("y.b").alias("d")).checkpoint()
    one_side = inside.select("id", "a", "b").join(two, ["a", "b"]).select(F.col("id").alias("one"), "c", "d")
    both = one_side.join(inside.select(F.col("id").alias("other"), F.col("a").alias("c"), F.col("b").alias("d")), ["c", "d"])
    return both.where("one <> other").select(F.least("one", "other").alias("id_a"), F.greatest("one", "other").alias("id_b"))


def same_reading_classes(df: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """(id, class_id, n_links) of every row with a link: the least id of the rows that read the same, and how many of them are stored differently.

    The same links as same_reading_pairs(), counted and not listed: two combined aggregates and joins of their
    written results, whatever the size of a class.
    """
    forms = _forms(df, id_col, a, b)
    spelt = forms.groupBy("ka", "kb", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    classes = spelt.groupBy("ka", "kb").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), F.min("least").alias("class_id")).where("k > 1").drop("k").checkpoint()
    several = spelt.join(classes.hint("merge"), ["ka", "kb"]).select("a", "b", "class_id", (F.col("total") - F.col("n")).alias("n_links")).checkpoint()
    return forms.select("id", "a", "b").join(several.hint("merge"), ["a", "b"]).select("id", "class_id", "n_links")
