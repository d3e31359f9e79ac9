"""Problem 3: duplicates hidden by formatting differences.

The characters of both fields stream through a skip-and-fold table (white space of any kind and
punctuation of any script are skipped, letter case is folded) into two rolling polynomial hashes per
field: every character adds its term in place, skipped ones add nothing, and no canonical string is
built. The hashes of the two fields are put in order, so that swapped fields meet. Rows whose hashes
collide are verified by comparing them with the group's first row with two pointers that skip and fold
as they go. Should a comparison fail, as it may for a few rows among billions since the hashes travel as one
number of 64 bits, those rows alone are grouped by their folded text, so that the result is exact.

Spark plan: (hash, record id) is aggregated with a map-side combine to the groups with two rows or
more, which are written down; the rows then join them, and the members the first rows' texts. Both
small sides are written before the join, so that adaptive execution can split the partition of a hot
group. The hash function runs once in each of the two scans; nothing is collected per group.

Defined results: rows in which the id or a field is null, or a field blank once white space is trimmed, take no part;
a field of punctuation only is an empty text, equal to any other such; repeated ids count as rows of
their own for the copies and are reported as members by id.
"""

from __future__ import annotations

import array
import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BASE = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1))
BLANK = r"^[\s\p{Z}\x{85}\x{1C}-\x{1F}]*\z"


def _folded(c: str) -> int:
    """Code point of c without case, 0 if c is skipped."""
    if c.isspace() or unicodedata.category(c)[0] in "PZ":
        return 0
    for f in (c.casefold(), c.lower()):
        if len(f) == 1:
            return ord(f)
    return ord(c)


@functools.cache
def fold_table() -> np.ndarray:
    """The skip-and-fold table over all code points (4.4 MB, made once per worker)."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for o in range(0x20000):
        if not 0xD800 <= o < 0xE000:
            table[o] = _folded(chr(o))
    for o in range(0xE0000, 0xE0200):
        table[o] = _folded(chr(o))
    return table


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(k: int, n: int) -> np.ndarray:
    out = np.full(n, _BASE[k], dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@functools.cache
def _small_mix(k: int) -> np.ndarray:
    table = _mix(np.arange(0x3000, dtype=np.uint64), 0x51ED + 0x1234567 * k)
    table[0] = 0  # what is skipped adds nothing
    return table


def hashes(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit rolling polynomial hashes of each text under the skip-and-fold table."""
    joined = "".join(values)
    if not joined:
        return np.zeros(len(values), np.uint64), np.zeros(len(values), np.uint64)
    codes = fold_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    length = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    counted = np.cumsum(codes != 0)
    end = np.cumsum(length)
    upto = np.concatenate(([0], counted))
    begin, n = upto[end - length], upto[end] - upto[end - length]
    # how many characters of the text were not skipped before each
    place = np.maximum(counted - 1 - np.repeat(begin, length), 0)
    longest = 1 << int(n.max(initial=1)).bit_length()
    some = np.flatnonzero(length)
    out = []
    for k in (0, 1):
        small = _small_mix(k)
        x = small[codes] if codes.max() < len(small) else np.where(codes == 0, np.uint64(0), _mix(codes, 0x51ED + 0x1234567 * k))
        x = x * _powers(k, max(64, longest))[place]
        total = np.zeros(len(values), np.uint64)
        total[some] = np.add.reduceat(x, (end - length)[some])
        out.append(_mix(total + n.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D), k))
    return out[0], out[1]


@functools.cache
def _fold_array() -> array.array:
    return array.array("I", fold_table().tobytes())


def same(a: str, b: str) -> bool:
    """Are a and b equal but for what is skipped and folded? Two pointers, no copies."""
    if a == b:
        return True
    table = _fold_array()
    i = j = 0
    m, n = len(a), len(b)
    while True:
        x = y = 0
        while i < m and not x:
            x = table[ord(a[i])]
            i += 1
        while j < n and not y:
            y = table[ord(b[j])]
            j += 1
        if x != y:
            return False
        if not x:
            return True


def _hash_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        n = len(a)
        one, two = hashes([*a.tolist(), *b.tolist()])
        first = (one[:n] < one[n:]) | ((one[:n] == one[n:]) & (two[:n] <= two[n:]))
        low1, high1 = np.where(first, one[:n], one[n:]), np.where(first, one[n:], one[:n])
        low2, high2 = np.where(first, two[:n], two[n:]), np.where(first, two[n:], two[:n])
        rotate = (high1 << np.uint64(21)) | (high1 >> np.uint64(43)), (high2 << np.uint64(33)) | (high2 >> np.uint64(31))
        k1, k2 = _mix(low1 * np.uint64(3) + rotate[0], 7), _mix(low2 * np.uint64(5) + rotate[1], 11)
        # one number of 64 bits travels; should two records share it, the comparison tells them apart
        yield pd.Series(_mix(k1 + ((k2 << np.uint64(29)) | (k2 >> np.uint64(35))), 13).view(np.int64))


def present(c: Column) -> Column:
    """Neither null nor blank."""
    return c.isNotNull() & ~c.rlike(BLANK)


def keyed(df: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """(record_id, a, b, k) of the rows that take part; k is equal for equal records."""
    rows = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("record_id").isNotNull() & present(F.col("a")) & present(F.col("b")))
    # called nondeterministic, so that no filter that a join infers is pushed below it and makes it run again
    udf = F.pandas_udf(_hash_batches, "bigint").asNondeterministic()
    return rows.withColumn("k", udf("a", "b"))


def _same_batches(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for a, b, c, d in batches:
        known: dict[tuple[str, ...], bool] = {}  # a hot group brings the same spellings again and again
        out = []
        for four in zip(a, b, c, d, strict=True):
            ok = known.get(four)
            if ok is None:
                p, q, r, s = four
                known[four] = ok = (same(p, r) and same(q, s)) or (same(p, s) and same(q, r))
            out.append(ok)
        yield pd.Series(out, dtype=bool)


def _canonical_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    table = fold_table()

    def text(t: str) -> str:
        return "".join(chr(x) for x in table[[ord(c) for c in t]] if x) if t else ""

    for a, b in batches:
        yield pd.Series(["\0".join(sorted((text(p), text(q)))) for p, q in zip(a, b, strict=True)])


def members(df: DataFrame, id_col: str = "record_id", a: str = "url", b: str = "username") -> DataFrame:
    """(first_record_id, record_id): every row of a group of equal records other than its first, by smallest id."""
    rows = keyed(df, id_col, a, b)
    groups = rows.groupBy("k").agg(F.min("record_id").alias("first_record_id"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n").checkpoint()
    # the texts of rows in groups of one are dropped by the join
    inside = rows.join(groups.hint("merge"), "k").checkpoint()
    first = inside.where(F.col("record_id") == F.col("first_record_id")).select("k", F.col("a").alias("c"), F.col("b").alias("d")).dropDuplicates(["k"]).checkpoint()
    check = F.pandas_udf(_same_batches, "boolean")
    tested = inside.where(F.col("record_id") != F.col("first_record_id")).join(first.hint("merge"), "k").withColumn("ok", check("a", "b", "c", "d"))
    tested = tested.select("first_record_id", "record_id", F.when(~F.col("ok"), F.struct("a", "b")).alias("odd")).checkpoint()
    good = tested.where("odd is null").select("first_record_id", "record_id")
    canonical = F.pandas_udf(_canonical_batches, "string")
    odd = tested.where("odd is not null").select("record_id", canonical("odd.a", "odd.b").alias("t"))
    firsts = odd.groupBy("t").agg(F.min("record_id").alias("first_record_id"))
    return good.unionByName(odd.join(firsts, "t").where(F.col("record_id") != F.col("first_record_id")).select("first_record_id", "record_id"))


def collapse(df: DataFrame, id_col: str = "record_id", a: str = "url", b: str = "username") -> DataFrame:
    """One row per record: its first id, that row's two fields, and the number of copies (1 for a record without duplicates)."""
    found = members(df, id_col, a, b).checkpoint()
    copies = found.groupBy(F.col("first_record_id").alias("record_id")).agg((F.count(F.lit(1)) + 1).alias("n_copies"))
    rows = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(a).alias(a), F.col(b).alias(b)).where(F.col("record_id").isNotNull() & present(F.col(a)) & present(F.col(b)))
    kept = rows.join(found.select("record_id"), "record_id", "left_anti").join(copies, "record_id", "left")
    return kept.select(F.col("record_id").alias("first_record_id"), a, b, F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
