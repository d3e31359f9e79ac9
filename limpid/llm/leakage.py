"""Problem 9: evaluation texts leaking into training text.

Wu-Manber multi-pattern search over words. The patterns are all windows of ``words`` consecutive words
of all test items. A shift table over hashed blocks of two words tells how far the search may jump; a
block that lies in no pattern lets it skip nearly a whole window. Where the shift is 0, the bucket of the
block selects the patterns that end so, their prefix hash narrows it, and a direct comparison of the words
confirms. Many stretches of text are searched in step with each other, so that every jump is one operation
on arrays; no word of a text becomes a Python object unless it is compared.

A word is an unbroken run of letters and digits; case is ignored, and so is whatever stands between
words (line breaks, diff marks, comment signs).

Spark plan: a map over the documents, no shuffle. The test items are a query set that is read in
blocks of at most ``block_words`` words, whose tables (some 50 bytes a word) are sent to the tasks: one scan of the
documents serves a whole block. Where there are several, each block's result is written and its tables
are dropped before the next, so that neither driver nor workers ever hold more than one.

Defined results: null and empty texts contain nothing; items with fewer words than the window cannot
leak; items with equal text leak together; rows without an id are left out; texts and items of any length are
searched whole; repeated documents are each reported.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.session import written

BLOCK_WORDS = 5_000_000
#: Characters that are taken into arrays at a time, and words between the starts of two stretches.
PIECE, STRETCH = 1 << 19, 128
_U = np.uint64
_FACTOR = _U(0x9E3779B97F4A7C15)
_BLOCK = (_U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93))


@functools.cache
def _of_words() -> np.ndarray:
    """Per code point: is it a letter or digit?"""
    table = np.zeros(sys.maxunicode + 1, dtype=bool)
    for low, high in ((0, 0xD800), (0xE000, 0x33480)):
        table[low:high] = [chr(o).isalnum() for o in range(low, high)]
    return table


@functools.cache
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _FACTOR, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hash_piece(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end) of every word of a text in lower case; equal words have equal hashes wherever they stand."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = _of_words()[codes]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64), begin, end
    size = end - begin
    chars = codes[inside].astype(np.uint64) + _U(1)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(len(chars)) - np.repeat(first, size)
    terms = _mix(chars) * _powers(1 << max(6, int(size.max()).bit_length()))[place]
    return _mix(np.add.reduceat(terms, first) + size.astype(np.uint64)), begin, end


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """Pieces of a text that end between words, with where they begin."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        cut = end
        while cut < len(text) and cut > at and text[cut - 1].isalnum():
            cut -= 1
        if cut == at:  # one word longer than a piece
            cut = end
            while cut < len(text) and text[cut].isalnum():
                cut += 1
        yield at, text[at:cut]
        at = cut


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end) of every word of a text in lower case, of any length."""
    if len(text) <= PIECE:
        return _hash_piece(text)
    parts = [(h, b + at, e + at) for at, piece in _pieces(text) for h, b, e in [_hash_piece(piece)]]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class WuManber:
    """Search for any of many word sequences of equal length; items is (id, text in lower case)."""

    def __init__(self, items: Iterable[tuple[int, str]], window: int):
        self.window = window
        hashes, spelt, sizes, ids = [], [], [], []
        for item, text in items:
            h, b, e = word_hashes(text)
            if len(h) >= window:
                own = [text[x:y].encode("utf-8", "surrogatepass") for x, y in zip(b.tolist(), e.tolist(), strict=True)]
                hashes.append(h)
                spelt.append(b" ".join(own))
                sizes.append(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1)
                ids.append(item)
        self.ids = np.array(ids, dtype=np.int64)
        size = np.array([len(h) for h in hashes], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(size)))  # of the items in what follows
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.spelt = b" ".join(spelt)
        self.offsets = np.concatenate([np.zeros(1, np.int64), *sizes]).cumsum()
        del hashes, spelt, sizes
        self.bits = min(26, max(16, int(16 * len(self.words)).bit_length()))
        # where patterns begin: everywhere but in the last window - 1 words of an item
        may = np.ones(len(self.words), dtype=bool)
        for k in range(1, window):
            may[self.starts[1:] - k] = False
        begins = np.flatnonzero(may)
        self.shift = np.full(1 << self.bits, window - 1, dtype=np.uint8 if window < 256 else np.int64)
        slots = self._slots(self.words[:-1], self.words[1:]) if len(self.words) > 1 else np.zeros(0, np.int64)
        for j in range(window - 1):  # the block that ends j + 1 words after a pattern's begin, from far to near
            self.shift[slots[begins + j]] = np.minimum(self.shift[slots[begins + j]], window - 2 - j)
        keys = self._keys(slots[begins + window - 2], self._prefix(self.words, begins))
        order = np.argsort(keys, kind="stable")
        self.keys, self.begins = keys[order], begins[order]

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of a block of two words in the shift table."""
        return ((a * _BLOCK[0] + b * _BLOCK[1]) >> _U(64 - self.bits)).astype(np.int64)

    def _prefix(self, words: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Hash of the words of a pattern before its last block."""
        total = np.zeros(len(begins), dtype=np.uint64)
        for j in range(max(self.window - 2, 1)):
            total = total * _FACTOR + words[begins + j]
        return _mix(total)

    def _keys(self, slots: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Bucket of the last block and, within it, the hash of what stands before."""
        return (slots.astype(np.uint64) << _U(64 - self.bits)) | (prefix >> _U(self.bits))

    def _confirm(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of at, pattern) for every pattern whose bucket is reached and whose word hashes are those before and at the end."""
        begin = at - (self.window - 1)
        keys = self._keys(self._slots(words[at - 1], words[at]), self._prefix(words, begin))
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = high - low
        which = np.repeat(np.arange(len(at)), n)
        pattern = self.begins[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        equal = np.ones(len(which), dtype=bool)
        for j in range(self.window):
            equal &= words[begin[which] + j] == self.words[pattern + j]
        return which[equal], pattern[equal]

    def search_all(self, texts: list[str]) -> list[set[int]]:
        """For each text in lower case the items of which it contains a window."""
        found: list[set[int]] = [set() for _ in texts]
        group, held = [], 0
        for k, text in enumerate(texts):
            group.append(k)
            held += len(text)
            if held > PIECE or k == len(texts) - 1:
                self._search_group(texts, group, found)
                group, held = [], 0
        return found

    def _search_group(self, texts: list[str], group: list[int], found: list[set[int]]) -> None:
        if not len(self.keys):
            return
        window, m = self.window, len(group)
        if m > 1 and sum(len(texts[k]) for k in group[:-1]) + len(texts[group[-1]]) <= 2 * PIECE:
            words, begin, end = _hash_piece("\n".join(texts[k] for k in group))
            size = np.array([len(texts[k]) + 1 for k in group], dtype=np.int64)
            base = np.cumsum(size) - size
            first = np.searchsorted(begin, base)
            begin, end = begin - np.repeat(base, np.diff(first, append=len(begin))), end - np.repeat(base, np.diff(first, append=len(begin)))
        else:
            parts = [word_hashes(texts[k]) for k in group]
            words, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
            first = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
        last = np.append(first[1:], len(words))  # the words of text k are first[k]..last[k]
        # stretches of a text, searched in step with each other; windows may reach back before a stretch
        n = np.maximum(-(-(last - first - (window - 1)) // STRETCH), 0)
        owner = np.repeat(np.arange(m), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = first[owner] + (window - 1) + step * STRETCH
        stop = np.minimum(at + STRETCH, last[owner])
        while len(at):
            jump = self.shift[self._slots(words[at - 1], words[at])].astype(np.int64)
            hit = np.flatnonzero(jump == 0)
            if len(hit):
                which, pattern = self._confirm(words, at[hit])
                if len(which):
                    self._compare(texts, group, found, owner[hit][which], begin, end, at[hit][which], pattern)
                jump[hit] = 1
            at = at + jump
            on = at < stop
            at, stop, owner = at[on], stop[on], owner[on]

    def _compare(self, texts, group, found, owner, begin, end, at, pattern) -> None:
        """Direct comparison of the words themselves."""
        item = np.searchsorted(self.starts, pattern, "right") - 1
        for k, a, p, i in zip(owner.tolist(), at.tolist(), pattern.tolist(), item.tolist(), strict=True):
            own = found[group[k]]
            name = int(self.ids[i])
            if name in own:
                continue
            text, low = texts[group[k]], a - self.window + 1
            said = " ".join(text[x:y] for x, y in zip(begin[low : a + 1].tolist(), end[low : a + 1].tolist(), strict=True))
            if said.encode("utf-8", "surrogatepass") == self.spelt[self.offsets[p] : self.offsets[p + self.window] - 1]:
                own.add(name)


def _blocks(items: Iterator[tuple[int, str]], block_words: int, window: int) -> Iterator[list[tuple[int, str]]]:
    """Items in lower case, in blocks; one longer than a block is cut into overlapping parts."""
    block, held = [], 0
    for i, text in items:
        text = text.lower()
        _, begin, end = word_hashes(text)
        at, n = 0, len(begin)
        while n - at >= window:
            room = max(block_words - held, window)
            upto = min(at + room, n)
            block.append((i, text[begin[at] : end[upto - 1]]))
            held += upto - at
            if held >= block_words:
                yield block
                block, held = [], 0
            if upto == n:
                break
            at = upto - window + 1
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id): the document contains at least window consecutive words of the item."""
    if window < 2:
        raise ValueError("a window has two words at least")
    schema, spark = "doc_id bigint, item_id bigint", docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    stream = ((r[0], r[1]) for r in items.select(F.col(item_id).cast("bigint"), F.col(item_text)).where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).orderBy(item_id).toLocalIterator())
    done: list[DataFrame] = []
    blocks = _blocks(stream, block_words, window)
    block = next(blocks, None)
    while block is not None:
        engine = spark.sparkContext.broadcast(WuManber(block, window))

        def run(batches: Iterator[pd.DataFrame], engine=engine) -> Iterator[pd.DataFrame]:
            search = engine.value.search_all
            for batch in batches:
                found = search([t.lower() for t in batch["text"]])
                hits = [(d, i) for d, f in zip(batch["doc_id"], found, strict=True) for i in sorted(f)]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id"])

        part = rows.mapInPandas(run, schema)
        block = next(blocks, None)
        if block is not None or done:
            part = written(part, "leaks")
            engine.destroy()
        done.append(part)
    if not done:
        return spark.createDataFrame([], schema)
    if len(done) == 1:
        return done[0]
    # parts of an item that was cut may both be found; a document that is there twice is so in each part
    out = functools.reduce(DataFrame.unionByName, [d.withColumn("block", F.lit(k)) for k, d in enumerate(done)])
    counted = out.groupBy("doc_id", "item_id", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id", "item_id").agg(F.max("n").alias("n"))
    return counted.select("doc_id", "item_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k")).drop("k")


def leaked_items(found: DataFrame) -> DataFrame:
    """(item_id, n_docs): the test items that leaked and into how many documents."""
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))
