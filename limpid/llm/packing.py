"""Problem 8: filling fixed-capacity containers with items.

Sum-of-squares online packing. A level array counts the open containers of every fill level; an item
goes where the sum of the squared counts grows least, which keeps the levels even and hardly leaves
gaps that no item fits. Items above the capacity are cut into full containers and a remainder; no
other item is split.

Spark plan: sizes are computed where the texts are read, and only (id, size) goes on. Items are spread
evenly over packers by a hash of their id; each packer streams over at most ``per_packer`` items holding
the level array and its open containers. Containers left open that some other could still be put into
go, as one piece each, into a further round of packers of the same bound, and so on, as long as a round
does away with a quarter of its pieces at least: so nothing but the number of packers grows with the
data, and a round that no longer helps is the last. Moves of containers are put together before they
meet the items, in one join.

Sizes are tokens of a public tokenizer (``tokenizer`` is the path of a tiktoken rank file on the driver,
which sends it to the workers; a path without a file is an error), or a column of counts where no
tokenizer is wanted (``tokenizer=None``).

Defined results: null and empty texts have size 0 and take no place: they come out with container
null; ids that occur twice are two items, and so are null ids; texts of any length are counted whole.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.session import written

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of byte-level BPE with 50k entries.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PER_PACKER = 20_000


#: A rank file is sent to every worker; one of 200,000 tokens has 4 MB.
MOST_RANK_BYTES = 64 << 20


@functools.lru_cache(2)
def _encoding(ranks: bytes):
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=known, special_tokens={})


def token_counts(spark: SparkSession, path: str):
    """A function of a text column: its number of tokens, 0 for null."""
    ranks = Path(path).read_bytes()
    if len(ranks) > MOST_RANK_BYTES:
        raise ValueError(f"{path} is no rank file: {len(ranks)} bytes")
    sent = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(sent.value).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return F.pandas_udf(run, "bigint")


def size_column(df: DataFrame, text_col: str = "text", tokenizer: str | None = TOKENIZER, count_col: str = "n_tokens") -> Column:
    """The size of a text: its tokens by the tokenizer, or without one what count_col says."""
    if tokenizer is not None:
        return token_counts(df.sparkSession, tokenizer)(F.col(text_col))
    return F.coalesce(F.col(count_col).cast("bigint"), F.lit(0))


class Packer:
    """Sum-of-squares placement of pieces into containers of one capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)  # open containers by level; level 0 and capacity stay 0
        self.open: dict[int, list[int]] = {}
        self.level: list[int] = []

    def place(self, size: int) -> tuple[int, int]:
        """(container, position) for a piece of 1 <= size <= capacity."""
        c, count = self.capacity, self.count
        if size == c:
            self.level.append(c)
            return len(self.level) - 1, 0
        # growth of the sum when a container of level h >= 1 takes the piece, and for a new one (h = 0)
        growth = 2 * (count[size : c + 1] - count[: c + 1 - size]) + 2
        growth[-1] = 1 - 2 * count[c - size]
        growth[0] = 2 * count[size] + 1
        may = count[: c + 1 - size] > 0
        may[0] = True
        growth = np.where(may, growth, 1 << 60)
        h = len(growth) - 1 - int(np.argmin(growth[::-1]))  # of equals the fullest
        if h == 0:
            box = len(self.level)
            self.level.append(0)
        else:
            box = self.open[h].pop()
            count[h] -= 1
        self.level[box] = h + size
        if h + size < c:
            count[h + size] += 1
            self.open.setdefault(h + size, []).append(box)
        return box, h


def _pack_group(capacity: int, round_: int, per_packer: int):
    def run(key, pieces):
        pieces = pieces.sort_values("piece")
        box, at = [], []
        for low in range(0, len(pieces), per_packer):  # a group may come out a little above the bound
            packer = Packer(capacity)
            for size in pieces["size"].iloc[low : low + per_packer]:
                b, p = packer.place(int(size))
                box.append(f"{round_}-{key[0]}-{low // per_packer}-{b}")
                at.append(p)
        return pieces.drop(columns="g").assign(box=box, at=at)

    return run


def _round(pieces: DataFrame, n: int, per_packer: int, capacity: int, round_: int) -> DataFrame:
    """pieces with the box and the place in it of one round; sorted within a packer, so that the result does not depend on arrival."""
    groups = max(1, math.ceil(n / per_packer))
    keyed = pieces.withColumn("g", F.pmod(F.xxhash64("piece", F.lit(round_)), F.lit(groups)).cast("int"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("box", T.StringType()), T.StructField("at", T.LongType())])
    return keyed.groupBy("g").applyInPandas(_pack_group(capacity, round_, per_packer), schema)


def _open(boxes: DataFrame, capacity: int, full: float) -> tuple[DataFrame, int]:
    """(piece, size) of the boxes that are not full and with which the smallest of them still fits, and their number."""
    left = boxes.where(F.col("size") < full * capacity)
    least = left.agg(F.min("size")).first()[0]
    if least is None:
        return left, 0
    left = left.where(F.col("size") <= capacity - least).select(F.col("box").alias("piece"), "size")
    return left, left.count()


def pack(df: DataFrame, id_col: str = "doc_id", size: Column | None = None, capacity: int = CAPACITY, per_packer: int = PER_PACKER, full: float = 0.995) -> DataFrame:
    """(id, part, container, position, size): where each item, or each part of one above the capacity, lies.

    part is 0 but for cut items, whose parts 0, 1, ... follow each other through the text. Boxes filled to the share
    full of the capacity go into no further round.
    """
    size = size_column(df) if size is None else size
    id_type = df.schema[id_col].dataType
    # as text, since pandas would turn whole numbers beside a null into floats
    items = written(df.select(F.col(id_col).cast("string").alias("id"), size.cast("bigint").alias("n")).withColumn("row", F.monotonically_increasing_id()), "items")
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity).cast("int") - 1, F.lit(0)))
    pieces = items.where("n > 0").select("id", "row", F.explode(parts).alias("part"), "n").select(
        "id", "part", F.concat_ws("/", "row", "part").alias("piece"), F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("part") * capacity).alias("size")
    )
    whole = pieces.where(F.col("size") == capacity).select("id", "part", F.concat(F.lit("w-"), "piece").alias("container"), F.lit(0).cast("bigint").alias("position"), "size")
    loose = pieces.where(F.col("size") < capacity)
    # the first round carries the ids along
    where = written(_round(loose, loose.count(), per_packer, capacity, 0).select("id", "part", "box", "at", "size"), "packed")
    left, n = _open(where.groupBy("box").agg(F.sum("size").alias("size")), capacity, full)
    moves, round_ = None, 0
    while n > 1:
        round_ += 1
        moved = written(_round(left, n, per_packer, capacity, round_), "packed")
        step = moved.select(F.col("piece"), F.col("box").alias("next"), F.col("at").alias("further"))
        if moves is None:
            moves = step.select(F.col("piece").alias("box"), F.col("next").alias("to"), F.col("further").alias("shift"))
        else:
            joined = moves.join(step.hint("merge"), F.col("to") == F.col("piece"), "left")
            moves = joined.select("box", F.coalesce("next", "to").alias("to"), (F.col("shift") + F.coalesce("further", F.lit(0))).alias("shift")).checkpoint()
        boxes = moved.groupBy("box").agg(F.sum("size").alias("size")).checkpoint()
        if boxes.count() > 0.75 * n or n <= per_packer:
            break
        left, n = _open(boxes, capacity, full)
    if moves is not None:
        where = where.join(moves.hint("merge"), "box", "left").select("id", "part", F.coalesce("to", "box").alias("box"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at"), "size")
    placed_all = whole.unionByName(where.select("id", "part", F.col("box").alias("container"), F.col("at").alias("position"), "size"))
    empty = items.where("n <= 0 or n is null").select("id", F.lit(0).alias("part"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("bigint").alias("position"), F.lit(0).cast("bigint").alias("size"))
    return placed_all.unionByName(empty).withColumn("id", F.col("id").cast(id_type))


def usage(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers that could hold these, and the share of space that is unused."""
    used = packed.where(F.col("container").isNotNull())
    boxes = used.groupBy("container").agg(F.sum("size").alias("filled"))
    n, filled = F.count(F.lit(1)), F.coalesce(F.sum("filled"), F.lit(0))
    return boxes.agg(n.alias("n_containers"), filled.alias("n_tokens"), F.ceil(filled / capacity).alias("n_least"), F.when(n > 0, 1 - filled / (n * capacity)).alias("unused"))


def sound(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, n_parts, n_tokens, fits) per item: fits if none of its containers is overfull and the pieces in each lie end to end from 0."""
    boxes = packed.where(F.col("container").isNotNull()).groupBy("container").agg(
        F.sum("size").alias("filled"), F.max(F.col("position") + F.col("size")).alias("upto"), F.sort_array(F.collect_list(F.struct("position", "size"))).alias("all")
    )  # a container holds at most capacity pieces
    ends = F.transform(F.col("all"), lambda x: x["position"] + x["size"])
    begins = F.transform(F.col("all"), lambda x: x["position"])
    tight = (F.col("filled") <= capacity) & (begins[0] == 0) & (F.slice(begins, 2, F.size("all")) == F.slice(ends, 1, F.size("all") - 1))
    judged = packed.join(boxes.select("container", tight.alias("tight")), "container", "left")
    return judged.groupBy("id").agg(F.count("container").alias("n_parts"), F.sum("size").alias("n_tokens"), F.bool_and(F.coalesce("tight", F.lit(True))).alias("fits"))
