"""Input files (S1), chunk sizes (S7), decoding (S2-S5) and sinks."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limpid.functions import charset
from limpid.functions import encoding as enc

EXTENSIONS = ("txt", "csv", "log", "dat")
#: Letter case aside; the reader's filter is case-sensitive.
GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS) + "}"
MB = 1 << 20


def is_input(path: Column) -> Column:
    """Has the path one of the extensions, letter case aside?"""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)\z", 1)).isin(*EXTENSIONS)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file, or of a folder's input files (not of folders in it), UTF-8; ends of lines of any kind.

    (path, line). Files are split between lines by the reader, so the size of a file does not matter.
    """
    reader = spark.read.option("recursiveFileLookup", "false")
    file = path.rsplit("/", 1)[-1].lower()
    if not file.endswith(tuple("." + e for e in EXTENSIONS)):
        reader = reader.option("pathGlobFilter", GLOB)
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def _reader(spark: SparkSession, path: str, kind: str) -> DataFrame:
    reader = spark.read.format(kind).option("recursiveFileLookup", "false")
    if not path.lower().endswith(tuple("." + e for e in EXTENSIONS)):
        reader = reader.option("pathGlobFilter", GLOB)
    return reader.load(path)


def read_decoded(spark: SparkSession, path: str, label: str = "auto", sample: int = enc.SAMPLE_BYTES, fallback: str = enc.FALLBACK, only: Column | None = None) -> DataFrame:
    """(path, line_no, line, encoding, had_bom, confident) of files in any charset, or of those that only (of _metadata) selects. A file is read whole."""
    files = _reader(spark, path, "binaryFile")
    files = (files if only is None else files.where(only)).select("path", "content").withColumn("d", enc.detected(F.col("content"), label, sample, fallback))
    decoded = files.select("path", "d.*", enc.decode_lossy(F.col("content"), F.col("d.encoding")).alias("text"))
    each = decoded.select("path", "encoding", "had_bom", "confident", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1)).alias("pos", "line"))
    return each.select("path", (F.col("pos") + 1).alias("line_no"), "line", "encoding", "had_bom", "confident")


@contextmanager
def splitting(spark: SparkSession, path: str):
    """Within it files are split by split_size, and every scan of read() in the same way, whatever executors come and go."""
    total = _reader(spark, path, "binaryFile").agg(F.sum("length")).first()[0] or 0
    size = split_size(total, spark.sparkContext.defaultParallelism)
    settings = {"spark.sql.files.maxPartitionBytes": f"{size}b", "spark.sql.files.minPartitionNum": str(max(1, -(-total // size)))}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first bytes of a file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def _mark(head: bytes) -> str | None:
    """S2 of a file by its first bytes; UTF-16 also where these show it without a mark."""
    name, had_bom, _ = enc.detect_bytes(head[:3])
    if had_bom:
        return name
    return name if not charset.plain(head) and (name := charset.guess(head[: len(head) // 2 * 2], len(head))[0] or "").startswith("utf-16") else None


def _by_lines(label: str) -> bool:
    """Can a file of this charset be split at its bytes for line ends? UTF-8 and charsets of one byte a character."""
    name = enc.resolve_label(label)
    return name == "utf-8" or len(bytes(range(256)).decode(name, errors="replace")) == 256 and b"\r\n".decode(name, errors="replace") == "\r\n"


def read(spark: SparkSession, path: str, label: str = "auto", sample: int = enc.SAMPLE_BYTES, fallback: str = enc.FALLBACK, whole: int = 4 * MB) -> DataFrame:
    """As read_decoded(), but files above whole bytes are split between lines by the reader (S6), to be used within splitting().

    Only UTF-16 and charsets of several bytes need the whole file at once. In split files no empty line follows the last end
    of line, and the sample for legacy charsets is of the first line with a byte beyond ASCII.
    """
    small = read_decoded(spark, path, label, sample, fallback, F.col("_metadata.file_size") <= whole)
    large = _reader(spark, path, "binaryFile").where(F.col("_metadata.file_size") > whole).select("path", F.col("_metadata.file_path").alias("file")).collect()
    marks = {r.file: (r.path, _mark(_head(spark, r.path, sample))) for r in large}
    split = {f for f, (_, m) in marks.items() if m == "utf-8" or m is None and (_by_lines(fallback) if label == "auto" else _by_lines(label))}
    if rest := sorted(set(marks) - split):
        small = small.unionByName(read_decoded(spark, path, label, sample, fallback, F.col("_metadata.file_path").isin(rest)))
    if not split:
        return small
    rows = _reader(spark, path, "text").where(F.col("_metadata.file_path").isin(sorted(split)))
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), "value")
    each = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    beyond = F.regexp_instr(each, F.lit(r"[^\x00-\x7F]"))
    first = F.min(F.when(beyond > 0, F.struct("start", "row", F.substring(each, F.greatest(beyond - 16, F.lit(1)), F.lit(sample)).alias("legacy"))))
    blocks = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"), first.alias("first"))
    of_file = Window.partitionBy("file")
    blocks = blocks.select(
        "file", "start", "first_row", F.coalesce(F.sum("n").over(of_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.min("utf8").over(of_file).alias("utf8"), F.min("first").over(of_file)["legacy"].alias("legacy"),
    )
    known = spark.createDataFrame([(f, *marks[f]) for f in sorted(split)], "file string, path string, mark string")
    if label == "auto":  # line ends are no part of another character in any charset but UTF-16
        d = enc.detected(F.encode("legacy", "ISO-8859-1"), label, sample, fallback)
        name, sure = F.when(F.col("utf8"), "utf-8").otherwise(d["encoding"]), F.col("utf8") | d["confident"]
    else:
        name, sure = F.lit(enc.resolve_label(label)), F.lit(True)
    marked = F.col("mark").isNotNull()
    blocks = blocks.join(F.broadcast(known), "file").select("file", "start", "path", "first_row", "before", F.coalesce("mark", name).alias("encoding"), marked.alias("had_bom"), (marked | sure).alias("confident")).checkpoint()
    lines = rows.join(F.broadcast(blocks), ["file", "start"], "left")
    number = F.coalesce(F.col("before") + F.col("row") - F.col("first_row") + 1, F.raise_error(F.lit("files were split in another way, read within splitting()")).cast("bigint"))
    utf8 = F.col("encoding") == "utf-8"
    line = F.when(utf8, F.make_valid_utf8("value")).otherwise(enc.decode_lossy(F.when(~utf8, F.col("value").cast("binary")), F.col("encoding")))
    return small.unionByName(lines.select("path", number.alias("line_no"), line.alias("line"), "encoding", "had_bom", "confident"))


def chunk_bytes(size: Column, threads: Column) -> Column:
    """Size / max(threads * 64, 32), between 4 and 256 MB."""
    return F.least(F.lit(256 * MB), F.greatest(F.lit(4 * MB), F.floor(size / F.greatest(threads * 64, F.lit(32))))).cast("bigint")


def split_size(size: int, cores: int) -> int:
    """S7 for ``spark.sql.files.maxPartitionBytes``."""
    return min(256 * MB, max(4 * MB, size // max(cores * 64, 32)))


def write_quarantine(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet, with its schema also where nothing is quarantined."""
    df.write.mode(mode).parquet(path)


def write_statistics(df: DataFrame, path: str) -> None:
    """The one row of statistics as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)
