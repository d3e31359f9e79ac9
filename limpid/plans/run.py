"""One run from configuration to sinks, its cancellation, its progress and its figures as text."""

from __future__ import annotations

import logging
import os
import threading
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.functions import lines, text, urls
from limpid.operators import dedup, validate
from limpid.sources import files
from limpid.sources.config import Config
from limpid.session import prepare, written

log = logging.getLogger("limpid")


def judged_lines(raw: DataFrame, config: Config) -> DataFrame:
    """raw with the normalised line (clean_line), its first URL (found) and the first reason to reject it.

    A line without a URL is text, no URL reason applies to it. URLs are judged as they stand, before they are cleaned.
    """
    line = lines.trim(F.col("line"))
    if config.lines.unquote:
        line = lines.unquote(line)
    if config.lines.unicode_normalize:
        line = text.nfc(line)
    u = config.urls
    schemes = None if u.reject_unknown_schemes else text.FIND_SCHEMES
    pattern = text.url_pattern(schemes, u.url_pattern, None)
    out = raw.withColumn("clean_line", lines.drop_controls(line)).withColumn("found", text.first_url(F.col("clean_line"), pattern))
    refused = F.when(F.col("found").isNotNull(), F.concat(F.lit("url_"), validate.url_reason(F.col("found"), u.max_bytes, u.reject_unknown_schemes)))
    joined = F.when(text.credential_line(F.col("clean_line")), "credential")
    return out.withColumn("reject_reason", F.coalesce(lines.reject_reason(lines.trim(F.col("line")), config.lines.max_line_bytes, config.lines.skip_prefixes), joined, refused))


def clean_url(url: Column, config: Config) -> Column:
    """The printable characters of a URL (L9), with scheme (U1), port (U5), path (U6) and host (U7) as configured."""
    u, url = config.urls, lines.printable(url)
    if u.clean and u.strip_default_ports:
        url = urls.clean(url)
    else:
        if u.clean:
            url = urls.lower_scheme(url)
        if u.strip_default_ports:
            url = urls.strip_default_port(url)
        url = urls.lower_host(url)
    return urls.strip_path(url) if u.strip_paths else url


def safe_rows(raw: DataFrame, config: Config) -> DataFrame:
    """Every line judged once, with nothing in it that may not be written.

    path, line_no, n_bytes and reject_reason; of kept lines the redacted line and URL and a keyed hash of the line
    before redaction, which makes different lines equal; of rejected ones their keyed hash alone.
    """
    key = config.output.quarantine_key
    if not key:
        raise ValueError("set output.quarantine_key: without a key of one's own the hashes of short lines can be guessed")
    judged = judged_lines(raw, config)
    keep = F.col("reject_reason").isNull()
    at = F.instr("clean_line", F.col("found"))
    after = F.substring("clean_line", at + F.length("found"), F.length("clean_line"))
    url = clean_url(F.col("found"), config)
    whole = F.when(F.col("found").isNull(), F.col("clean_line")).otherwise(F.concat(F.substring("clean_line", F.lit(1), at - 1), url, after))
    email = text.email_pattern(config.urls.email_pattern)
    email = None if email == text.EMAIL else email
    line = text.redact(F.col("whole"), email)
    rows = judged.withColumns({"whole": F.when(keep, whole), "found": F.when(keep, url)})
    return rows.select(
        "path", "line_no", "reject_reason", F.octet_length("line").alias("n_bytes"), (lines.guard_cell(line) if config.lines.guard_cells else line).alias("line"),
        text.redact(F.col("found"), email).alias("url"), text.keyed_hash(F.col("whole"), key).alias("key"), F.when(~keep, text.keyed_hash(F.col("line"), key)).alias("line_hmac"),
    )


def plan(raw: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean lines, quarantine, statistics) of (path, line_no, line); all three are read from one written table.

    Clean lines hold their first URL cleaned; of lines that are then equal the first by path and number is kept.
    """
    rows = written(safe_rows(raw, config), "judged")
    clean = dedup.keep_first(rows.where("reject_reason is null").select("path", "line_no", "line", "url", "key"), F.col("key"), ["path", "line_no"]).drop("key")
    bad = rows.where("reject_reason is not null and reject_reason <> 'empty'").select("reject_reason", "path", "line_no", "line_hmac")
    return clean, bad, validate.run_statistics(rows, n_bytes=F.col("n_bytes"))


@contextmanager
def _told(spark: SparkSession, tell: Callable[[dict], None] | None, seconds: float = 0.5):
    """While inside, progress() is told every so many seconds."""
    if tell is None:
        yield
        return
    ended = threading.Event()

    def watch() -> None:
        while not ended.wait(seconds):
            progress(spark, tell)

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        ended.set()
        thread.join()


def run(spark: SparkSession, source: str, target: str, config: Config | None = None, tag: str = "limpid-run", tell: Callable[[dict], None] | None = None) -> dict:
    """Reads source once, writes target/clean, target/quarantine (by reason) and target/stats; returns the statistics.

    tell is called with the tasks done of each active stage, every half second (C3).
    """
    config = config or Config()
    prepare(spark).addTag(tag)
    began = time.time()
    try:
        with files.splitting(spark, source), _told(spark, tell):
            raw = files.read(spark, source, config.encoding.mode, config.encoding.sample_bytes, config.encoding.fallback_encoding)
            clean, bad, stats = plan(raw, config)
            clean.write.mode("overwrite").parquet(f"{target}/clean")
            files.write_quarantine(bad, f"{target}/quarantine", "overwrite")
            n = spark.read.parquet(f"{target}/clean").count()
            stats = stats.withColumns({"n_kept": F.lit(n).cast("bigint"), "n_duplicates": F.col("n_kept") - n})
            if config.output.export_stats:
                files.write_statistics(stats, f"{target}/stats")
            found = stats.first().asDict()
    finally:
        spark.removeTag(tag)
    seconds = time.time() - began
    log.info("%s lines in %s, %s", number(found["n_lines"]), duration(seconds), speed(found["n_lines"], seconds))
    return found | {"seconds": seconds, "lines_per_second": rate(found["n_lines"], seconds)}


def cancel(spark: SparkSession, tag: str = "limpid-run") -> list[str]:
    """Stops the jobs of a run; its tasks end at once, what was committed stays."""
    return spark.interruptTag(tag)


def progress(spark: SparkSession, tell: Callable[[dict], None]) -> list[dict]:
    """Tasks done of all active stages, told to a callback and returned."""
    tracker = spark.sparkContext.statusTracker()
    seen = []
    for stage in tracker.getActiveStageIds():
        info = tracker.getStageInfo(stage)
        if info:
            seen.append({"stage": stage, "name": info.name, "done": info.numCompletedTasks, "of": info.numTasks, "failed": info.numFailedTasks})
            tell(seen[-1])
    return seen


def rate(n: int, seconds: float) -> float:
    """A4: per second; 0 before any time has passed."""
    return n / seconds if seconds > 0 else 0.0


def remaining(done: int, total: int, seconds: float) -> float | None:
    """A4: seconds to go at the present rate; None while that is unknown."""
    return (total - done) / rate(done, seconds) if done and seconds > 0 else None


def number(n: int) -> str:
    """C4: with thousands separated by commas."""
    return f"{n:,}"


def speed(n: int, seconds: float) -> str:
    """C4: lines per second, in thousands or millions."""
    r = rate(n, seconds)
    return f"{r / 1e6:.1f}M/s" if r >= 1e6 else f"{r / 1e3:.1f}K/s" if r >= 1e3 else f"{r:.0f}/s"


def duration(seconds: float) -> str:
    """C4: h:mm:ss or m:ss."""
    s = int(seconds)
    return f"{s // 3600}:{s // 60 % 60:02}:{s % 60:02}" if s >= 3600 else f"{s // 60}:{s % 60:02}"


def workers() -> int:
    """Three quarters of the logical CPUs, at least 1; for a local session, a cluster has its own setting."""
    return max(1, (os.cpu_count() or 1) * 3 // 4)
