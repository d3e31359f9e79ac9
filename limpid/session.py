"""What operators need of the session: shared storage, the library on the workers, tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Folders made by new_folder(), by application.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset a local session gets a temporary folder, removed when Python ends; a cluster gets an error,
    since a folder of one machine is lost to the others and with its executor.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="limpid-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table or a stream's checkpoint."""
    path = f"{shared_dir(spark)}/limpid-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as a table and read again: lineage is cut, columns are compressed and read one by one."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean_up(spark: SparkSession) -> int:
    """Deletes what this session's operators left in the shared folder: written tables, streams' states, checkpointed rows.

    To be called once their results have been used, as these read from there. Returns the number of folders deleted.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    jvm, own = spark.sparkContext._jvm, spark.sparkContext.getCheckpointDir()
    if own:
        root = jvm.org.apache.hadoop.fs.Path(own)
        system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(root):
            paths += [str(f.getPath()) for f in system.listStatus(root) if str(f.getPath().getName()).startswith("rdd-")]
    for path in paths:
        _delete(spark, path)
    return len(paths)


def prepare(spark: SparkSession) -> SparkSession:
    """Checkpoint folder set, library importable by Python workers."""
    shared_dir(spark)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
