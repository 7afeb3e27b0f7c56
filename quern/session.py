"""Session helpers: where shared intermediate tables live."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and runs in one process (tests, local
    mode). On a cluster a missing setting is an error: executors do not see each other's local files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stored(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without recomputing ``df``, and
    keys drawn by a sampling exchange stay as they were drawn. All tables of an application are in one
    folder, which goes when its driver ends; :func:`discard` deletes one that is read no more earlier.
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        fs, p = _files(spark, home)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _HOMES.add(home)
    path = f"{home}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


_HOMES: set[str] = set()


def discard(df: DataFrame | None) -> None:
    """Delete a table made by :func:`stored` that nothing reads any more."""
    path = getattr(df, "_quern_path", None)
    if path:
        fs, p = _files(df.sparkSession, path)
        fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Spark does so when the driver's objects are collected, which a small driver heap puts off for long;
    one operator whose steps each exchange most of the input calls this between them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
