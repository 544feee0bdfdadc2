"""Sessions, input tables and the shared scratch space that cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDERS: list[str] = []


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("larkspan")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or the context's checkpoint folder.

    Only a session on one machine gets a temporary folder of its own where neither is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="larkspan-")
    _OWN_FOLDERS.append(own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` to the shared scratch space and read it back: lineage is cut, sizes become known.

    The table is deleted when the driver's JVM ends, or before by `discard`.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/larkspan-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:  # what a failed write left goes, too
        at, files = _file(spark, path)
        files.deleteOnExit(at)
    again = spark.read.schema(df.schema).parquet(path)
    again._larkspan_path = path
    return again


def _file(spark: SparkSession, path: str):
    """The Hadoop path of a file or folder and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(df: DataFrame) -> None:
    """Delete a table made by `materialise` that nothing reads any more."""
    path = getattr(df, "_larkspan_path", None)
    if path:
        at, files = _file(df.sparkSession, path)
        files.delete(at, True)
        files.cancelDeleteOnExit(at)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


@atexit.register
def _remove_own_folders() -> None:
    for folder in _OWN_FOLDERS:
        shutil.rmtree(folder, ignore_errors=True)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """`df` with a broadcast hint if it has at most `most` rows, counted first; else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
