"""Writers: reports, tables per build step, and model files."""

from __future__ import annotations

from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def report(rows: DataFrame, path: str) -> None:
    """One JSON document per row. The commit protocol makes the folder appear whole or not at all."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def stored(rows: DataFrame, path: str, partition: list[str] | None = None, codec: str = "zstd") -> DataFrame:
    """Write a compressed table, by partition columns (such as the cell of postings) if given, and read it back."""
    writer = rows.write.mode("overwrite").option("compression", codec)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return rows.sparkSession.read.parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written completely."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def resumable(spark: SparkSession, path: str, parameters: dict[str, object], build, partition: list[str] | None = None) -> DataFrame:
    """The table `build()` makes, by partition columns if given, taken from `path` if it was finished there with the same parameters.

    The parameters are part of the folder's name, so a table of other parameters is never taken for it;
    an unfinished table is built anew.
    """
    name = "-".join(f"{k}={v}" for k, v in sorted(parameters.items())) or "all"
    at = f"{path}/{name}"
    if not finished(spark, at):
        return stored(build(), at, partition)
    return spark.read.parquet(at)


def parts(spark: SparkSession, path: str) -> tuple[list[str], str]:
    """The complete parts of an append-only table at `path`, in their order, and the folder of the next part.

    A part is written as a table of its own into the next folder, with an error if that exists; one that was
    never finished is passed over. There must be one writer at a time.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []
    numbers = [n for n in names if n.startswith("part-") and n[5:].isdigit()]
    last = int(numbers[-1][5:]) if numbers else 0
    return [f"{path}/{n}" for n in numbers if finished(spark, f"{path}/{n}")], f"{path}/part-{last + 1:08}"


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind: type[MLReadable], path: str):
    return kind.load(path)
