"""Dense row numbers in which no task ever holds a whole group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task may sort for a number; the length of the hash prefix follows from it.
ROWS_PER_BUCKET = 200_000


def hash_key(*columns: Column) -> Column:
    """A fixed random order of rows: SHA-256 as hex over the columns' text; nulls have a mark of their own."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def prefix_length(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Hex digits of a hash that split `rows` into buckets of about `per_bucket` rows at most."""
    return 0 if rows <= per_bucket else math.ceil(math.log(rows / per_bucket, 16))


def dense_numbers(df: DataFrame, within: list[str], buckets: list[str], order: list[str], name: str) -> DataFrame:
    """Add `name`: the row's place from 0 in its `within` group, in the order of `buckets`, then `order`.

    The places within a bucket come from a window over that bucket, the buckets' starts from a running
    sum over the counts of buckets. A group of any size is thus spread over as many tasks as it has buckets.
    Nulls are keys like others. `order` must tell the rows of a bucket apart for a stable result.
    """
    keys = [*within, *buckets]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*within).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
    )
    here = df.withColumn("_here", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        here.join(starts, same)
        .withColumn(name, F.col("_start") + F.col("_here") - 1)
        .drop("_start", "_here", *[f"_k{i}" for i in range(len(keys))])
    )
