"""Per-key results where a few keys hold most rows.

Every result goes through value-frequency compression: rows are first grouped by key *and* value, which
spreads a hot key over all tasks and shrinks it to its distinct values; counts, sums, modes and percentiles
of a key then come from the weighted values. No step gathers the rows or values of one key in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.session import materialise


def value_frequencies(df: DataFrame, key: Column, value: Column, *extra: Column) -> DataFrame:
    """Rows (key, value, n): how often each value occurs with each key.

    A null key makes no row. A null value is kept as a value, so that a key with nulls only stays visible.
    `extra` are aggregates computed per key and value. Repeated rows add to `n`. An empty input gives no rows.
    """
    return (
        df.select(key.alias("key"), value.alias("value"), *[F.col(f"`{c}`").alias(f"in_{c}") for c in df.columns])
        .filter(F.col("key").isNotNull())
        .groupBy("key", "value")
        .agg(F.count(F.lit(1)).alias("n"), *extra)
    )


def key_totals(frequencies: DataFrame, *extra: Column) -> DataFrame:
    """Per key: `rows` (all), `filled` (with a value), `distinct_values`, and the aggregates in `extra`.

    Each task first reduces its part of a key to one row, so a hot key sends one row per task.
    """
    return frequencies.groupBy("key").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"),
        F.count("value").alias("distinct_values"),
        *extra,
    )


def key_modes(frequencies: DataFrame) -> DataFrame:
    """Per key the most frequent value `mode` and its count `mode_rows`; of equals the smallest value."""
    top = F.struct((-F.col("n")).alias("less"), F.col("value").alias("value"))
    return (
        frequencies.filter(F.col("value").isNotNull())
        .groupBy("key")
        .agg(F.min(top).alias("top"))
        .select("key", F.col("top.value").alias("mode"), (-F.col("top.less")).alias("mode_rows"))
    )


def key_percentiles(frequencies: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles per key, linearly interpolated; one column per name in `shares`.

    The weighted values are laid out by range of (key, value), so that a hot key lies in many partitions.
    Running weights come from a window per partition and key plus the weight of the key's earlier
    partitions. Nulls don't count; a key without values has no row.
    """
    ranged = materialise(
        frequencies.filter(F.col("value").isNotNull())
        .select("key", F.col("value").cast("double").alias("value"), "n")
        .repartitionByRange("key", "value")
        .withColumn("part", F.spark_partition_id())
    )
    parts = ranged.groupBy("key", "part").agg(F.sum("n").alias("weight"))
    every = Window.partitionBy("key")
    parts = parts.select(
        "key",
        "part",
        F.coalesce(F.sum("weight").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(every).alias("total"),
    )
    upto = Window.partitionBy("key", "part").orderBy("value")
    placed = ranged.withColumn("upto", F.sum("n").over(upto)).join(parts, ["key", "part"])
    last = F.col("before") + F.col("upto") - 1
    first = last - F.col("n") + 1
    picks = []
    for name, share in shares.items():
        at = (F.col("total") - 1) * F.lit(float(share))
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((place >= first) & (place <= last), F.col("value"))).alias(f"{side}_{name}"))
    found = placed.groupBy("key").agg(F.max("total").alias("total"), *picks)
    columns = []
    for name, share in shares.items():
        at = (F.col("total") - 1) * F.lit(float(share))
        low, high = F.col(f"lo_{name}"), F.col(f"hi_{name}")
        columns.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select("key", *columns)


def heavy_keys(totals: DataFrame, size: str, share: float) -> DataFrame:
    """The keys whose `size` is at least `share` of the sum over all keys; at most 1/share rows."""
    whole = totals.agg(F.sum(size).alias("_whole"))
    return (
        totals.join(F.broadcast(whole))  # one row
        .filter((F.col(size) > 0) & (F.col(size) >= F.lit(share) * F.col("_whole")))
        .drop("_whole")
    )
