"""A sample that is the same in every run and keeps its members as data grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.operators.numbering import dense_numbers, hash_key, prefix_length
from larkspan.session import discard, materialise
from larkspan.sources.writers import parts

#: Fractions are whole numbers of 2^-48. The multiplier is 2^48 divided by the golden ratio, made odd.
UNIT = 2**48
GOLDEN = 173961102589771


def golden_fraction(number: Column, shift: float) -> Column:
    """The number's multiple of the golden ratio plus `shift`, modulo 1, in units of 2^-48 (exact)."""
    start = int(shift * UNIT) % UNIT
    product = number.cast("decimal(19,0)") * F.lit(GOLDEN).cast("decimal(15,0)") + F.lit(start).cast("decimal(15,0)")
    return F.pmod(product, F.lit(UNIT).cast("decimal(16,0)")).cast("bigint")


def distinct_keys(df: DataFrame, key: Column, batch: Column) -> DataFrame:
    """One row (key, first_batch) per distinct key; null keys have none, unknown batches count only where there's no other."""
    once = df.select(key.alias("key"), batch.cast("bigint").alias("batch")).filter(F.col("key").isNotNull())
    return once.groupBy("key").agg(F.min("batch").alias("first_batch"))


def new_numbers(once: DataFrame, known: DataFrame | None, per_bucket: int | None = None) -> DataFrame:
    """(key, first_batch, sequence_no) of the keys of `once` that `known` lacks, numbered behind its largest number.

    They are numbered by the first batch that delivered them (unknown batches last), within a batch by a
    hash of the key.
    """
    if known is not None:
        once = once.join(known.select("key"), "key", "left_anti")
    once = materialise(once)
    size = {} if per_bucket is None else {"per_bucket": per_bucket}
    hashed = once.withColumn("order", hash_key(F.col("key"))).withColumn("late", F.col("first_batch").isNull())
    hashed = hashed.withColumn("prefix", F.substring("order", 1, prefix_length(once.count(), **size)))
    start = 0 if known is None else known.agg(F.max("sequence_no")).first()[0]  # one number
    numbered = dense_numbers(hashed, [], ["late", "first_batch", "prefix"], ["order", "key"], "sequence_no")
    begin = 0 if known is None or start is None else start + 1
    return numbered.select("key", "first_batch", (F.col("sequence_no") + F.lit(begin)).cast("bigint").alias("sequence_no"))


def sequence_numbers(df: DataFrame, key: Column, batch: Column, known: DataFrame | None = None, per_bucket: int | None = None) -> DataFrame:
    """One row per distinct key: `key`, `first_batch`, `sequence_no`.

    Without `known` numbers don't change as long as keys arrive in later batches than all before. Where a
    batch, or the keys of unknown batch, can still grow, `known` (key, first_batch, sequence_no) keeps the
    numbers given before: new keys follow behind the largest, nothing is inserted. `persistent_numbers`
    keeps that table. A repeated delivery adds no number. Null keys have no row; ties can't occur, as keys
    are distinct; an empty input gives an empty table.
    """
    fresh = new_numbers(distinct_keys(df, key, batch), known, per_bucket)
    return fresh if known is None else known.select("key", "first_batch", "sequence_no").unionByName(fresh)


def persistent_numbers(df: DataFrame, key: Column, batch: Column, path: str, per_bucket: int | None = None) -> DataFrame:
    """`sequence_numbers` of the keys of `df`, with the numbers kept in an append-only table at `path`.

    Each call reads the numbers given so far and appends a part with those of new keys, if there are any;
    so a key has the same number in every later call, whatever arrives, in whatever batch, and in whatever
    order. `path` must lie in a folder that all executors share and have one writer at a time. A part
    that a lost run left unfinished is passed over.
    """
    spark = df.sparkSession
    once = materialise(distinct_keys(df, key, batch))
    done, after = parts(spark, path)
    known = spark.read.parquet(*done) if done else None
    fresh = materialise(new_numbers(once, known, per_bucket))
    if not fresh.isEmpty():
        fresh.write.mode("error").parquet(after)
        done = [*done, after]
    discard(fresh)
    if not done:
        return once.select("key", "first_batch", F.lit(None).cast("bigint").alias("sequence_no")).limit(0)
    kept = spark.read.parquet(*done).select("key", "first_batch", "sequence_no")
    return kept if known is None else kept.join(once.select("key"), "key", "left_semi")


def stable_sample(sequenced: DataFrame, share: float, shift: float = 0.3819) -> DataFrame:
    """The rows whose golden-ratio fraction lies in the first `share` of [0, 1), with that `fraction`.

    Fractions of consecutive numbers are a low-discrepancy sequence: of any run of numbers the part
    selected differs from `share` by a few rows. A larger share contains every smaller one's rows.
    `share` outside [0, 1] raises.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must lie between 0 and 1")
    placed = sequenced.withColumn("fraction", golden_fraction(F.col("sequence_no"), shift))
    return placed.filter(F.col("fraction") < F.lit(int(share * UNIT)))
