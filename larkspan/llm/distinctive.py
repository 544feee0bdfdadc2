"""How characteristic a term is of a record against the whole collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.text import tokens
from larkspan.session import materialise

#: Terms with at least this share of all (record, term) rows count as common: at most 10,000 terms,
#: whatever the collection. Any other term has fewer rows than this share.
COMMON_SHARE = 1e-4
#: The prior weighs as much as this many tokens spread like the collection.
PRIOR_TOKENS = 500.0


def term_counts(records: DataFrame, record: str, text: Column) -> DataFrame:
    """Rows (record, record_tokens, term, tf) of whole texts; `records` must have one row per record."""
    found = records.select(F.col(record).alias("record"), tokens(text).alias("_tokens")).filter(F.col("record").isNotNull())
    return (
        found.select("record", F.size("_tokens").cast("bigint").alias("record_tokens"), F.explode("_tokens").alias("term"))
        .groupBy("record", "record_tokens", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def distinctiveness(counts: DataFrame, prior_tokens: float = PRIOR_TOKENS) -> DataFrame:
    """Per record and term: `tf`, `df`, and `z`, the log-odds ratio of record and rest in standard errors.

    The prior of a term is its share of the collection times `prior_tokens`. Terms that are as frequent
    in the record as elsewhere have a z near 0; a rare term that recurs in the record has a large one.
    A record that is the whole collection has no rest but the prior and stays defined. Records without
    tokens have no rows, nor has an empty collection. Counting terms aggregates partially in each task;
    the statistics of common terms are broadcast (see COMMON_SHARE), the others are joined by term.
    """
    counts = materialise(counts)  # read three times
    statistics = materialise(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("collection_tf")))
    sizes = statistics.agg(F.sum("df").alias("_rows"), F.sum("collection_tf").cast("double").alias("all_tokens"))
    statistics = statistics.join(F.broadcast(sizes))  # one row
    is_common = F.col("df") >= F.lit(COMMON_SHARE) * F.col("_rows")
    common = statistics.filter(is_common)
    joined = counts.join(F.broadcast(common.withColumnRenamed("term", "_term")), F.col("term") == F.col("_term"), "left")
    near = joined.filter(F.col("_term").isNotNull()).drop("_term")
    far = counts.join(F.broadcast(common.select("term")), "term", "left_anti").join(statistics.filter(~is_common), "term")
    both = near.unionByName(far)
    own, all_own = F.col("tf").cast("double"), F.col("record_tokens").cast("double")
    rest, all_rest = F.col("collection_tf") - own, F.col("all_tokens") - all_own
    prior = F.lit(prior_tokens) * F.col("collection_tf") / F.col("all_tokens")
    # A term that is the whole collection leaves no odds; half a token keeps them finite.
    odds = lambda n, total: F.ln((n + prior) / F.greatest(total + F.lit(prior_tokens) - n - prior, F.lit(0.5)))
    error = F.sqrt(1 / (own + prior) + 1 / (rest + prior))
    return both.select("record", "term", "tf", "df", ((odds(own, all_own) - odds(rest, all_rest)) / error).alias("z"))
