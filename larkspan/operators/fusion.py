"""Fusing two rankings, features of candidates and queries, and training rows for a learned ranker."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The fusion constant, and the ranks that stand for absence in the features.
CONSTANT = 60
ABSENT_FIRST, ABSENT_SECOND = 101.0, 1001.0
OVERLAP_DEPTHS = (5, 10, 20, 50, 100)


def fused(rows: DataFrame, case: list[str], item: str, place: str, weight: Column, depth: int, constant: Column | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of long lists: `case`, `item`, `score`, `rank` from 0.

    Each row is an item's `place` from 0 in one list; it adds weight / (constant + place + 1). Lists with a
    weight of 0 or less are left out. Best score first, of equals the smallest item; `depth` items are kept.
    """
    constant = F.lit(CONSTANT) if constant is None else constant
    part = rows.select(*case, item, weight.alias("_w"), (weight / (constant + F.col(place) + 1)).alias("_part")).filter("_w > 0")
    scores = part.groupBy(*case, item).agg(F.round(F.sum("_part"), 12).alias("score"))
    order = Window.partitionBy(*case).orderBy(F.col("score").desc(), F.col(item))
    ranked = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)
    return ranked.withColumn("rank", (F.col("rank") - 1).cast("bigint"))


def candidate_features(first: Column, second: Column) -> dict[str, Column]:
    """The eleven features of a candidate from its places from 0 in both lists (null where absent)."""
    has_first, has_second = first.isNotNull(), second.isNotNull()
    zero = F.lit(0.0)
    inverse = lambda has, place, by: F.when(has, 1.0 / (place + by)).otherwise(zero)
    a, b = inverse(has_first, first, 1.0), inverse(has_second, second, 1.0)
    c, d = inverse(has_first, first, 61.0), inverse(has_second, second, 61.0)
    log_rank = lambda has, place, absent: F.log1p(F.when(has, place + 1.0).otherwise(F.lit(absent))) / math.log(absent + 1)
    return {
        "first_reciprocal": a, "second_reciprocal": b, "first_rrf": c, "second_rrf": d,
        "in_first": has_first.cast("double"), "in_second": has_second.cast("double"), "in_both": (has_first & has_second).cast("double"),
        "first_log_rank": log_rank(has_first, first, ABSENT_FIRST), "second_log_rank": log_rank(has_second, second, ABSENT_SECOND),
        "product": a * b, "largest_rrf": F.greatest(c, d),
    }


def overlap_features(pairs: DataFrame, case: list[str], first: str, second: str) -> DataFrame:
    """Per case the shares of common items among the first 5 to 100 places, and the reciprocal agreement."""
    a, b = F.col(first), F.col(second)
    shared = [F.round(F.sum(((a < d) & (b < d)).cast("double")) / d, 9).alias(f"overlap_{d}") for d in OVERLAP_DEPTHS]
    both = F.when((a < 100) & (b < 100), 1.0 / ((a + 1.0) * (b + 1.0))).otherwise(F.lit(0.0))
    filled = [F.coalesce(c, F.lit(0.0)) for c in (F.sum(both),)]
    out = pairs.groupBy(*case).agg(*shared, F.round(F.log1p(filled[0]), 9).alias("agreement"))
    return out.na.fill(0.0, [f"overlap_{d}" for d in OVERLAP_DEPTHS])


def text_features(text: Column, tokens: Column) -> dict[str, Column]:
    """Features of a query's text: tokens, distinct tokens, any digit, upper-case letters."""
    filled = F.coalesce(text, F.lit(""))
    return {
        "n_tokens": F.size(tokens), "n_distinct": F.size(F.array_distinct(tokens)), "has_digit": filled.rlike(r"\p{Nd}"),
        "n_upper": F.length(F.regexp_replace(filled, r"[^\p{Lu}]", "")),
    }


def training_rows(pairs: DataFrame, case: list[str], item: str, gain: str, first: str, second: str, others: int = 100) -> DataFrame:
    """The candidates to learn from, with `label` and `weight`; each class of a case weighs one half in all.

    Positives have a gain. Hard negatives stand among the first 50 of the first or 100 of the second list.
    Of the other negatives those with the smallest hash stay, `others` at most.
    """
    positive = F.coalesce(F.col(gain), F.lit(0)) > 0
    hard = (F.coalesce(F.col(first), F.lit(10**9)) < 50) | (F.coalesce(F.col(second), F.lit(10**9)) < 100)
    marked = pairs.withColumn("label", positive.cast("int")).withColumn("_easy", ~positive & ~hard)
    order = Window.partitionBy(*case, "_easy").orderBy(F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in case], F.col(item).cast("string")), 256))
    kept = marked.withColumn("_r", F.row_number().over(order)).filter(~F.col("_easy") | (F.col("_r") <= others)).drop("_r", "_easy")
    return kept.withColumn("weight", F.lit(0.5) / F.count(F.lit(1)).over(Window.partitionBy(*case, "label")))
