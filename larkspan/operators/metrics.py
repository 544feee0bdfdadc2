"""Ranking metrics, interval estimates and choices between operating points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.session import materialise


def gain_value(gain: Column) -> Column:
    return F.pow(F.lit(2.0), gain) - 1


def discount(rank: Column) -> Column:
    return F.log2(rank + 2.0)


def query_metrics(ranking: DataFrame, judged: DataFrame, case: list[str], item: str = "doc_idx", query: str = "query_id") -> DataFrame:
    """Per judged case: ndcg10, mrr10, hit10, recall10, recall100, relevant.

    `ranking` has `case` (with the query), the item and `rank` from 0; `judged` has query, item and gain.
    Cases of queries without a positive judgement are left out. The ideal order holds all judged items,
    ranked or not.
    """
    relevant = judged.filter("gain > 0")
    ideal_rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col("gain").desc(), F.col(item))) - 1
    ideal = relevant.withColumn("_i", ideal_rank).groupBy(query).agg(
        F.sum(F.when(F.col("_i") < 10, gain_value(F.col("gain")) / discount(F.col("_i"))).otherwise(F.lit(0.0))).alias("_ideal"),
        F.count(F.lit(1)).alias("relevant"),
    )
    hits = ranking.select(*case, item, "rank").join(relevant.select(query, item, "gain"), [query, item], "left")
    found = F.col("gain").isNotNull()
    near = found & (F.col("rank") < 10)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = hits.groupBy(*case).agg(
        zero(F.sum(F.when(near, gain_value(F.col("gain")) / discount(F.col("rank"))))).alias("_dcg"),
        zero(F.max(F.when(near, 1.0 / (F.col("rank") + 1)))).alias("mrr10"),
        F.sum(near.cast("int")).alias("_near"), F.sum((found & (F.col("rank") < 100)).cast("int")).alias("_far"),
    )
    out = per.join(ideal, query)
    return out.select(
        *case, F.round(F.col("_dcg") / F.col("_ideal"), 9).alias("ndcg10"), F.round("mrr10", 9).alias("mrr10"), (F.col("_near") > 0).alias("hit10"),
        F.round(F.col("_near") / F.col("relevant"), 9).alias("recall10"), F.round(F.col("_far") / F.col("relevant"), 9).alias("recall100"), "relevant",
    )


def metric_means(per_query: DataFrame, repeat: str, *by: str) -> DataFrame:
    """Means over queries, then over repeats, and the repeats' sample deviation (0 for one repeat)."""
    names = ["ndcg10", "mrr10", "recall10", "recall100"]
    inner = per_query.groupBy(*by, repeat).agg(*[F.avg(n).alias(n) for n in names])
    spread = F.coalesce(F.stddev_samp("ndcg10"), F.lit(0.0))
    return inner.groupBy(*by).agg(*[F.round(F.avg(n), 6).alias(n) for n in names], F.round(spread, 6).alias("ndcg10_deviation"), F.count(F.lit(1)).alias("repeats"))


def outcome_shares(pairs: DataFrame, first: str, second: str, *by: str) -> DataFrame:
    """Mean difference second - first and the shares of wins, ties and losses at 1e-12."""
    d = F.col(second) - F.col(first)
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg(d), 9).alias("mean_difference"),
        share(d > 1e-12).alias("wins"), share(F.abs(d) <= 1e-12).alias("ties"), share(d < -1e-12).alias("losses"),
    )


def paired_bootstrap(differences: DataFrame, value: str, resamples: int = 5000, seed: int = 11, per_bucket: int = 20_000) -> DataFrame:
    """One row: mean, 95 % interval and one-sided p value of a mean difference by bootstrap.

    Equal values are counted first. Distinct values are spread over buckets by hash; of each resample's
    draws a multinomial draw gives each bucket its number, and within a bucket another one gives each
    value its own. So the result has the distribution of drawing from all rows, no value is rounded, and
    a task holds one bucket of about `per_bucket` values. Null and NaN values are left out; without rows all is null.
    """
    clean = differences.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    counted = materialise(clean.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    buckets = max(1, -(-counted.count() // per_bucket))
    spread = counted.withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(buckets)))
    sizes = {r["bucket"]: r["n"] for r in spread.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # one row per bucket
    totals = np.array([sizes.get(b, 0) for b in range(buckets)], dtype=np.int64)
    whole = int(totals.sum())

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        values, share = pdf["v"].to_numpy(), pdf["n"].to_numpy() / pdf["n"].sum()
        bucket = int(pdf["bucket"].iloc[0])
        # The same generator in every task: all know how many draws each bucket has in each resample.
        draws = np.random.default_rng([seed, 0]).multinomial(whole, totals / whole, size=resamples)[:, bucket]
        random = np.random.default_rng([seed, 1, bucket])
        sums = np.array([random.multinomial(k, share) @ values for k in draws])
        return pd.DataFrame({"resample": np.arange(resamples), "total": sums})

    sums = spread.groupBy("bucket").applyInPandas(draw, "resample bigint, total double")
    means = sums.groupBy("resample").agg((F.sum("total") / F.lit(float(max(whole, 1)))).alias("mean"))
    observed = counted.agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean_difference"), F.sum("n").alias("cases"))
    interval = means.agg(
        F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"),
        ((1 + F.sum((F.col("mean") <= 0).cast("int"))) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.count(F.lit(1)).alias("resamples"),
    )
    return observed.join(interval)  # one row each


def wilson_interval(hits: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson score interval of a share; (0, 0) without trials."""
    n = F.greatest(trials.cast("double"), F.lit(1.0))
    p = hits / n
    middle, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    edge = lambda c: F.when(trials > 0, c).otherwise(F.lit(0.0))
    return edge((middle - width) / scale), edge((middle + width) / scale)


def operating_point(rows: DataFrame, point: str, ndcg_reference: float, recall_reference: float) -> DataFrame:
    """The smallest point with 98 % of the reference nDCG and 95 % of its recall, else the best worst ratio.

    `rows` has one row per point with ndcg10 and recall100; of equal ratios the smallest point is taken.
    """
    a, b = F.col("ndcg10") / max(ndcg_reference, 1e-12), F.col("recall100") / max(recall_reference, 1e-12)
    good = (F.col("ndcg10") >= 0.98 * ndcg_reference) & (F.col("recall100") >= 0.95 * recall_reference)
    marked = rows.withColumn("eligible", good).withColumn("_ratio", F.when(good, 0.0).otherwise(F.least(a, b)))
    return marked.orderBy(F.col("eligible").desc(), F.col("_ratio").desc(), point).limit(1).drop("_ratio")
