"""One ranking from several lists whose scores have different scales."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.session import small

#: Terms of the incomplete beta function's series; at an argument of 0.5 the rest is below 1e-18.
TERMS = 60
#: The order statistics of every subset of the lists are prepared; more lists raise an error.
MOST_LISTS = 12


def ln_gamma(z: Column) -> Column:
    """The logarithm of the gamma function for z > 0: Stirling's series at z + 8."""
    y = z + 8
    rising = reduce(lambda p, i: p * (z + i), range(1, 8), z)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7))) + 1 / (1188 * F.pow(y, F.lit(9)))
    return (y - 0.5) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(rising)


def beta_coefficients(a: Column, b: Column) -> Column:
    """The array of c_j with I_x(a, b) = x^a * sum of c_j x^j, for x of at most one half and positive a, b."""
    scale = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b))
    grown = lambda done, j: F.concat(done, F.array(F.element_at(done, -1) * (j - b) / j))
    rising = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), F.array(F.lit(1.0)), grown)
    return F.transform(rising, lambda r, j: scale * r / (a + j))


def _series(x: Column, a: Column, coefficients: Column) -> Column:
    powers = F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda sum_, c: sum_ * x + c)
    return F.pow(x, a) * powers


def beta_probability(x: Column, a: Column, b: Column, lower: Column, upper: Column) -> Column:
    """I_x(a, b), with the coefficients of (a, b) in `lower` and those of (b, a) in `upper`."""
    small = _series(x, a, lower)
    large = 1 - _series(1 - x, b, upper)
    return F.when(x >= 1, F.lit(1.0)).when(x <= 0.5, small).otherwise(F.greatest(large, F.lit(0.0)))


def list_shares(weights: DataFrame, by: list[str], which: str, lists: tuple[str, ...]) -> DataFrame:
    """(by, shares array<double>): the lists' shares of the weight, in the order of `lists`, from rows (by, which, weight).

    Of repeats the largest counts, a negative one as 0. A null or NaN weight is the mean of the others; a
    list whose weight is 0 takes no part. Where no list has a positive weight, all weigh the same.
    """
    clean = F.when(F.col("weight").isNotNull() & ~F.isnan("weight"), F.greatest("weight", F.lit(0.0)))
    each = weights.groupBy(*by).agg(F.array(*[F.max(F.when(F.col(which) == name, clean)) for name in lists]).alias("_told"))
    known = F.filter("_told", lambda w: w.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda s, w: s + w) / F.greatest(F.size(known), F.lit(1))
    each = each.withColumn("_mean", mean).withColumn("_given", F.transform("_told", lambda w: F.coalesce(w, F.col("_mean"))))
    total = F.aggregate("_given", F.lit(0.0), lambda s, w: s + w)
    equal = F.array(*[F.lit(1.0 / len(lists))] * len(lists))
    return each.select(*by, F.when(total > 0, F.transform("_given", lambda w: w / total)).otherwise(equal).alias("shares"))


def order_statistics(shares: DataFrame, lists: int) -> DataFrame:
    """(n, a, lower, upper): the coefficients of every order statistic that the rows `shares` can need.

    In a case of n lists the k-th smallest rank has the distribution Beta(k, n + 1 - k). With weights, k
    is replaced by n times the share a of the lists that come first; equal weights give the usual k.
    """
    counted = shares.withColumn("n", F.size(F.filter("shares", lambda s: s > 0)))
    first = [reduce(lambda x, y: x + y, [F.col("shares")[i] for i in range(lists) if mask >> i & 1]) for mask in range(1, 2**lists - 1)]
    each = counted.select("n", F.explode(F.array(*first)).alias("a")) if first else counted.select("n", F.lit(1.0).alias("a"))
    tables = each.select("n", F.round(F.col("n") * F.col("a"), 9).alias("a")).filter("a > 0 and a < n").distinct()
    b = F.col("n") + 1 - F.col("a")
    return tables.withColumn("lower", beta_coefficients(F.col("a"), b)).withColumn("upper", beta_coefficients(b, F.col("a")))


def list_ranks(entries: DataFrame, case: list[str], which: str, item: str, score: str, place: str | None = None) -> DataFrame:
    """Each item's rank from 1 in its list, best score first: `case`, `which`, `item`, `list_rank`, `place`.

    Null and NaN scores come last. Equal scores follow `place`, then the item. Of an item's repeats in a
    list the best counts. Rows with a null item are no entries. Entries are shuffled once, by case: all
    that follows here and in `robust_aggregation` finds a case's rows together.
    """
    filled = F.when(F.isnan(F.col(score)), None).otherwise(F.col(score))
    spot = F.col(place) if place else F.lit(None).cast("int")
    best = entries.filter(F.col(item).isNotNull()).select(*case, which, item, filled.alias("_score"), spot.alias("place")).repartition(*case)
    best = best.groupBy(*case, which, item).agg(F.max("_score").alias("_score"), F.min("place").alias("place"))
    order = Window.partitionBy(*case, which).orderBy(F.col("_score").desc_nulls_last(), F.col("place").asc_nulls_last(), item)
    return best.withColumn("list_rank", F.row_number().over(order)).drop("_score")


def robust_aggregation(ranks: DataFrame, weights: DataFrame, case: list[str], which: str, item: str, lists: tuple[str, ...], by: list[str]) -> DataFrame:
    """Robust rank aggregation of any number of lists per case; `final_rank` 1 is the most significant item.

    A rank is divided by the number of items in the case, so only ranks count and no score's range does;
    an item missing in a list has the normalised rank 1. Sorted, the ranks are compared with the order
    statistics of random lists (`order_statistics`); the smallest probability times the number of lists
    (at most 1) is the item's `significance`. Of equal ranks only the last order statistic counts. Equal
    significances are ordered by the weighted mean rank, then the item. `weights` has rows (by, which,
    weight), see `list_shares`; cases without any weigh all lists equally. Besides come the arrays `ranks`
    and `places` in the order of `lists`, null where the item is missing. Lists not named take no part.
    """
    n = len(lists)
    if not 1 <= n <= MOST_LISTS:
        raise ValueError(f"between 1 and {MOST_LISTS} lists can be merged")
    pick = lambda column: F.array(*[F.max(F.when(F.col(which) == name, F.col(column))) for name in lists])
    kept = [*case, *[c for c in by if c not in case], item]
    items = ranks.filter(F.col(which).isin(*lists)).groupBy(*kept).agg(pick("list_rank").alias("ranks"), pick("place").alias("places"))
    shares = list_shares(weights, by, which, lists)
    equal = F.array(*[F.lit(1.0 / n)] * n)
    tables = small(order_statistics(shares.select("shares").unionByName(weights.sparkSession.range(1).select(equal.alias("shares"))), n))
    joined = items.join(small(shares), by, "left").withColumn("shares", F.coalesce("shares", equal))
    joined = joined.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*case)).cast("double"))
    of = lambda i: F.struct(F.coalesce(F.col("ranks")[i] / F.col("_n"), F.lit(1.0)).alias("x"), F.lit(i).alias("i"), F.col("shares")[i].alias("share"))
    joined = joined.withColumn("_s", F.array_sort(F.filter(F.array(*map(of, range(n))), lambda e: e["share"] > 0)))
    joined = joined.withColumn("_k", F.size("_s"))
    # For each place in the order: the rank, what comes first, and whether the next rank is the same.
    at = lambda k: F.get("_s", F.lit(k))
    found = F.when(F.col("_k") > 0, F.pow(F.element_at("_s", -1)["x"], F.col("_k").cast("double")))
    upto = F.lit(0.0)
    probabilities = [found]
    for k in range(n - 1):
        upto = upto + at(k)["share"]
        joined = joined.withColumn(f"_a{k}", F.when((F.col("_k") > k + 1) & (at(k)["x"] < at(k + 1)["x"]), F.round(F.col("_k") * upto, 9)))
        joined = joined.join(tables.select(F.col("n").alias("_k"), F.col("a").alias(f"_a{k}"), F.col("lower").alias(f"_l{k}"), F.col("upper").alias(f"_u{k}")), ["_k", f"_a{k}"], "left")
        a = F.col(f"_a{k}")
        probabilities.append(F.when(a.isNotNull(), beta_probability(at(k)["x"], a, F.col("_k") + 1 - a, F.col(f"_l{k}"), F.col(f"_u{k}"))))
    smallest = probabilities[0] if n == 1 else F.least(*probabilities)
    mean = F.aggregate("_s", F.lit(0.0), lambda s, e: s + e["x"] * e["share"])
    scored = joined.withColumn("significance", F.least(F.lit(1.0), F.col("_k") * smallest)).withColumn("_mean", mean)
    order = Window.partitionBy(*case).orderBy(F.round(F.ln("significance"), 9), F.round("_mean", 9), item)
    return scored.withColumn("final_rank", F.row_number().over(order)).select(*kept, "ranks", "places", "significance", "final_rank")
