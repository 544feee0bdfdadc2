"""Learned fusion: a boosted ranker over candidates and a forest that routes queries to weights."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Depths of trees in place of 7, 15 and 31 leaves.
DEPTHS = (3, 4, 5)


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(rows)


def fit_ranker(rows: DataFrame, features: list[str], depth: int = 3, rounds: int = 120, rate: float = 0.06, least: int = 40, seed: int = 7):
    """A boosted classifier of `label`, weighted by `weight`; the seed fixes the result for fixed partitions."""
    ranker = GBTClassifier(maxIter=rounds, stepSize=rate, maxDepth=depth, minInstancesPerNode=least, weightCol="weight", labelCol="label", seed=seed)
    return ranker.fit(assembled(rows, features))


def learned_ranking(model, rows: DataFrame, features: list[str], case: list[str], item: str, depth: int) -> DataFrame:
    """Candidates by the model's probability (rounded to 9 places), of equals the smallest item."""
    scored = model.transform(assembled(rows, features)).withColumn("score", F.round(vector_to_array("probability")[1], 9))
    order = Window.partitionBy(*case).orderBy(F.col("score").desc(), F.col(item))
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)
    return best.select(*case, item, "score", (F.col("rank") - 1).cast("bigint").alias("rank"))


def masked_ranking(model, rows: DataFrame, features: list[str], case: list[str], item: str, place: str, mask: Column, depth: int) -> DataFrame:
    """`learned_ranking` of the cases where `mask` holds; all others keep the first list, by its `place` (null where absent).

    `mask` must be the same for all rows of a case. A kept entry's score is null.
    """
    learned = learned_ranking(model, rows.filter(mask), features, case, item, depth)
    kept = rows.filter(~F.coalesce(mask, F.lit(False)) & F.col(place).isNotNull())
    rank = F.row_number().over(Window.partitionBy(*case).orderBy(place, item))
    kept = kept.withColumn("rank", rank).filter(F.col("rank") <= depth)
    return learned.unionByName(kept.select(*case, item, F.lit(None).cast("double").alias("score"), (F.col("rank") - 1).cast("bigint").alias("rank")))


def fit_router(rows: DataFrame, features: list[str], target: str, trees: int = 50, depths: tuple[int, ...] = (3, 5), folds: int = 3, seed: int = 7):
    """A forest that predicts each query's best weight, its depth chosen by cross-validation.

    Classes weigh the same: each row's weight is the inverse of its class's frequency. Folds follow the hash of
    `query_id`, so they don't depend on partitions; empty ones are left out. Where all rows are in one
    fold nothing can be validated, and the least depth is taken. Returns the model and the weights it chooses from.
    """
    sizes = rows.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))  # one row per weight tried
    names = sorted(r[target] for r in sizes.collect())
    index = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(float(i)))])
    fold = F.pmod(F.conv(F.substring(F.sha2("query_id", 256), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")
    given = rows.join(F.broadcast(sizes), target).withColumn("label", index[F.col(target)]).withColumn("weight", 1.0 / F.col("_n")).withColumn("fold", fold)
    forest = RandomForestClassifier(numTrees=trees, minInstancesPerNode=15, weightCol="weight", labelCol="label", seed=seed)
    ready = assembled(given, features)
    present = sorted(r["fold"] for r in given.select("fold").distinct().collect())  # at most `folds` rows
    if len(present) < 2:
        return forest.setMaxDepth(depths[0]).fit(ready), names
    grid = ParamGridBuilder().addGrid(forest.maxDepth, list(depths)).build()
    judge = MulticlassClassificationEvaluator(metricName="weightedRecall", labelCol="label", weightCol="weight")
    tuned = CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=judge, foldCol="fold", numFolds=len(present)).fit(ready.withColumn("fold", F.create_map(*[F.lit(x) for i, f in enumerate(present) for x in (f, i)])[F.col("fold")]))
    return tuned.bestModel, names


def routed(model, names: list[float], rows: DataFrame, features: list[str]) -> DataFrame:
    """(query_id, w): the weight predicted for each query."""
    table = F.array(*[F.lit(n) for n in names])
    out = model.transform(assembled(rows, features))
    return out.select("query_id", F.element_at(table, (F.col("prediction") + 1).cast("int")).alias("w"))
