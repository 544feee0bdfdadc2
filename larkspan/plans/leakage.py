"""Queries that measure leakage, and those that learn."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.keyed import hmac_hex, hmac_sql, in_half
from larkspan.operators import compartment, fusion, leakage, learning, metrics, vector_index
from larkspan.plans import base, fusion as fusion_plans, vectors
from larkspan.session import materialise, scratch_root
from larkspan.sources import writers

ALIAS_KEY_A, ALIAS_KEY_B = b"alias a", b"alias b"
DEPTH = 20
#: The reference's weights of the semantic list that the router chooses from, and those beside the learned ranking.
ROUTER_WEIGHTS = (0.80, 0.85, 0.90, 0.93, 0.95, 0.97, 0.98, 1.0)
RANKER_WEIGHTS = (0.0, 0.5, 0.8, 0.9, 0.95)


def balanced(spark: SparkSession, folder: str) -> DataFrame:
    """At most 20 vectors of each label."""
    return leakage.balanced_sample(base.vectors(spark, folder).select("vec_id", "label"), "label", "vec_id", 20)


BALANCED = """SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('sample:' || CAST(vec_id AS VARCHAR))) AS r FROM embeddings) WHERE r <= 20"""


def _alias(key: bytes):
    return F.substring(hmac_hex(F.encode(F.col("doc_idx").cast("string"), "UTF-8"), key), 1, 16)


def aliased(spark: SparkSession, folder: str, name: str, key: bytes, column: str) -> DataFrame:
    rows = base.rankings(spark, folder).filter((F.col("list_name") == name) & (F.col("pos") < DEPTH))
    return rows.withColumn("q", F.concat_ws(":", "query_id", "repeat_no")).select("q", _alias(key).alias(column), "doc_idx")


def alias_linkage(spark: SparkSession, folder: str) -> DataFrame:
    """Each semantic alias with the lexical alias it is seen with most, and whether both are one record."""
    a = aliased(spark, folder, base.SEMANTIC, ALIAS_KEY_A, "a")
    b = aliased(spark, folder, base.LEXICAL, ALIAS_KEY_B, "b")
    best = leakage.linked(leakage.cooccurrence(a, b, "q", "a", "b"), "a", "b")
    truth = a.select("a", "doc_idx").distinct().withColumn("own", _alias(ALIAS_KEY_B)).drop("doc_idx")
    return best.join(truth, "a").select("a", "b", "n", (F.col("b") == F.col("own")).alias("correct"))


def _alias_sql(key: bytes) -> str:
    return f"substring({hmac_sql('encode(CAST(doc_idx AS VARCHAR))', key)}, 1, 16)"


LINKAGE = f"""WITH {base.RANKINGS_SQL},
a_ AS (SELECT query_id || ':' || repeat_no AS q, doc_idx, {_alias_sql(ALIAS_KEY_A)} AS a FROM rankings_ WHERE list_name = '{base.SEMANTIC}' AND pos < {DEPTH}),
b_ AS (SELECT query_id || ':' || repeat_no AS q, {_alias_sql(ALIAS_KEY_B)} AS b FROM rankings_ WHERE list_name = '{base.LEXICAL}' AND pos < {DEPTH}),
p_ AS (SELECT a, b, count(*) AS n FROM a_ JOIN b_ USING (q) GROUP BY 1, 2),
l_ AS (SELECT a, b, n FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM p_) WHERE r = 1),
t_ AS (SELECT DISTINCT a, {_alias_sql(ALIAS_KEY_B)} AS own FROM a_)
SELECT a, b, n, b = own AS correct FROM l_ JOIN t_ USING (a)"""


def linkage_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The accuracy of alias linkage with its Wilson interval and gate."""
    counts = alias_linkage(spark, folder).agg(F.sum(F.col("correct").cast("int")).alias("hits"), F.count(F.lit(1)).alias("trials"))
    low, high = metrics.wilson_interval(F.col("hits"), F.col("trials"))
    share = F.col("hits") / F.col("trials")
    return counts.select("hits", "trials", F.round(share, 9).alias("accuracy"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), (share <= 0.2).alias("passes"))


SUMMARY = f"""SELECT CAST(h AS BIGINT) AS hits, t AS trials, round(p, 9) AS accuracy,
  round((p + 1.96 * 1.96 / (2 * n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS low,
  round((p + 1.96 * 1.96 / (2 * n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS high, p <= 0.2::DOUBLE AS passes
FROM (SELECT h, t, CAST(t AS DOUBLE) AS n, CAST(h AS DOUBLE) / t AS p FROM (SELECT sum(correct::INT) AS h, count(*) AS t FROM ({LINKAGE})))"""


def local_view(spark: SparkSession, folder: str) -> DataFrame:
    """(cell, item, x, y, label): each vector with its keyed coordinates in its first cell."""
    index = vectors.Index(spark, folder)
    rows = index.rows
    own = vector_index.nearest_cells(rows, "vec_id", index.centroids, 1).select("vec_id", "cell")
    local = compartment.local_vectors(index.rotated.join(own, "vec_id"), "vec_id", index.keys)
    labels = base.vectors(spark, folder).select("vec_id", "label")
    return materialise(local.join(rows, "vec_id").join(labels, "vec_id").select("cell", F.col("vec_id").alias("item"), "x", "y", "label"))


def topics(spark: SparkSession, folder: str) -> DataFrame:
    """Topic inference from cells alone and from keyed coordinates, on the held-out half."""
    view = local_view(spark, folder).withColumn("held_out", in_half(F.col("item").cast("string"), "topic")).withColumn("label", F.col("label").cast("double"))
    cells = leakage.topic_inference(leakage.one_hot(view, "cell", vectors.CELLS), "label", "held_out", 1500)
    blocks = leakage.topic_inference(leakage.block_features(view, "cell", "y", vectors.CELLS, vectors.CHOSEN), "label", "held_out", 1500)
    return cells.withColumn("view", F.lit("cells")).unionByName(blocks.withColumn("view", F.lit("coordinates")))


#: The numbers of anchors that the reference tries, its targets and its repeats.
GLOBAL_ANCHORS, LOCAL_ANCHORS, TARGETS, REPEATS = (2, 4, 8, 16, 32, 64), (2, 4, 8, 16), 300, 10
#: The limits of the three gates.
TOPIC_GATE, ANCHOR_GATE, NEIGHBOUR_GATE = 0.35, 0.20, 0.50


def anchor_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Known-record alignment by number of anchors: per cell, and over all cells in ten repeats.

    `accuracy` is the mean over repeats, `deviation` their sample deviation (null for one).
    """
    view = local_view(spark, folder)
    local = leakage.local_alignment(view, LOCAL_ANCHORS).groupBy("anchors").agg(
        F.lit("local").alias("kind"), F.sum("targets").alias("targets"), F.sum("correct").alias("correct"), F.round(F.sum("correct") / F.sum("targets"), 6).alias("accuracy"),
        F.lit(None).cast("double").alias("deviation"), F.sum("targets").alias("covered"))
    share = F.col("correct") / F.col("targets")
    whole = leakage.global_alignment(view, GLOBAL_ANCHORS, TARGETS, REPEATS).groupBy("anchors").agg(
        F.lit("global").alias("kind"), F.sum("targets").alias("targets"), F.sum("correct").alias("correct"), F.round(F.avg(share), 6).alias("accuracy"),
        F.round(F.stddev_samp(share), 6).alias("deviation"), F.sum("covered").alias("covered"))
    return local.unionByName(whole)


def gates(spark: SparkSession, folder: str) -> DataFrame:
    """The three predeclared gates: topic accuracy from coordinates, alignment with four global anchors, neighbourhood recall."""
    topic = topics(spark, folder).filter("view = 'coordinates'").select(F.lit("topic").alias("gate"), F.col("accuracy").alias("value"), F.lit(TOPIC_GATE).alias("most"))
    anchors = leakage.global_alignment(local_view(spark, folder), (4,), TARGETS, REPEATS).agg(F.avg(F.col("correct") / F.col("targets")).alias("value"))
    anchors = anchors.select(F.lit("four anchors").alias("gate"), "value", F.lit(ANCHOR_GATE).alias("most"))
    near = vectors.neighbourhood_recall(spark, folder).agg(F.avg("recall").alias("value")).select(F.lit("neighbourhood").alias("gate"), "value", F.lit(NEIGHBOUR_GATE).alias("most"))
    return topic.unionByName(anchors).unionByName(near).select("gate", F.round("value", 6).alias("value"), "most", (F.col("value") <= F.col("most")).alias("passes"))


def known_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Recovery of one half's vectors from the other half's known pairs: mean cosine, the mean vector's, and the gain over it.

    The gain is scaled so that 1 is full recovery and 0 what the mean vector gives.
    """
    view = local_view(spark, folder)
    held = in_half(F.col("item").cast("string"), "known")
    told = leakage.affine_recovery(view.filter(~held).drop("label"), view.filter(held).drop("label")).groupBy("covered").agg(
        F.count(F.lit(1)).alias("records"), F.avg("cosine").alias("c"), F.avg("baseline").alias("b"))
    gain = (F.col("c") - F.col("b")) / F.greatest(1 - F.col("b"), F.lit(1e-12))
    return told.select("covered", "records", F.round("c", 6).alias("mean_cosine"), F.round("b", 6).alias("baseline_cosine"), F.round(gain, 6).alias("normalised_gain"))


def _featured(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Candidates with all features and gains, for the ranker."""
    features = fusion.candidate_features(F.col("s"), F.col("l"))
    pairs = fusion_plans.judged_pairs(spark, folder)
    per_query = fusion_plans.query_features(spark, folder).withColumn("has_digit", F.col("has_digit").cast("double"))
    rows = pairs.select("query_id", "repeat_no", "doc_idx", "s", "l", "gain", *[c.alias(n) for n, c in features.items()]).join(per_query, "query_id")
    return rows, [*features, *[c for c in per_query.columns if c != "query_id"]]


class Fusion(NamedTuple):
    """The chosen ranker with what it was chosen from."""

    rows: DataFrame
    features: list[str]
    model: object
    depth: int
    weight: float


def _mixed(learned: DataFrame, lists: DataFrame, weight: float) -> DataFrame:
    """The learned ranking fused with the semantic lists (case, doc_idx, pos), which have `weight`."""
    if weight <= 0:
        return learned
    both = learned.select(*fusion_plans.CASE, "doc_idx", F.col("rank").alias("pos"), F.lit(False).alias("semantic"))
    both = both.unionByName(lists.select(*fusion_plans.CASE, "doc_idx", "pos", F.lit(True).alias("semantic")))
    return fusion.fused(both, fusion_plans.CASE, "doc_idx", "pos", F.when(F.col("semantic"), weight).otherwise(1 - weight), 100)


def _semantic(spark: SparkSession, folder: str, part: DataFrame) -> DataFrame:
    lists = base.rankings(spark, folder).filter(F.col("list_name") == base.SEMANTIC).select(*fusion_plans.CASE, "doc_idx", "pos")
    return lists.join(part.select(*fusion_plans.CASE).distinct(), fusion_plans.CASE, "left_semi")


def fitted(spark: SparkSession, folder: str, rounds: int = 120) -> Fusion:
    """Depth and weight chosen on the inner half of the calibration queries, the ranker fitted on all of them."""
    rows, features = _featured(spark, folder)
    rows = materialise(rows)
    outer, inner = in_half(F.col("query_id"), "outer"), in_half(F.col("query_id"), "inner")
    judged = base.judgements(spark, folder)
    sample = lambda part: fusion.training_rows(part, fusion_plans.CASE, "doc_idx", "gain", "s", "l")
    part = rows.filter(~outer & inner)
    lists = materialise(_semantic(spark, folder, part))

    def ndcg(ranking: DataFrame) -> float:
        value = metrics.query_metrics(ranking, judged, fusion_plans.CASE).agg(F.avg("ndcg10")).first()[0]  # one number
        return value or 0.0

    best = (-1.0, learning.DEPTHS[0], 0.0)
    for depth in learning.DEPTHS:
        model = learning.fit_ranker(sample(rows.filter(~outer & ~inner)), features, depth, rounds)
        learned = materialise(learning.learned_ranking(model, part, features, fusion_plans.CASE, "doc_idx", 100))
        for weight in RANKER_WEIGHTS:
            best = max(best, (ndcg(_mixed(learned, lists, weight)), depth, weight))
    model = learning.fit_ranker(sample(rows.filter(~outer)), features, best[1], rounds)
    return Fusion(rows, features, model, best[1], best[2])


def learned_fusion(spark: SparkSession, folder: str, rounds: int = 120) -> DataFrame:
    """The learned ranker with the depth and weight chosen for it, reported on the outer half."""
    fit = fitted(spark, folder, rounds)
    part = fit.rows.filter(in_half(F.col("query_id"), "outer"))
    learned = learning.learned_ranking(fit.model, part, fit.features, fusion_plans.CASE, "doc_idx", 100)
    final = metrics.query_metrics(_mixed(learned, _semantic(spark, folder, part), fit.weight), base.judgements(spark, folder), fusion_plans.CASE)
    return final.agg(F.lit(fit.depth).alias("depth"), F.lit(fit.weight).alias("weight"), F.count(F.lit(1)).alias("cases"), F.round(F.avg("ndcg10"), 6).alias("ndcg10"), F.round(F.avg("recall100"), 6).alias("recall100"))


def learned_report(spark: SparkSession, folder: str, rounds: int = 120) -> DataFrame:
    """Plain RRF against the semantic list and the learned ranking against plain RRF, by paired bootstrap on the outer half.

    The ranker is saved and loaded again; the queries of the other half keep their semantic list. Differences are of nDCG, averaged
    over a query's repeats first. `hits` are the relevant records among the first hundred of the second ranking.
    """
    fit = fitted(spark, folder, rounds)
    path = f"{scratch_root(spark)}/larkspan-ranker-{uuid.uuid4().hex}"
    writers.save_model(fit.model, path)
    model = writers.load_model(GBTClassificationModel, path)
    outer = in_half(F.col("query_id"), "outer")
    learned = materialise(learning.masked_ranking(model, fit.rows, fit.features, fusion_plans.CASE, "doc_idx", "s", outer, 100))
    lists = base.rankings(spark, folder)
    rankings = {
        "semantic": base.ranked(lists.filter(F.col("list_name") == base.SEMANTIC), fusion_plans.CASE, "pos", "doc_idx"),
        "rrf": fusion.fused(lists, fusion_plans.CASE, "doc_idx", "pos", F.lit(0.5), 100),
        "learned": _mixed(learned, _semantic(spark, folder, fit.rows), fit.weight),
    }
    judged = materialise(base.judgements(spark, folder))
    each = None
    for name, ranking in rankings.items():
        per = metrics.query_metrics(ranking, judged, fusion_plans.CASE).filter(outer).groupBy("query_id").agg(
            F.avg("ndcg10").alias(f"{name}_ndcg"), F.sum(F.round(F.col("recall100") * F.col("relevant"))).alias(f"{name}_hits"))
        each = per if each is None else each.join(per, "query_id")
    each = materialise(each)
    out = None
    for first, second in (("semantic", "rrf"), ("rrf", "learned")):
        d = each.select((F.col(f"{second}_ndcg") - F.col(f"{first}_ndcg")).alias("d"), F.lit(0.0).alias("zero"), F.col(f"{second}_hits").alias("h"))
        shares = metrics.outcome_shares(d, "zero", "d").select("wins", "ties", "losses")
        row = metrics.paired_bootstrap(d, "d").join(shares).join(d.agg(F.sum("h").cast("bigint").alias("hits")))  # one row each
        row = row.withColumn("comparison", F.lit(f"{second} - {first}"))
        out = row if out is None else out.unionByName(row)
    return out


def calibration_ablation(spark: SparkSession, folder: str, rounds: int = 120) -> DataFrame:
    """The ranker fitted on a quarter, a half and all of the calibration queries (by hash, per dataset), judged on the outer half."""
    rows, features = _featured(spark, folder)
    rows = materialise(rows)
    outer, judged = in_half(F.col("query_id"), "outer"), base.judgements(spark, folder)
    parts = fusion_plans.calibration_subset(spark, folder).filter(~outer)
    part = rows.filter(outer)
    out = None
    for name, chosen in (("quarter", F.col("in_quarter")), ("half", F.col("in_half")), ("all", F.lit(True))):
        told = materialise(rows.join(parts.filter(chosen).select("query_id"), "query_id", "left_semi"))
        if told.filter("gain > 0").isEmpty():
            continue
        model = learning.fit_ranker(fusion.training_rows(told, fusion_plans.CASE, "doc_idx", "gain", "s", "l"), features, learning.DEPTHS[0], rounds)
        per = metrics.query_metrics(learning.learned_ranking(model, part, features, fusion_plans.CASE, "doc_idx", 100), judged, fusion_plans.CASE)
        row = per.agg(F.lit(name).alias("share"), F.lit(told.select("query_id").distinct().count()).alias("fitted_on"), F.count(F.lit(1)).alias("cases"), F.round(F.avg("ndcg10"), 6).alias("ndcg10"))
        out = row if out is None else out.unionByName(row)
    return spark.createDataFrame([], "share string, fitted_on int, cases bigint, ndcg10 double") if out is None else out


def router(spark: SparkSession, folder: str, trees: int = 300) -> DataFrame:
    """The outer half fused with the forest's weights (`routed`) and with each query's best ones (`oracle`).

    Per kind: queries, cases, mean nDCG and recall, and the share of queries whose predicted weight is the best.
    """
    targets = materialise(fusion_plans.routed_weights(spark, folder, ROUTER_WEIGHTS))
    features = fusion_plans.query_features(spark, folder).withColumn("has_digit", F.col("has_digit").cast("double"))
    names = [c for c in features.columns if c != "query_id"]
    rows = materialise(features.join(targets, "query_id"))
    outer = in_half(F.col("query_id"), "outer")
    model, weights = learning.fit_router(rows.filter(~outer), names, "best_weight", trees)
    told = materialise(learning.routed(model, weights, rows.filter(outer), names).join(targets.select("query_id", "best_weight"), "query_id"))
    kinds = F.explode(F.array(F.struct(F.lit("routed").alias("kind"), F.col("w").alias("w")), F.struct(F.lit("oracle").alias("kind"), F.col("best_weight").alias("w")))).alias("k")
    lists = base.rankings(spark, folder).join(told.select("query_id", kinds).select("query_id", "k.kind", "k.w"), "query_id")
    case = [*fusion_plans.CASE, "kind"]
    fused = fusion.fused(lists, case, "doc_idx", "pos", F.when(F.col("list_name") == base.SEMANTIC, F.col("w")).otherwise(1 - F.col("w")), 100)
    per = metrics.query_metrics(fused, base.judgements(spark, folder), case).groupBy("kind").agg(
        F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("cases"), F.round(F.avg("ndcg10"), 6).alias("ndcg10"), F.round(F.avg("recall100"), 6).alias("recall100"))
    agreed = told.agg(F.round(F.avg((F.col("w") == F.col("best_weight")).cast("double")), 6).alias("agreement"))  # one row
    return per.join(F.broadcast(agreed))


QUERIES = {
    "k1_balanced_sample": balanced, "k9_k12_c12_d18_alias_linkage": alias_linkage, "d21_k11_linkage_summary": linkage_summary, "k2_k3_topic_inference": topics,
    "k4_k5_c13_alignment": anchor_alignment, "k7_k10_known_pairs": known_pairs, "k11_gates": gates, "j7_j14_j15_a14_learned_report": learned_report, "j6_j7_j9_learned_fusion": learned_fusion, "j11_router": router, "j17_calibration_ablation": calibration_ablation,
}
SQL = {"k1_balanced_sample": BALANCED, "k9_k12_c12_d18_alias_linkage": LINKAGE, "d21_k11_linkage_summary": SUMMARY}
