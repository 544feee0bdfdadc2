"""The registered learners do the whole search over depths, rounds and weights."""

from pyspark.sql import functions as F

from larkspan.plans import leakage as plans

FOLDER = "/root/testdata/sf0.001"


def test_all_depths_weights_and_rounds(spark, monkeypatch):
    fitted, mixed = [], []
    whole = plans.fusion.fused

    def ranking(model, rows, features, case, item, depth):
        return rows.select(*case, item, F.lit(0.5).alias("score"), F.col("s").cast("bigint").alias("rank")).filter(F.col("rank") < depth)

    def fused(rows, case, item, place, weight, depth, *more):
        mixed.append(weight)
        return whole(rows, case, item, place, weight, depth, *more)

    monkeypatch.setattr(plans.learning, "fit_ranker", lambda rows, features, depth, rounds: fitted.append((depth, rounds)))
    monkeypatch.setattr(plans.learning, "learned_ranking", ranking)
    monkeypatch.setattr(plans.fusion, "fused", fused)
    plans.QUERIES["j6_j7_j9_learned_fusion"](spark, FOLDER)
    assert fitted[:3] == [(3, 120), (4, 120), (5, 120)] and fitted[3][1] == 120
    assert len(mixed) >= 12  # four weights above 0 for each depth


def test_router_scores_routed_and_oracle(spark, monkeypatch):
    asked, fit = [], plans.learning.fit_router
    monkeypatch.setattr(plans.learning, "fit_router", lambda rows, names, target, trees: asked.append(trees) or fit(rows, names, target, 5))
    got = {r["kind"]: r for r in plans.QUERIES["j11_router"](spark, FOLDER).collect()}
    assert asked == [300] and set(got) == {"routed", "oracle"}
    assert got["routed"]["cases"] == got["oracle"]["cases"] > 0
    assert got["oracle"]["ndcg10"] >= got["routed"]["ndcg10"] - 1e-6
