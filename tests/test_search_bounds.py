"""The pruned search gives the rows of the exhaustive one, with few query terms and with many."""

import random

import pytest
from pyspark.sql import functions as F

from larkspan.operators import lexical


def tables(spark, seed, documents=400, queries=40, ties=False):
    """Postings whose terms are very unequal, and queries of 1 to 6 terms, some unknown."""
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(30)]
    share = {t: 0.9 / (1 + i) for i, t in enumerate(names)}
    weight = (lambda t: rng.choice([1.0, 2.0])) if ties else (lambda t: rng.uniform(0.2, 1.0) / share[t] ** 0.5)
    postings = [(t, d, weight(t)) for t in names for d in range(documents) if rng.random() < share[t]]
    asked = [(f"q{q}", t) for q in range(queries) for t in rng.sample([*names, "unknown"], rng.randint(1, 6))]
    asked += [("hot", "t0"), ("rare", "t29"), ("none", "unknown")]
    return spark.createDataFrame(postings, "term string, doc_idx bigint, weight double"), spark.createDataFrame(asked, "query_id string, term string")


def exhaustive(postings, asked, k):
    weights, out = {}, {}
    for r in postings.collect():
        weights.setdefault(r["term"], {})[r["doc_idx"]] = r["weight"]
    scores = {}
    for r in asked.collect():
        for d, w in weights.get(r["term"], {}).items():
            of = scores.setdefault(r["query_id"], {})
            of[d] = of.get(d, 0.0) + w
    for q, of in scores.items():
        best = sorted(of.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out |= {(q, rank): (d, round(s, 6)) for rank, (d, s) in enumerate(best)}
    return out


@pytest.mark.parametrize(("seed", "k", "most", "ties"), [(1, 10, 200_000, False), (2, 3, 20, False), (3, 10, 200_000, True), (4, 1, 20, True), (5, 1000, 20, False)])
def test_same_as_exhaustive(spark, monkeypatch, seed, k, most, ties):
    monkeypatch.setattr(lexical, "MOST_TERMS", most)
    postings, asked = tables(spark, seed, ties=ties)
    got = {(r["query_id"], r["rank"]): (r["doc_idx"], round(r["score"], 6)) for r in lexical.best_documents(asked, postings, k).collect()}
    assert got == exhaustive(postings, asked, k)


def test_hot_terms_make_few_candidates(spark):
    """Where rare terms decide, a hot term's postings are no candidates."""
    postings, asked = tables(spark, 6, documents=3000)
    plans = lexical.search_plans(asked, lexical.term_bounds(postings, 10))
    wanted = plans.select("query_id", F.explode("wanted").alias("w")).select("query_id", "w.term", "w.floor")
    pruned = lexical.matched(wanted, postings).filter("weight >= floor").count()
    assert pruned < 0.35 * lexical.matched(asked, postings).count()


def test_nothing_to_find(spark):
    postings, asked = tables(spark, 7, documents=5, queries=2)
    assert lexical.best_documents(asked.limit(0), postings, 10).count() == 0
    assert lexical.best_documents(asked, postings.limit(0), 10).count() == 0
