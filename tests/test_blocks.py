"""Search in blocks gives what all pairs give, and makes no row per pair of a query and a posting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.operators import blocks, lexical
from larkspan.plans import keyed_lexical, scans

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture
def pairs(monkeypatch):
    """The rows that joins of terms with postings made, one number per join."""
    made, before = [], lexical.matched

    def counted(terms, postings, *more):
        out = before(terms, postings, *more)
        made.append((out.count(), postings.count()))
        return out

    monkeypatch.setattr(lexical, "matched", counted)
    return made


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("DOCUMENTS", 50), ("SETS", 8), ("LEAST_SETS", 4)):
        monkeypatch.setattr(blocks, name, value)


def tables(spark, seed, documents=300, queries=40):
    """Postings with hot and rare terms and many equal weights; queries of 1 to 4 terms, some alike."""
    rng = random.Random(seed)
    postings = [(f"t{i}", d, rng.choice([1.0, 2.0, rng.random() + 0.1])) for i in range(12) for d in range(documents) if rng.random() < 0.9 / (1 + i)]
    asked = [(f"q{q}", t) for q in range(queries) for t in rng.sample([f"t{i}" for i in range(12)], rng.randint(1, 4))]
    return spark.createDataFrame(postings, "term string, doc_idx bigint, weight double"), spark.createDataFrame(asked, "query_id string, term string"), postings, asked


@pytest.mark.parametrize("keep", [3, 1000])
def test_nearest_is_that_of_all_pairs(spark, small_blocks, keep):
    postings, asked, rows, terms = tables(spark, 1)
    rng = random.Random(2)
    vectors = {d: np.array([rng.choice([0.0, 0.25, 0.5]) for _ in range(6)]) for d in range(300)}
    sketches = spark.createDataFrame([(d, c, float(v)) for d, x in vectors.items() for c, v in enumerate(x) if v], "doc_idx bigint, coordinate int, value double")
    queries, sets = blocks.term_sets(asked)
    of = {r["set_no"]: set(r["terms"]) for r in sets.collect()}
    assert {r["query_id"]: of[r["set_no"]] for r in queries.collect()} == {q: {t for a, t in terms if a == q} for q, _ in terms}
    values = {no: [1.0, -0.5] for no in of}
    given = sets.withColumn("coordinates", F.array(F.lit(1), F.lit(4))).withColumn("values", F.array(F.lit(1.0), F.lit(-0.5)))
    shift = np.array([rng.random() for _ in range(6)])
    got = {}
    for r in blocks.nearest(given, blocks.postings_of(given, postings), sketches, shift, 0.5, keep).collect():
        got.setdefault(r["set_no"], set()).add(r["doc_idx"])
    for no, names in of.items():
        own = {d for t, d, _ in rows if t in names}
        score = {d: round(0.5 + 2 * sum(v * (vectors[d][c] + shift[c]) for c, v in zip((1, 4), values[no], strict=True)), 7) for d in own}
        assert got[no] == set(sorted(own, key=lambda d: (-score[d], d))[:keep])


def test_sketch_rerank_makes_no_pairs(spark, pairs):
    assert keyed_lexical.sketch_rerank(spark, FOLDER).count() > 0
    assert all(n <= postings for n, postings in pairs)


def test_counts_are_those_of_all_pairs(spark, small_blocks):
    postings, asked, rows, terms = tables(spark, 3)
    queries, sets = blocks.term_sets(asked.unionByName(spark.createDataFrame([("none", "unknown")], asked.schema)))
    got = {r["set_no"]: (r["with_any"], r["with_all"], r["postings"]) for r in blocks.counted(sets, postings).collect()}
    for r in sets.collect():
        own = [{d for t, d, _ in rows if t == name} for name in r["terms"]]
        if any(own):
            assert got.pop(r["set_no"]) == (len(set.union(*own)), len(set.intersection(*own)), sum(map(len, own)))
    assert not got


def test_matches_make_no_pairs(spark, pairs):
    assert scans.matches(spark, FOLDER).count() > 0
    assert all(n <= postings for n, postings in pairs)


def test_totals_are_those_of_all_pairs(spark, small_blocks):
    postings, asked, *_ = tables(spark, 4)
    queries, sets = blocks.term_sets(asked)
    every = lexical.bm25_scores(asked, postings).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("score", (-F.col("doc_idx")).alias("d"))).alias("b"))
    wanted = {r["query_id"]: (r["n"], r["b"]["score"], -r["b"]["d"]) for r in every.collect()}
    got = {r["query_id"]: (r["n"], r["score"], r["first"]) for r in queries.join(blocks.totals(sets, postings), "set_no").collect()}
    assert got == wanted


def test_traces_make_no_pairs(spark, pairs):
    assert keyed_lexical.budget_traces(spark, FOLDER).count() > 0
    assert all(n <= postings for n, postings in pairs)


@pytest.mark.parametrize("k", [2, 20, 1000])
def test_best_are_those_of_all_pairs(spark, small_blocks, k):
    postings, asked, *_ = tables(spark, 5)
    queries, sets = blocks.term_sets(asked)
    columns = ["query_id", "doc_idx", "score", "rank"]
    wanted = lexical.top_k(lexical.bm25_scores(asked, postings), ["query_id"], k).select(columns).collect()
    assert sorted(queries.join(blocks.best(sets, postings, k), "set_no").select(columns).collect()) == sorted(wanted)


def test_recommendation_makes_no_pairs(spark, pairs):
    assert keyed_lexical.recommendation(spark, FOLDER).count() == 45
    assert all(n <= postings for n, postings in pairs)


def test_compartment_ranking_makes_no_pairs_in_any_number_of_passes(spark, pairs, monkeypatch):
    one = sorted(keyed_lexical.compartment_ranking(spark, FOLDER).collect())
    assert one and all(n <= postings for n, postings in pairs)
    monkeypatch.setattr(blocks, "PASS_SETS", 60)
    monkeypatch.setattr(blocks, "SETS", 20)
    assert sorted(keyed_lexical.compartment_ranking(spark, FOLDER).collect()) == one
