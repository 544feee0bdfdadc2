"""The planner's budgets are the reference's, so that ordinary terms are bought."""

from pyspark.sql import functions as F

from larkspan.operators import lexical
from larkspan.plans import base, lexical as plans

FOLDER = "/root/testdata/sf0.01"


def test_affordable_terms_are_all_bought(spark):
    known = base.known_terms(spark, FOLDER).filter("df > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("known"), F.sum("df").alias("postings"))
    told = plans.planned_terms(spark, FOLDER).join(known, "query_id").filter(F.col("postings") <= 50_000).collect()
    assert told and max(r["postings"] for r in told) > 200
    assert all((r["n_terms"], r["spent"]) == (r["known"], r["postings"]) for r in told)
    assert [r["budget"] for r in plans.budget_sweep(spark, FOLDER).orderBy("budget").collect()] == [10_000, 50_000, 250_000]


def test_small_budgets_still_cut(spark):
    known = base.known_terms(spark, FOLDER)
    spent = [[r["spent"] for r in lexical.terms_under_budget(known, b).collect()] for b in (50, 200, 1000)]
    assert sum(spent[0]) < sum(spent[1]) < sum(spent[2])
