"""Queries on fusion, features and evaluation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions.keyed import in_half
from larkspan.functions.text import tokens
from larkspan.operators import fusion, lexical, metrics
from larkspan.plans import base, lexical as lexical_plans
from larkspan.session import table

CASE = ["query_id", "repeat_no"]
GRID = (0.0, 0.5, 0.8, 0.9, 0.95, 0.98, 1.0)
#: Others than the relevant ones that a training sample takes per case.
OTHERS = 100


def _list_weight(w):
    return F.when(F.col("list_name") == base.SEMANTIC, w).otherwise(1 - w)


def plain_rrf(spark: SparkSession, folder: str) -> DataFrame:
    out = fusion.fused(base.rankings(spark, folder), CASE, "doc_idx", "pos", F.lit(1.0), 100)
    return out.withColumn("score", F.round("score", 9))


def _rrf_sql(weight: str, constant: str = "60", extra: str = "", depth: int = 100, name: str = "fused_") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, repeat_no ORDER BY score DESC, doc_idx) - 1 AS rank FROM (
  SELECT query_id, repeat_no, doc_idx, round(sum({weight} / ({constant} + pos + 1)), 12) AS score FROM rankings_ {extra} WHERE {weight} > 0 GROUP BY 1, 2, 3))
  WHERE rank < {depth})"""


PLAIN_RRF = f"WITH {base.RANKINGS_SQL}, {_rrf_sql('1.0::DOUBLE')} SELECT query_id, repeat_no, doc_idx, round(score, 9) AS score, rank FROM fused_"
_WEIGHT = f"(CASE WHEN list_name = '{base.SEMANTIC}' THEN coalesce(w, 0.5) ELSE 1 - coalesce(w, 0.5) END)"


def weighted_rrf_rows(spark: SparkSession, folder: str, depth: int = 100) -> DataFrame:
    rows = base.rankings(spark, folder).join(base.weights(spark, folder), "dataset", "left")
    weight = _list_weight(F.coalesce("w", F.lit(0.5)))
    return fusion.fused(rows, CASE, "doc_idx", "pos", weight, depth, F.coalesce("c", F.lit(fusion.CONSTANT)))


def weighted_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """The configured weights of each dataset."""
    return weighted_rrf_rows(spark, folder).withColumn("score", F.round("score", 9))


_WEIGHTED = _rrf_sql(_WEIGHT, "coalesce(c, 60)", "LEFT JOIN weights_ USING (dataset)")
WEIGHTED_RRF = f"WITH {base.RANKINGS_SQL}, {base.WEIGHTS_SQL}, {_WEIGHTED} SELECT query_id, repeat_no, doc_idx, round(score, 9) AS score, rank FROM fused_"


def overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.overlap_features(base.two_lists(spark, folder), CASE, "s", "l")


_OVERLAPS = ", ".join(f"round(sum(CASE WHEN s < {d} AND l < {d} THEN 1.0::DOUBLE ELSE 0 END) / {d}, 9) AS overlap_{d}" for d in fusion.OVERLAP_DEPTHS)
_AGREEMENT = "round(ln(1 + sum(CASE WHEN s < 100 AND l < 100 THEN 1.0::DOUBLE / ((s + 1) * (l + 1)) ELSE 0 END)), 9) AS agreement"
OVERLAPS = f"WITH {base.LISTS_SQL} SELECT query_id, repeat_no, {_OVERLAPS}, {_AGREEMENT} FROM lists_ GROUP BY 1, 2"


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    features = fusion.candidate_features(F.col("s"), F.col("l"))
    return base.two_lists(spark, folder).select(*CASE, "doc_idx", *[F.round(c, 9).alias(n) for n, c in features.items()])


def _feature_sql() -> str:
    r = lambda c, by: f"CASE WHEN {c} IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / ({c} + {by}) END"
    log_rank = lambda c, absent: f"ln(1 + coalesce({c} + 1.0::DOUBLE, {absent})) / {math.log(absent + 1)!r}::DOUBLE"
    named = {
        "first_reciprocal": r("s", 1), "second_reciprocal": r("l", 1), "first_rrf": r("s", 61), "second_rrf": r("l", 61),
        "in_first": "(s IS NOT NULL)::INT::DOUBLE", "in_second": "(l IS NOT NULL)::INT::DOUBLE", "in_both": "(s IS NOT NULL AND l IS NOT NULL)::INT::DOUBLE",
        "first_log_rank": log_rank("s", 101.0), "second_log_rank": log_rank("l", 1001.0), "product": f"({r('s', 1)}) * ({r('l', 1)})",
        "largest_rrf": f"greatest({r('s', 61)}, {r('l', 61)})",
    }
    return ", ".join(f"round({c}, 9) AS {n}" for n, c in named.items())


CANDIDATES = f"WITH {base.LISTS_SQL} SELECT query_id, repeat_no, doc_idx, {_feature_sql()} FROM lists_"


def query_features(spark: SparkSession, folder: str) -> DataFrame:
    """The thirteen features per query: text, the plan's terms and postings, overlaps averaged over repeats."""
    text = base.query_texts(spark, folder)
    static = text.select("query_id", *[c.alias(n) for n, c in fusion.text_features(F.col("text"), tokens(F.col("text"))).items()])
    plan = lexical.terms_under_budget(base.known_terms(spark, folder), lexical_plans.BUDGETS[1])
    names = [f"overlap_{d}" for d in fusion.OVERLAP_DEPTHS] + ["agreement"]
    over = overlaps(spark, folder).groupBy("query_id").agg(*[F.round(F.avg(n), 6).alias(n) for n in names])
    spent = F.coalesce("spent", F.lit(0))
    return (
        static.join(plan, "query_id", "left").join(over, "query_id", "left").na.fill(0.0, names)
        .select("query_id", "n_tokens", "n_distinct", "has_digit", "n_upper", F.when(F.col("terms").isNull(), 0).otherwise(F.size("terms")).alias("selected_terms"),
                F.round(F.log1p(spent), 9).alias("log_postings"), F.round(spent / 50000.0, 9).alias("scaled_postings"), *names)
    )


QUERY_FEATURES = f"""WITH {base.QUERIES_SQL}, {base.POSTINGS_SQL}, {base.TERMS_SQL}, {base.LISTS_SQL}, {lexical_plans._planned_sql(lexical_plans.BUDGETS[1])},
t_ AS (SELECT query_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM queries_),
v_ AS (SELECT query_id, repeat_no, {_OVERLAPS}, {_AGREEMENT} FROM lists_ GROUP BY 1, 2),
a_ AS (SELECT query_id, {", ".join(f"round(avg({n}), 6) AS {n}" for n in [f"overlap_{d}" for d in fusion.OVERLAP_DEPTHS] + ["agreement"])} FROM v_ GROUP BY 1)
SELECT t_.query_id, CAST(len(w) AS INTEGER) AS n_tokens, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct, regexp_matches(text, '\\p{{Nd}}') AS has_digit,
  CAST(length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS INTEGER) AS n_upper, CAST(coalesce(len(terms), 0) AS INTEGER) AS selected_terms,
  round(ln(1 + coalesce(spent, 0)), 9) AS log_postings, round(coalesce(spent, 0) / 50000.0::DOUBLE, 9) AS scaled_postings,
  {", ".join(f"coalesce({n}, 0.0) AS {n}" for n in [f"overlap_{d}" for d in fusion.OVERLAP_DEPTHS] + ["agreement"])}
FROM t_ LEFT JOIN plan_ USING (query_id) LEFT JOIN a_ USING (query_id)"""


def judged_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return base.two_lists(spark, folder).join(base.judgements(spark, folder), ["query_id", "doc_idx"], "left")


def training_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = fusion.training_rows(judged_pairs(spark, folder), CASE, "doc_idx", "gain", "s", "l", OTHERS)
    return rows.select(*CASE, "doc_idx", "label", F.round("weight", 9).alias("weight"))


TRAINING = f"""WITH {base.JUDGEMENTS_SQL},
m_ AS (SELECT query_id, repeat_no, doc_idx, CASE WHEN coalesce(gain, 0) > 0 THEN 1 ELSE 0 END AS label,
  NOT coalesce(gain, 0) > 0 AND NOT (coalesce(s, 1000000000) < 50 OR coalesce(l, 1000000000) < 100) AS easy FROM lists_ LEFT JOIN judged_ USING (query_id, doc_idx)),
k_ AS (SELECT *, row_number() OVER (PARTITION BY query_id, repeat_no, easy ORDER BY sha256(query_id || ':' || repeat_no || ':' || doc_idx)) AS r FROM m_)
SELECT query_id, repeat_no, doc_idx, label, round(0.5::DOUBLE / count(*) OVER (PARTITION BY query_id, repeat_no, label), 9) AS weight
FROM k_ WHERE NOT easy OR r <= {OTHERS}"""


def list_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The stored lists as rankings: closed up over empty slots."""
    return base.ranked(base.rankings(spark, folder), [*CASE, "list_name"], "pos", "doc_idx")


def per_query_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of each stored list per query and repeat."""
    return metrics.query_metrics(list_ranking(spark, folder), base.judgements(spark, folder), [*CASE, "list_name"])


_IDEAL = """ideal_ AS (SELECT query_id, sum(CASE WHEN i < 10 THEN (pow(2.0, gain) - 1) / log2(i + 2) ELSE 0 END) AS ideal, count(*) AS relevant
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_idx) - 1 AS i FROM judged_) GROUP BY 1)"""


def _metrics_sql(source: str, by: str, name: str = "metrics_") -> str:
    return f"""{name} AS (SELECT {by}, round(dcg / ideal, 9) AS ndcg10, round(mrr, 9) AS mrr10, near > 0 AS hit10, round(near / relevant, 9) AS recall10,
  round(far / relevant, 9) AS recall100, relevant FROM (SELECT {by},
    coalesce(sum(CASE WHEN gain IS NOT NULL AND rank < 10 THEN (pow(2.0, gain) - 1) / log2(rank + 2) END), 0.0) AS dcg,
    coalesce(max(CASE WHEN gain IS NOT NULL AND rank < 10 THEN 1.0::DOUBLE / (rank + 1) END), 0.0) AS mrr,
    CAST(sum(CASE WHEN gain IS NOT NULL AND rank < 10 THEN 1 ELSE 0 END) AS DOUBLE) AS near,
    CAST(sum(CASE WHEN gain IS NOT NULL AND rank < 100 THEN 1 ELSE 0 END) AS DOUBLE) AS far
    FROM {source} LEFT JOIN judged_ USING (query_id, doc_idx) GROUP BY ALL) JOIN ideal_ USING (query_id))"""


_LIST_RANKS = "list_ranks_ AS (SELECT *, row_number() OVER (PARTITION BY query_id, repeat_no, list_name ORDER BY pos, doc_idx) - 1 AS rank FROM rankings_)"
_LIST_METRICS = f"{base.JUDGEMENTS_SQL}, {_IDEAL}, {_LIST_RANKS}, {_metrics_sql('list_ranks_', 'query_id, repeat_no, list_name')}"
PER_QUERY = f"WITH {_LIST_METRICS} SELECT * FROM metrics_"
_MEANS = ", ".join(f"round(avg({n}), 6) AS {n}" for n in ("ndcg10", "mrr10", "recall10", "recall100"))
_INNER = ", ".join(f"avg({n}) AS {n}" for n in ("ndcg10", "mrr10", "recall10", "recall100"))


def mean_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.metric_means(per_query_metrics(spark, folder), "repeat_no", "list_name")


MEANS = f"""WITH {_LIST_METRICS} SELECT list_name, {_MEANS}, round(coalesce(stddev_samp(ndcg10), 0.0), 6) AS ndcg10_deviation, count(*) AS repeats
FROM (SELECT list_name, repeat_no, {_INNER} FROM metrics_ GROUP BY 1, 2) GROUP BY 1"""


def fused_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.query_metrics(weighted_rrf_rows(spark, folder), base.judgements(spark, folder), CASE)


def outcome(spark: SparkSession, folder: str) -> DataFrame:
    """Wins of the fused list over the semantic one in nDCG."""
    one = per_query_metrics(spark, folder).filter(F.col("list_name") == base.SEMANTIC).select(*CASE, F.col("ndcg10").alias("a"))
    pairs = one.join(fused_metrics(spark, folder).select(*CASE, F.col("ndcg10").alias("b")), CASE)
    return metrics.outcome_shares(pairs, "a", "b", "repeat_no")


_FUSED_METRICS = f"{base.WEIGHTS_SQL}, {_WEIGHTED}, {_metrics_sql('fused_', 'query_id, repeat_no', 'fused_metrics_')}"
OUTCOME = f"""WITH {_LIST_METRICS}, {_FUSED_METRICS},
p_ AS (SELECT m.repeat_no, f.ndcg10 - m.ndcg10 AS d FROM metrics_ m JOIN fused_metrics_ f USING (query_id, repeat_no) WHERE m.list_name = '{base.SEMANTIC}')
SELECT repeat_no, count(*) AS cases, round(avg(d), 9) AS mean_difference, round(avg((d > 1e-12)::INT), 9) AS wins,
  round(avg((abs(d) <= 1e-12)::INT), 9) AS ties, round(avg((d < -1e-12)::INT), 9) AS losses FROM p_ GROUP BY 1"""


def bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """The paired bootstrap of the fused list against the semantic one."""
    one = per_query_metrics(spark, folder).filter(F.col("list_name") == base.SEMANTIC).select(*CASE, F.col("ndcg10").alias("a"))
    pairs = one.join(fused_metrics(spark, folder).select(*CASE, F.col("ndcg10").alias("b")), CASE)
    per_query = pairs.groupBy("query_id").agg(F.avg(F.col("b") - F.col("a")).alias("d"))
    return metrics.paired_bootstrap(per_query, "d")


def weight_grid(spark: SparkSession, folder: str) -> DataFrame:
    """nDCG of every weight on the calibration half, and which weight is chosen (of equals the largest)."""
    grid = spark.createDataFrame([(w,) for w in GRID], "w double")
    rows = base.rankings(spark, folder).filter(~in_half(F.col("query_id"), "outer")).join(F.broadcast(grid))  # a row per weight
    lists = fusion.fused(rows, [*CASE, "w"], "doc_idx", "pos", _list_weight(F.col("w")), 10)
    per = metrics.query_metrics(lists, base.judgements(spark, folder), [*CASE, "w"])
    means = per.groupBy("w").agg(F.round(F.avg("ndcg10"), 6).alias("ndcg10"), F.count(F.lit(1)).alias("cases"))
    best = F.row_number().over(Window.orderBy(F.col("ndcg10").desc(), F.col("w").desc()))  # one row per weight
    return means.withColumn("chosen", best == 1)


_GRID = ", ".join(f"({w}::DOUBLE)" for w in GRID)
GRID_SQL = f"""WITH {base.JUDGEMENTS_SQL}, {_IDEAL},
g_ AS (SELECT r.*, g.w, CASE WHEN list_name = '{base.SEMANTIC}' THEN g.w ELSE 1 - g.w END AS wt FROM rankings_ r CROSS JOIN (VALUES {_GRID}) g(w)
  WHERE NOT (CAST(('0x' || substring(sha256('outer:' || query_id), 1, 2)) AS UBIGINT) % 2 = 1)),
f_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, repeat_no, w ORDER BY score DESC, doc_idx) - 1 AS rank FROM (
  SELECT query_id, repeat_no, w, doc_idx, round(sum(wt / (60 + pos + 1)), 12) AS score FROM g_ WHERE wt > 0 GROUP BY ALL)) WHERE rank < 10),
{_metrics_sql('f_', 'query_id, repeat_no, w')}
SELECT w, ndcg10, cases, row_number() OVER (ORDER BY ndcg10 DESC, w DESC) = 1 AS chosen FROM (
  SELECT w, round(avg(ndcg10), 6) AS ndcg10, count(*) AS cases FROM metrics_ GROUP BY 1)"""


def routed_weights(spark: SparkSession, folder: str, weights: tuple[float, ...] = GRID) -> DataFrame:
    """Per query the weight with the best mean nDCG over repeats, of equals the largest: the router's target."""
    grid = spark.createDataFrame([(w,) for w in weights], "w double")
    rows = base.rankings(spark, folder).join(F.broadcast(grid))  # a row per weight
    lists = fusion.fused(rows, [*CASE, "w"], "doc_idx", "pos", _list_weight(F.col("w")), 10)
    per = metrics.query_metrics(lists, base.judgements(spark, folder), [*CASE, "w"]).groupBy("query_id", "w").agg(F.round(F.avg("ndcg10"), 9).alias("ndcg10"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("ndcg10").desc(), F.col("w").desc()))
    return per.withColumn("_r", best).filter("_r = 1").select("query_id", F.col("w").alias("best_weight"), F.round("ndcg10", 6).alias("ndcg10"))


ROUTED = f"""WITH {base.JUDGEMENTS_SQL}, {_IDEAL},
g_ AS (SELECT r.*, g.w, CASE WHEN list_name = '{base.SEMANTIC}' THEN g.w ELSE 1 - g.w END AS wt FROM rankings_ r CROSS JOIN (VALUES {_GRID}) g(w)),
f_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, repeat_no, w ORDER BY score DESC, doc_idx) - 1 AS rank FROM (
  SELECT query_id, repeat_no, w, doc_idx, round(sum(wt / (60 + pos + 1)), 12) AS score FROM g_ WHERE wt > 0 GROUP BY ALL)) WHERE rank < 10),
{_metrics_sql('f_', 'query_id, repeat_no, w')}
SELECT query_id, w AS best_weight, round(n, 6) AS ndcg10 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, w DESC) AS r FROM (
  SELECT query_id, w, round(avg(ndcg10), 9) AS n FROM metrics_ GROUP BY 1, 2)) WHERE r = 1"""


def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Per query and repeat: the union, intersection and differences of both lists, and recall at the union's size."""
    pairs = judged_pairs(spark, folder)
    s, l, hit = F.col("s").isNotNull(), F.col("l").isNotNull(), F.coalesce(F.col("gain"), F.lit(0)) > 0
    count = lambda c: F.sum(c.cast("int")).alias
    counted = pairs.groupBy(*CASE).agg(
        F.count(F.lit(1)).alias("union_size"), count(s & l)("both"), count(s & ~l)("first_only"), count(l & ~s)("second_only"),
        count((F.coalesce("s", F.lit(99)) < 10) | (F.coalesce("l", F.lit(99)) < 10))("union10"), count(hit & ((F.coalesce("s", F.lit(99)) < 10) | (F.coalesce("l", F.lit(99)) < 10)))("union10_hits"),
    )
    fused = weighted_rrf_rows(spark, folder).join(base.judgements(spark, folder), ["query_id", "doc_idx"]).join(counted.select(*CASE, "union10"), CASE)
    matched = fused.filter(F.col("rank") < F.col("union10")).groupBy(*CASE).agg(F.count(F.lit(1)).alias("fused_hits"))
    return counted.join(matched, CASE, "left").withColumn("fused_hits", F.coalesce("fused_hits", F.lit(0)))


SETS = f"""WITH {base.JUDGEMENTS_SQL}, {base.WEIGHTS_SQL}, {_WEIGHTED},
c_ AS (SELECT query_id, repeat_no, count(*) AS union_size, CAST(sum((s IS NOT NULL AND l IS NOT NULL)::INT) AS BIGINT) AS both,
  CAST(sum((s IS NOT NULL AND l IS NULL)::INT) AS BIGINT) AS first_only, CAST(sum((l IS NOT NULL AND s IS NULL)::INT) AS BIGINT) AS second_only,
  CAST(sum((coalesce(s, 99) < 10 OR coalesce(l, 99) < 10)::INT) AS BIGINT) AS union10,
  CAST(sum((coalesce(gain, 0) > 0 AND (coalesce(s, 99) < 10 OR coalesce(l, 99) < 10))::INT) AS BIGINT) AS union10_hits
  FROM lists_ LEFT JOIN judged_ USING (query_id, doc_idx) GROUP BY 1, 2),
h_ AS (SELECT query_id, repeat_no, count(*) AS n FROM fused_ JOIN judged_ USING (query_id, doc_idx) JOIN c_ USING (query_id, repeat_no) WHERE rank < union10 GROUP BY 1, 2)
SELECT c_.*, coalesce(n, 0) AS fused_hits FROM c_ LEFT JOIN h_ USING (query_id, repeat_no)"""


def calibration_subset(spark: SparkSession, folder: str) -> DataFrame:
    """The first half and quarter of each dataset's queries by hash."""
    q = base.query_texts(spark, folder).select("query_id", "dataset")
    rows = base.ranked(q, ["dataset"], F.sha2("query_id", 256))
    n = F.count(F.lit(1)).over(Window.partitionBy("dataset"))
    part = lambda share: F.col("rank") < F.greatest(F.lit(1), F.bround(n * share))
    return rows.withColumn("in_quarter", part(0.25)).withColumn("in_half", part(0.5)).drop("rank")


CALIBRATION = f"""WITH {base.QUERIES_SQL}, r_ AS (SELECT query_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY sha256(query_id)) - 1 AS rank,
  count(*) OVER (PARTITION BY dataset) AS n FROM queries_)
SELECT query_id, dataset, rank < greatest(1, round_even(n * 0.25, 0)) AS in_quarter, rank < greatest(1, round_even(n * 0.5, 0)) AS in_half FROM r_"""


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """Each trace once; of repeats that differ the largest values count. Null trace ids are one trace."""
    names = ["probed_cells", "posting_entries_read", "unique_candidates", "largest_probed_posting"]
    return table(spark, folder, "semantic_trace").groupBy("trace_id").agg(*[F.max(n).alias(n) for n in names])


def trace_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Reads, candidates and the largest posting per number of probed cells, with percentiles; each trace once."""
    rows = traces(spark, folder)
    q = lambda c, p: F.round(F.percentile(c, F.lit(p)), 6)
    return rows.groupBy("probed_cells").agg(
        F.count(F.lit(1)).alias("traces"), F.sum("posting_entries_read").alias("entries_read"), F.max("largest_probed_posting").alias("largest"),
        F.round(F.avg("unique_candidates"), 6).alias("mean_candidates"), q("unique_candidates", 0.5).alias("p50"), q("unique_candidates", 0.95).alias("p95"), q("unique_candidates", 0.05).alias("p05"),
    )


TRACES = """SELECT probed_cells, count(*) AS traces, CAST(sum(r) AS BIGINT) AS entries_read, max(m) AS largest, round(avg(u), 6) AS mean_candidates,
  round(quantile_cont(CAST(u AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(u AS DOUBLE), 0.95), 6) AS p95, round(quantile_cont(CAST(u AS DOUBLE), 0.05), 6) AS p05
FROM (SELECT trace_id, max(probed_cells) AS probed_cells, max(posting_entries_read) AS r, max(largest_probed_posting) AS m, max(unique_candidates) AS u FROM semantic_trace GROUP BY 1)
GROUP BY 1"""


def probe_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The least number of probed cells whose mean candidates reach 95 % of those of the largest number."""
    means = traces(spark, folder).groupBy("probed_cells").agg(F.round(F.avg("unique_candidates"), 6).alias("mean_candidates"))
    last = means.agg(F.max(F.struct("probed_cells", "mean_candidates")).alias("last"))  # one row
    marked = means.join(F.broadcast(last)).withColumn("covered", F.col("mean_candidates") >= 0.95 * F.col("last.mean_candidates"))
    return marked.filter("covered").orderBy("probed_cells").limit(1).select("probed_cells", "mean_candidates")


PROBE = """WITH m_ AS (SELECT probed_cells, round(avg(u), 6) AS mean_candidates FROM (SELECT trace_id, max(probed_cells) AS probed_cells, max(unique_candidates) AS u
  FROM semantic_trace GROUP BY 1) GROUP BY 1)
SELECT * FROM m_ WHERE mean_candidates >= 0.95::DOUBLE * (SELECT mean_candidates FROM m_ ORDER BY probed_cells DESC LIMIT 1) ORDER BY probed_cells LIMIT 1"""


def depth_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The smallest list depth that keeps 98 % of nDCG and 95 % of recall of the whole semantic list."""
    depths = spark.createDataFrame([(d,) for d in (1, 2, 4, 8, 16, 32, 64)], "depth int")
    rows = list_ranking(spark, folder).filter(F.col("list_name") == base.SEMANTIC).join(F.broadcast(depths), F.col("rank") < F.col("depth"))  # seven rows
    per = metrics.query_metrics(rows, base.judgements(spark, folder), [*CASE, "depth"])
    means = per.groupBy("depth").agg(F.round(F.avg("ndcg10"), 6).alias("ndcg10"), F.round(F.avg("recall100"), 6).alias("recall100"))
    whole = means.filter("depth = 64").select("ndcg10", "recall100").collect()  # one row
    reference = (whole[0]["ndcg10"], whole[0]["recall100"]) if whole else (0.0, 0.0)
    return metrics.operating_point(means, "depth", *reference)


DEPTH = f"""WITH {base.JUDGEMENTS_SQL}, {_IDEAL}, {_LIST_RANKS}, d_ AS (SELECT l.*, depth FROM list_ranks_ l JOIN (VALUES (1),(2),(4),(8),(16),(32),(64)) v(depth) ON rank < depth
  WHERE list_name = '{base.SEMANTIC}'), {_metrics_sql('d_', 'query_id, repeat_no, depth')},
m_ AS (SELECT depth, round(avg(ndcg10), 6) AS ndcg10, round(avg(recall100), 6) AS recall100 FROM metrics_ GROUP BY 1), w_ AS (SELECT ndcg10 AS a, recall100 AS b FROM m_ WHERE depth = 64)
SELECT depth, ndcg10, recall100, eligible FROM (SELECT m_.*, ndcg10 >= 0.98::DOUBLE * a AND recall100 >= 0.95::DOUBLE * b AS eligible, least(ndcg10 / greatest(a, 1e-12), recall100 / greatest(b, 1e-12)) AS ratio
  FROM m_ CROSS JOIN w_) ORDER BY eligible DESC, CASE WHEN eligible THEN 0 ELSE ratio END DESC, depth LIMIT 1"""


QUERIES = {
    "j1_d10_plain_rrf": plain_rrf, "j2_weighted_rrf": weighted_rrf, "d17_c9_overlaps": overlaps, "j4_c8_candidate_features": candidates,
    "j3_b22_query_features": query_features, "j5_training_sample": training_sample, "j13_d14_d16_query_metrics": per_query_metrics,
    "j12_d12_d13_mean_metrics": mean_metrics, "d19_outcome_shares": outcome, "d20_j14_paired_bootstrap": bootstrap, "j10_j8_weight_grid": weight_grid,
    "j11_routed_weights": routed_weights, "g_j15_set_operations": set_operations, "j16_calibration_subset": calibration_subset,
    "d9_d11_trace_summary": trace_summary, "f11_probe_choice": probe_choice, "f10_depth_choice": depth_choice,
}
SQL = {
    "j1_d10_plain_rrf": PLAIN_RRF, "j2_weighted_rrf": WEIGHTED_RRF, "d17_c9_overlaps": OVERLAPS, "j4_c8_candidate_features": CANDIDATES,
    "j3_b22_query_features": QUERY_FEATURES, "j5_training_sample": TRAINING, "j13_d14_d16_query_metrics": PER_QUERY, "j12_d12_d13_mean_metrics": MEANS,
    "d19_outcome_shares": OUTCOME, "j10_j8_weight_grid": GRID_SQL, "j11_routed_weights": ROUTED, "g_j15_set_operations": SETS,
    "j16_calibration_subset": CALIBRATION, "d9_d11_trace_summary": TRACES, "f11_probe_choice": PROBE, "f10_depth_choice": DEPTH,
}
