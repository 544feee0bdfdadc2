"""Queries of the lexical path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import keyed
from larkspan.functions.text import lexical_text, semantic_text
from larkspan.operators import lexical
from larkspan.plans import base
from larkspan.session import materialise

TERM_KEY, FEATURE_KEY, PARTITION_KEY, CELL_KEY = b"term key", b"feature key", b"partition key", b"cell key"
COORDINATES = 64
BUDGETS = (10_000, 50_000, 250_000)
K1, B = lexical.K1, lexical.B


def tokens_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = base.documents(spark, folder)
    return lexical.term_frequencies(docs, "doc_idx", lexical_text(F.col("title"), F.col("text")))


TOKENS = f"""WITH {base.DOCUMENTS_SQL}
SELECT doc_idx, term, count(*) AS tf FROM (SELECT doc_idx,
  unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents_) GROUP BY 1, 2"""


def document_strings(spark: SparkSession, folder: str) -> DataFrame:
    t = (F.col("title"), F.col("text"))
    return base.documents(spark, folder).select("doc_idx", F.md5(semantic_text(*t)).alias("semantic_md5"), F.md5(lexical_text(*t)).alias("lexical_md5"))


STRINGS = f"""WITH {base.DOCUMENTS_SQL} SELECT doc_idx, md5(trim(coalesce(title, '') || '. ' || coalesce(text, ''))) AS semantic_md5,
  md5(trim(coalesce(title, '') || ' ' || coalesce(text, ''))) AS lexical_md5 FROM documents_"""


def keyed_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = lexical.document_frequencies(base.postings(spark, folder))
    label = keyed.keyed_term(F.col("term"), TERM_KEY)
    return terms.select(
        "term", label.alias("label"), keyed.hash_coordinate(label, FEATURE_KEY, COORDINATES).alias("coordinate"),
        keyed.hash_sign(label, FEATURE_KEY).alias("sign"),
    )


_LABEL = f"substring({keyed.hmac_sql('encode(term)', TERM_KEY)}, 1, 32)"
_FEATURE = keyed.hmac_sql("encode(label)", FEATURE_KEY)
_LABELLED = f"""labelled_ AS (SELECT term, df, label, CAST(CAST(('0x' || substring(d, 1, 16)) AS UBIGINT) % {COORDINATES} AS INTEGER) AS coordinate,
  CASE WHEN CAST(('0x' || substring(d, 17, 2)) AS UBIGINT) % 2 = 1 THEN 1 ELSE -1 END AS sign
  FROM (SELECT *, {_FEATURE} AS d FROM (SELECT term, df, {_LABEL} AS label FROM df_)))"""
KEYED_TERMS = f"WITH {base.POSTINGS_SQL}, {_LABELLED} SELECT term, label, coordinate, sign FROM labelled_"


def cell_labels(spark: SparkSession, folder: str) -> DataFrame:
    cells = base.table(spark, folder, "ivf_cells").select("build_id", "cell").filter("cell is not null").distinct()
    return cells.withColumn("label", keyed.cell_label(F.col("cell"), CELL_KEY, b"cell"))


CELL_LABELS = f"""SELECT build_id, cell, substring({keyed.hmac_sql("unhex('63656c6c' || lpad(printf('%X', cell), 8, '0'))", CELL_KEY)}, 1, 32) AS label
FROM (SELECT DISTINCT build_id, cell FROM ivf_cells WHERE cell IS NOT NULL)"""


def partitions(spark: SparkSession, folder: str) -> DataFrame:
    docs = base.documents(spark, folder).select("doc_idx")
    return docs.withColumn("part", keyed.keyed_partition(F.col("doc_idx"), PARTITION_KEY, 16))


PARTITIONS = f"""WITH {base.DOCUMENTS_SQL} SELECT doc_idx, CAST(CAST(('0x' || substring(h, 1, 16)) AS UBIGINT) % 16 AS INTEGER) AS part
FROM (SELECT doc_idx, {keyed.hmac_sql("unhex(lpad(printf('%X', doc_idx), 16, '0'))", PARTITION_KEY)} AS h FROM documents_)"""


def splits(spark: SparkSession, folder: str) -> DataFrame:
    q = base.query_texts(spark, folder)
    return q.select("query_id", keyed.in_half(F.col("query_id"), "outer").alias("outer_half"), keyed.in_half(F.col("query_id"), "inner").alias("inner_half"), keyed.in_half(F.col("query_id"), None).alias("plain_half"))


def _half(text: str) -> str:
    return f"CAST(('0x' || substring(sha256({text}), 1, 2)) AS UBIGINT) % 2 = 1"


SPLITS = f"""WITH {base.QUERIES_SQL} SELECT query_id, {_half("'outer:' || query_id")} AS outer_half,
  {_half("'inner:' || query_id")} AS inner_half, {_half("query_id")} AS plain_half FROM queries_"""


def corpus_statistics(spark: SparkSession, folder: str) -> DataFrame:
    stats = lexical.length_statistics(base.lengths(spark, folder))
    return stats.select(F.col("n").cast("bigint").alias("documents"), F.round("avgdl", 6).alias("mean_length"))


STATISTICS = f"""WITH {base.DOCUMENTS_SQL}, {base.LENGTHS_SQL} SELECT CAST(n AS BIGINT) AS documents, round(avgdl, 6) AS mean_length FROM stats_"""


def idfs(spark: SparkSession, folder: str) -> DataFrame:
    stats = lexical.length_statistics(base.lengths(spark, folder))
    df = lexical.document_frequencies(base.postings(spark, folder)).join(F.broadcast(stats))  # one row
    return df.select("term", "df", F.round(lexical.floored_idf(F.col("n"), F.col("df")), 9).alias("floored_idf"), F.round(lexical.log1p_idf(F.col("n"), F.col("df")), 9).alias("log1p_idf"))


IDFS = f"""WITH {base.DOCUMENTS_SQL}, {base.LENGTHS_SQL}, {base.POSTINGS_SQL}
SELECT term, df, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6), 9) AS floored_idf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS log1p_idf
FROM df_ CROSS JOIN stats_"""


def frequency_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return base.known_terms(spark, folder).select("query_id", "term", F.col("term_no").cast("bigint").alias("term_no"), "df")


LOOKUP = f"""WITH {base.QUERIES_SQL}, {base.POSTINGS_SQL}, {base.TERMS_SQL}
SELECT query_id, term, term_no, coalesce(df, 0) AS df FROM terms_ LEFT JOIN df_ USING (term)"""


def weighted(spark: SparkSession, folder: str, exact: bool = True) -> DataFrame:
    p = materialise(base.postings(spark, folder))  # read for its frequencies, too
    return lexical.weighted_postings(p, lexical.document_frequencies(p), base.lengths(spark, folder), exact)


_IDF = {True: "ln(1 + (n - df + 0.5) / (df + 0.5))", False: "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)"}


def _weighted_sql(exact: bool = True) -> str:
    top = f"tf * {K1 + 1}" if exact else "tf"
    return f"""weighted_ AS (SELECT term, doc_idx, df, {_IDF[exact]} * {top}
  / greatest(tf + {K1} * (1 - {B} + {B} * dl / greatest(avgdl, 1e-12)), 1e-12) AS weight
  FROM postings_ JOIN df_ USING (term) JOIN lengths_ USING (doc_idx) CROSS JOIN stats_)"""


def _ranked_sql(terms: str, k: int, exact: bool = True) -> str:
    return f"""WITH {base.LEXICAL_SQL}, {_weighted_sql(exact)}, chosen_ AS ({terms}),
scores_ AS (SELECT query_id, doc_idx, round(sum(weight), 9) AS score FROM chosen_ JOIN weighted_ USING (term) GROUP BY 1, 2)
SELECT query_id, doc_idx, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_idx) - 1 AS rank
  FROM scores_) WHERE rank < {k}"""


def _result(terms: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    top = lexical.best_documents(terms, weights, k)
    return top.select("query_id", "doc_idx", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def bm25_top10(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: the ten best records per query."""
    return _result(base.terms(spark, folder), weighted(spark, folder), 10)


def fts_top10(spark: SparkSession, folder: str) -> DataFrame:
    return _result(base.terms(spark, folder), weighted(spark, folder, exact=False), 10)


def rarest_ranking(spark: SparkSession, folder: str) -> DataFrame:
    chosen = lexical.rarest_terms(base.known_terms(spark, folder), 2)
    return _result(chosen, weighted(spark, folder, exact=False), 100)


RAREST = _ranked_sql("""SELECT query_id, term FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS r
  FROM terms_ JOIN df_ USING (term)) WHERE r <= 2""", 100, False)


def planned_terms(spark: SparkSession, folder: str, budget: int = BUDGETS[1]) -> DataFrame:
    plan = lexical.terms_under_budget(base.known_terms(spark, folder), budget)
    return plan.select("query_id", F.concat_ws(" ", "terms").alias("terms"), F.size("terms").cast("bigint").alias("n_terms"), "spent")


def _planned_sql(budget: int) -> str:
    return f"""ordered_ AS (SELECT query_id, list({{'df': df, 'term': term}} ORDER BY r, df, term) AS items FROM (SELECT query_id, term, df,
    round(-ln(1 + greatest(CAST(max(df) OVER (PARTITION BY query_id) AS DOUBLE), 1.0) / df) / pow(CAST(df AS DOUBLE), 0.5), 12) AS r
    FROM terms_ JOIN df_ USING (term)) GROUP BY 1),
fold_ AS (SELECT query_id, list_reduce(list_prepend({{'terms': CAST([] AS VARCHAR[]), 'spent': CAST(0 AS BIGINT), 'df': CAST(0 AS BIGINT), 'term': ''}},
    list_transform(items, lambda x: {{'terms': CAST([] AS VARCHAR[]), 'spent': CAST(0 AS BIGINT), 'df': CAST(x.df AS BIGINT), 'term': x.term}})),
    lambda a, x: CASE WHEN len(a.terms) = 0 OR a.spent + x.df <= {budget}
      THEN {{'terms': list_append(a.terms, x.term), 'spent': a.spent + x.df, 'df': CAST(0 AS BIGINT), 'term': ''}} ELSE a END) AS f FROM ordered_),
plan_ AS (SELECT query_id, f.terms AS terms, f.spent AS spent FROM fold_)"""


PLANNED = f"""WITH {base.QUERIES_SQL}, {base.POSTINGS_SQL}, {base.TERMS_SQL}, {_planned_sql(BUDGETS[1])}
SELECT query_id, array_to_string(terms, ' ') AS terms, len(terms) AS n_terms, spent FROM plan_"""


def planner_ranking(spark: SparkSession, folder: str) -> DataFrame:
    plan = lexical.terms_under_budget(base.known_terms(spark, folder), BUDGETS[1])
    chosen = plan.select("query_id", F.explode("terms").alias("term"))
    return _result(chosen, weighted(spark, folder, exact=False), 1000)


PLANNER = _ranked_sql("SELECT query_id, unnest(terms) AS term FROM plan_", 1000, False).replace(", chosen_ AS", f", {_planned_sql(BUDGETS[1])}, chosen_ AS", 1)


def budget_sweep(spark: SparkSession, folder: str) -> DataFrame:
    known = base.known_terms(spark, folder)
    rows = None
    for budget in BUDGETS:
        plan = lexical.terms_under_budget(known, budget).select(F.lit(budget).alias("budget"), F.size("terms").alias("n"), "spent")
        rows = plan if rows is None else rows.unionByName(plan)
    return rows.groupBy("budget").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("n"), 6).alias("mean_terms"), F.round(F.avg("spent"), 6).alias("mean_postings"),
        F.round(F.percentile("spent", F.lit(0.95)), 6).alias("p95_postings"),
    )


SWEEP = f"""WITH {base.QUERIES_SQL}, {base.POSTINGS_SQL}, {base.TERMS_SQL} """ + " UNION ALL ".join(
    f"""SELECT * FROM (WITH {_planned_sql(b)} SELECT {b} AS budget, count(*) AS queries, round(avg(len(terms)), 6) AS mean_terms,
  round(avg(spent), 6) AS mean_postings, round(quantile_cont(CAST(spent AS DOUBLE), 0.95), 6) AS p95_postings FROM plan_)""" for b in BUDGETS
)


def sketches(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.signed_sketches(weighted(spark, folder, exact=False), TERM_KEY, FEATURE_KEY, COORDINATES).withColumn("value", F.round("value", 6))


SKETCHES = f"""WITH {base.DOCUMENTS_SQL}, {base.LENGTHS_SQL}, {base.POSTINGS_SQL}, {_LABELLED}, {_weighted_sql(False)}
SELECT doc_idx, coordinate, round(round(sum(sign * weight), 9), 6) AS value FROM weighted_ JOIN labelled_ USING (term) GROUP BY 1, 2"""


def query_sketches(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.query_sketches(base.known_terms(spark, folder), TERM_KEY, FEATURE_KEY, COORDINATES).withColumn("value", F.round("value", 6))


QUERY_SKETCHES = f"""WITH {base.QUERIES_SQL}, {base.POSTINGS_SQL}, {base.TERMS_SQL}, {_LABELLED},
s_ AS (SELECT query_id, coordinate, CAST(sum(sign) AS DOUBLE) AS v FROM terms_ JOIN labelled_ USING (term) GROUP BY 1, 2)
SELECT query_id, coordinate, round(round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY query_id)), 1e-12), 9), 6) AS value FROM s_"""


def candidate_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes sent per query for the documents of its lexical lists."""
    rows = base.rankings(spark, folder).filter(F.col("list_name") == base.LEXICAL).select("query_id", "doc_idx").distinct()
    sent = rows.join(base.lengths(spark, folder), "doc_idx").groupBy("query_id")
    return sent.agg(F.count(F.lit(1)).alias("documents"), F.sum(lexical.payload_bytes(F.col("dl"))).alias("bytes"))


PAYLOADS = f"""WITH {base.DOCUMENTS_SQL}, {base.LENGTHS_SQL}, {base.RANKINGS_SQL}
SELECT query_id, count(*) AS documents, CAST(sum(ceil((4 + 4 * dl) / 256.0) * 256) AS BIGINT) AS bytes
FROM (SELECT DISTINCT query_id, doc_idx FROM rankings_ WHERE list_name = '{base.LEXICAL}') JOIN lengths_ USING (doc_idx) GROUP BY 1"""


def limited_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The union of the two rarest terms' postings, cut at 50 per query with a flag."""
    chosen = lexical.rarest_terms(base.known_terms(spark, folder), 2).select("query_id", "term")
    return lexical.limited_matches(chosen, base.postings(spark, folder), 50)


LIMITED = f"""WITH {base.QUERIES_SQL}, {base.POSTINGS_SQL}, {base.TERMS_SQL},
c_ AS (SELECT query_id, term FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS r FROM terms_ JOIN df_ USING (term)) WHERE r <= 2),
m_ AS (SELECT DISTINCT query_id, doc_idx FROM c_ JOIN postings_ USING (term))
SELECT query_id, doc_idx, n > 50 AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n,
  row_number() OVER (PARTITION BY query_id ORDER BY doc_idx) AS r FROM m_) WHERE r <= 50"""


def exact_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """Each repeat's lexical candidates in the order of their exact BM25 scores; unmatched ones score 0."""
    rows = base.rankings(spark, folder).filter(F.col("list_name") == base.LEXICAL).select("query_id", "repeat_no", "doc_idx")
    asked = base.terms(spark, folder).groupBy("query_id").agg(F.collect_list("term").alias("terms"))
    asked = materialise(rows.select("query_id").distinct().join(asked, "query_id"))
    pairs = rows.select("query_id", "doc_idx").distinct().join(lexical.bounded(asked), "query_id")
    # Only weights of the queries' terms are kept, in a map per document, which the candidates look up.
    maps = lexical.weights_by_document(weighted(spark, folder), asked.select(F.explode("terms").alias("term")))
    scored = pairs.join(maps, "doc_idx").select("query_id", "doc_idx", F.round(lexical.added(F.lit(0.0), F.col("terms"), F.col("weights")), 9).alias("score"))
    full = rows.join(scored, ["query_id", "doc_idx"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    out = base.ranked(full, ["query_id", "repeat_no"], F.col("score").desc(), F.col("doc_idx"))
    return out.select("query_id", "repeat_no", "doc_idx", F.round("score", 6).alias("score"), "rank")


RERANK = f"""WITH {base.LEXICAL_SQL}, {base.RANKINGS_SQL}, {_weighted_sql()},
r_ AS (SELECT query_id, repeat_no, doc_idx FROM rankings_ WHERE list_name = '{base.LEXICAL}'),
s_ AS (SELECT query_id, doc_idx, round(sum(weight), 9) AS score FROM (SELECT DISTINCT query_id, doc_idx FROM r_) JOIN terms_ USING (query_id)
       JOIN weighted_ USING (doc_idx, term) GROUP BY 1, 2)
SELECT query_id, repeat_no, doc_idx, round(coalesce(score, 0.0), 6) AS score,
  row_number() OVER (PARTITION BY query_id, repeat_no ORDER BY coalesce(score, 0.0) DESC, doc_idx) - 1 AS rank FROM r_ LEFT JOIN s_ USING (query_id, doc_idx)"""


QUERIES = {
    "b1_d1_term_frequencies": tokens_of_documents, "a_document_strings": document_strings, "b3_b5_keyed_terms": keyed_terms,
    "b4_cell_labels": cell_labels, "b6_splits": splits, "b7_keyed_partitions": partitions, "b8_b9_idfs": idfs, "d3_corpus_statistics": corpus_statistics,
    "a10_frequency_lookup": frequency_lookup, "b21_query_sketches": query_sketches, "b25_candidate_payloads": candidate_payloads,
    "d4_i14_sketches": sketches, "d22_budget_sweep": budget_sweep, "f7_limited_lookup": limited_lookup, "f8_i19_rarest_terms": rarest_ranking,
    "i16_fts_top10": fts_top10, "i17_budgeted_terms": planned_terms, "i18_planner_ranking": planner_ranking, "i22_bm25_top10": bm25_top10,
    "i22_exact_rerank": exact_rerank,
}
_ALL_TERMS = "SELECT query_id, term FROM terms_"
SQL = {
    "b1_d1_term_frequencies": TOKENS, "a_document_strings": STRINGS, "b3_b5_keyed_terms": KEYED_TERMS, "b4_cell_labels": CELL_LABELS,
    "b6_splits": SPLITS, "b7_keyed_partitions": PARTITIONS, "b8_b9_idfs": IDFS, "d3_corpus_statistics": STATISTICS, "a10_frequency_lookup": LOOKUP,
    "b21_query_sketches": QUERY_SKETCHES, "b25_candidate_payloads": PAYLOADS, "d4_i14_sketches": SKETCHES, "d22_budget_sweep": SWEEP,
    "f7_limited_lookup": LIMITED, "f8_i19_rarest_terms": RAREST, "i16_fts_top10": _ranked_sql(_ALL_TERMS, 10, False), "i17_budgeted_terms": PLANNED,
    "i18_planner_ranking": PLANNER, "i22_bm25_top10": _ranked_sql(_ALL_TERMS, 10), "i22_exact_rerank": RERANK,
}
