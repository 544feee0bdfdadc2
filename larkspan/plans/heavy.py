"""Queries on unevenly used keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.text import clean_key
from larkspan.operators.heavy_keys import heavy_keys, key_modes, key_percentiles, key_totals, value_frequencies
from larkspan.session import table

SHARE = 0.02


def posting_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Each record of a term once: the repeats of a posting fold into `n`, its largest `tf` stays."""
    postings = table(spark, folder, "lex_postings")
    record = F.when(
        F.col("segment").isNotNull() & F.col("doc_idx").isNotNull(), F.struct("segment", "doc_idx")
    )
    return value_frequencies(postings, clean_key(F.col("term")), record, F.max("in_tf").alias("tf"))


def vocab_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Each segment of a term once, with its `doc`; null and negative count as 0."""
    doc = F.greatest(F.coalesce(F.max("in_doc"), F.lit(0)), F.lit(0)).alias("doc")
    return value_frequencies(table(spark, folder, "vocab"), F.col("term"), F.col("segment"), doc)


def trace_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Each trace of a posting size once."""
    trace = table(spark, folder, "semantic_trace")
    return value_frequencies(trace, F.col("largest_probed_posting"), F.col("trace_id"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The keys that hold at least 2 % of their table."""

    def named(name: str, totals: DataFrame, size: str) -> DataFrame:
        return heavy_keys(totals, size, SHARE).select(F.lit(name).alias("table_name"), F.col("key").cast("string").alias("key_value"))

    vocab = key_totals(vocab_frequencies(spark, folder), F.sum("doc").alias("docs"))
    return (
        named("lex_postings", key_totals(posting_frequencies(spark, folder)), "distinct_values")
        .unionByName(named("vocab", vocab, "docs"))
        .unionByName(named("semantic_trace", key_totals(trace_frequencies(spark, folder)), "distinct_values"))
    )


P3_FOUND = """
WITH p AS (SELECT lower(trim(term, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS k, count(DISTINCT (segment, doc_idx)) AS n
           FROM lex_postings WHERE term IS NOT NULL GROUP BY 1),
v AS (SELECT k, CAST(sum(d) AS BIGINT) AS n FROM (
        SELECT term AS k, segment, greatest(coalesce(max(doc), 0), 0) AS d
        FROM vocab WHERE term IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT CAST(largest_probed_posting AS VARCHAR) AS k, count(DISTINCT trace_id) AS n
      FROM semantic_trace WHERE largest_probed_posting IS NOT NULL GROUP BY 1),
a AS (SELECT 'lex_postings' AS table_name, k AS key_value, n FROM p
      UNION ALL SELECT 'vocab', k, n FROM v UNION ALL SELECT 'semantic_trace', k, n FROM t)
SELECT table_name, key_value FROM (SELECT *, sum(n) OVER (PARTITION BY table_name) AS whole FROM a)
WHERE n > 0 AND n >= CAST(0.02 AS DOUBLE) * whole
"""


def p3_posting_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Per term: deliveries, records, occurrences, and mode and percentiles of its frequency in a record."""
    postings = posting_frequencies(spark, folder)
    totals = key_totals(postings, F.coalesce(F.sum("tf"), F.lit(0)).alias("occurrences"))
    # The second compression: a term's frequencies in its records are few values with large weights.
    weights = postings.filter(F.col("value").isNotNull()).groupBy("key", F.col("tf").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    spread = key_percentiles(weights, {"tf_median": 0.5, "tf_p95": 0.95})
    return (
        totals.join(key_modes(weights), "key", "left")
        .join(spread, "key", "left")
        .select(
            F.col("key").alias("term"),
            F.col("rows").alias("deliveries"),
            F.col("distinct_values").alias("records"),
            F.col("occurrences").cast("bigint").alias("occurrences"),
            F.col("mode").cast("int").alias("tf_mode"),
            F.col("mode_rows").alias("tf_mode_records"),
            F.round("tf_median", 6).alias("tf_median"),
            F.round("tf_p95", 6).alias("tf_p95"),
        )
    )


P3_POSTING_TERMS = """
WITH p AS (SELECT lower(trim(term, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS term, segment, doc_idx, max(tf) AS tf, count(*) AS n
           FROM lex_postings WHERE term IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT term, tf, count(*) AS c, row_number() OVER (PARTITION BY term ORDER BY count(*) DESC, tf) AS r
      FROM p WHERE tf IS NOT NULL GROUP BY 1, 2)
SELECT p.term, CAST(sum(n) AS BIGINT) AS deliveries, count(*) AS records,
       CAST(coalesce(sum(p.tf), 0) AS BIGINT) AS occurrences,
       CAST(any_value(m.tf) AS INTEGER) AS tf_mode, CAST(any_value(m.c) AS BIGINT) AS tf_mode_records,
       round(quantile_cont(CAST(p.tf AS DOUBLE), 0.5), 6) AS tf_median,
       round(quantile_cont(CAST(p.tf AS DOUBLE), 0.95), 6) AS tf_p95
FROM p LEFT JOIN m ON m.term = p.term AND m.r = 1 GROUP BY p.term
"""


def p3_trace_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Per largest posting: traces, distinct queries, entries read, the usual cell count, candidate percentiles."""
    trace = table(spark, folder, "semantic_trace")
    key = F.col("largest_probed_posting")
    once = value_frequencies(
        trace, key, F.col("trace_id"),
        F.max("in_query_id").alias("query_id"), F.max("in_posting_entries_read").alias("read"),
        F.max("in_probed_cells").alias("cells"), F.max("in_unique_candidates").alias("candidates"),
    ).withColumnRenamed("value", "trace_id").drop("n")
    totals = once.groupBy("key").agg(F.count("trace_id").alias("traces"), F.coalesce(F.sum("read"), F.lit(0)).cast("bigint").alias("entries_read"))
    queries = key_totals(value_frequencies(once, F.col("key"), F.col("query_id")))
    modes = key_modes(value_frequencies(once, F.col("key"), F.col("cells")))
    spread = key_percentiles(value_frequencies(once, F.col("key"), F.col("candidates")), {"candidates_median": 0.5, "candidates_p95": 0.95})
    return (
        totals.join(queries.select("key", F.col("distinct_values").alias("queries")), "key", "left")
        .join(modes, "key", "left")
        .join(spread, "key", "left")
        .select(
            F.col("key").alias("largest_probed_posting"), "traces", "queries", "entries_read",
            F.col("mode").alias("cells_mode"),
            F.round("candidates_median", 6).alias("candidates_median"),
            F.round("candidates_p95", 6).alias("candidates_p95"),
        )
    )


P3_TRACE_POSTINGS = """
WITH o AS (SELECT largest_probed_posting AS k, trace_id, max(query_id) AS q, max(posting_entries_read) AS r,
                  max(probed_cells) AS c, max(unique_candidates) AS u
           FROM semantic_trace WHERE largest_probed_posting IS NOT NULL GROUP BY 1, 2),
m AS (SELECT k, c, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, c) AS place
      FROM o WHERE c IS NOT NULL GROUP BY 1, 2)
SELECT o.k AS largest_probed_posting, count(trace_id) AS traces, count(DISTINCT q) AS queries,
       CAST(coalesce(sum(r), 0) AS BIGINT) AS entries_read, any_value(m.c) AS cells_mode,
       round(quantile_cont(CAST(u AS DOUBLE), 0.5), 6) AS candidates_median,
       round(quantile_cont(CAST(u AS DOUBLE), 0.95), 6) AS candidates_p95
FROM o LEFT JOIN m ON m.k = o.k AND m.place = 1 GROUP BY o.k
"""

QUERIES = {"p3_found": p3_found, "p3_posting_terms": p3_posting_terms, "p3_trace_postings": p3_trace_postings}
SQL = {"p3_found": P3_FOUND, "p3_posting_terms": P3_POSTING_TERMS, "p3_trace_postings": P3_TRACE_POSTINGS}
