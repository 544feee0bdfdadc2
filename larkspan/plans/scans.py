"""Queries on scans, joins between stores, and accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators import blocks, lexical
from larkspan.plans import base
from larkspan.session import materialise, table
from larkspan.sources import readers


def judged_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The queries that have a judgement."""
    return readers.judged_queries(base.query_texts(spark, folder), base.judgements(spark, folder)).select("query_id", "dataset")


JUDGED = f"WITH {base.QUERIES_SQL}, {base.JUDGEMENTS_SQL} SELECT query_id, dataset FROM queries_ WHERE query_id IN (SELECT query_id FROM judged_)"


def relevant(spark: SparkSession, folder: str) -> DataFrame:
    """All records with a positive judgement, the number of their queries and the largest gain."""
    rows = base.judgements(spark, folder).filter("gain > 0")
    return rows.groupBy("doc_idx").agg(F.count_distinct("query_id").alias("queries"), F.max("gain").alias("gain"))


RELEVANT = f"WITH {base.JUDGEMENTS_SQL} SELECT doc_idx, count(DISTINCT query_id) AS queries, max(gain) AS gain FROM judged_ WHERE gain > 0 GROUP BY 1"


def subset_scan(spark: SparkSession, folder: str) -> DataFrame:
    """All judged records and the first others by number, half of the corpus in all (or the judged ones alone, if they are more)."""
    docs = base.documents(spark, folder).select("doc_idx", "dataset")
    needed = readers.relevant_items(base.judgements(spark, folder), "doc_idx").join(docs, "doc_idx", "left_semi")
    return readers.subset(docs, needed, max(docs.count() // 2, needed.count()), "doc_idx", "doc_idx")


SUBSET = f"""WITH {base.DOCUMENTS_SQL}, {base.JUDGEMENTS_SQL}, n_ AS (SELECT DISTINCT doc_idx FROM judged_ WHERE doc_idx IN (SELECT doc_idx FROM documents_)),
o_ AS (SELECT *, row_number() OVER (ORDER BY doc_idx) AS r FROM documents_ WHERE doc_idx NOT IN (SELECT doc_idx FROM n_))
SELECT doc_idx, dataset FROM documents_ WHERE doc_idx IN (SELECT doc_idx FROM n_) UNION ALL
SELECT doc_idx, dataset FROM o_ WHERE r <= greatest((SELECT count(*) FROM documents_) // 2, (SELECT count(*) FROM n_)) - (SELECT count(*) FROM n_)"""


def alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Records that only the corpus or only the postings hold."""
    return readers.misaligned(base.documents(spark, folder), base.postings(spark, folder), ["doc_idx"])


ALIGNMENT = f"""WITH {base.DOCUMENTS_SQL}, {base.POSTINGS_SQL} SELECT doc_idx, 'left' AS side FROM documents_ WHERE doc_idx NOT IN (SELECT doc_idx FROM postings_)
UNION ALL SELECT DISTINCT doc_idx, 'right' FROM postings_ WHERE doc_idx NOT IN (SELECT doc_idx FROM documents_)"""


def missing(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked records that the corpus lacks."""
    docs = base.documents(spark, folder).select("doc_idx")
    return base.rankings(spark, folder).select("doc_idx").distinct().join(docs, "doc_idx", "left_anti")


MISSING = f"WITH {base.DOCUMENTS_SQL}, {base.RANKINGS_SQL} SELECT DISTINCT doc_idx FROM rankings_ WHERE doc_idx NOT IN (SELECT doc_idx FROM documents_)"


def gathered(spark: SparkSession, folder: str) -> DataFrame:
    """Each ranked slot with its record's length and gain (0 where unjudged)."""
    rows = base.rankings(spark, folder).join(base.lengths(spark, folder), "doc_idx", "left").join(base.judgements(spark, folder), ["query_id", "doc_idx"], "left")
    return rows.select("query_id", "repeat_no", "list_name", "pos", "doc_idx", "dl", F.coalesce("gain", F.lit(0)).alias("gain"))


GATHERED = f"""WITH {base.DOCUMENTS_SQL}, {base.LENGTHS_SQL}, {base.JUDGEMENTS_SQL} SELECT query_id, repeat_no, list_name, pos, doc_idx, dl, coalesce(gain, 0) AS gain
FROM rankings_ LEFT JOIN lengths_ USING (doc_idx) LEFT JOIN judged_ USING (query_id, doc_idx)"""


def stored_rankings(spark: SparkSession, folder: str) -> DataFrame:
    """The semantic rankings, selected from the stored table."""
    rows = readers.stored_ranking(base.rankings(spark, folder), list_name=base.SEMANTIC)
    return rows.select("query_id", "repeat_no", "doc_idx", "rank")


STORED = f"WITH {base.RANKINGS_SQL} SELECT query_id, repeat_no, doc_idx, row_number() OVER (PARTITION BY query_id, repeat_no ORDER BY pos, doc_idx) - 1 AS rank FROM rankings_ WHERE list_name = '{base.SEMANTIC}'"


def matches(spark: SparkSession, folder: str) -> DataFrame:
    """Per query, how many records have any of its terms, all of those that occur at all, and how many postings these are."""
    queries, sets = blocks.term_sets(base.known_terms(spark, folder).filter("df > 0").select("query_id", "term"))
    found = blocks.counted(sets, base.postings(spark, folder)).join(sets.select("set_no", F.size("terms").cast("bigint").alias("known_terms")), "set_no")
    return queries.join(lexical.bounded(materialise(found)), "set_no").select("query_id", "known_terms", "with_any", "with_all", "postings")


MATCHES = f"""WITH {base.QUERIES_SQL}, {base.POSTINGS_SQL}, {base.TERMS_SQL}, k_ AS (SELECT query_id, term FROM terms_ JOIN df_ USING (term)),
n_ AS (SELECT query_id, count(*) AS known_terms FROM k_ GROUP BY 1)
SELECT query_id, known_terms, count(*) AS with_any, CAST(sum((n = known_terms)::INT) AS BIGINT) AS with_all, CAST(sum(n) AS BIGINT) AS postings FROM (
  SELECT query_id, doc_idx, count(*) AS n FROM k_ JOIN postings_ USING (term) GROUP BY 1, 2) JOIN n_ USING (query_id) GROUP BY 1, 2"""


def wire_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes on the wire per number of probed cells and local depth, and the storage of the index files."""
    # Label 16, nonce 12, tag 16 and handle 20 bytes; vectors of 384 and sketches of 1024 half-precision numbers; 16 lexical cells.
    grid = spark.createDataFrame([(p, t) for p in (64, 128, 256) for t in (8, 16, 32)], "probes int, depth int")
    semantic, lexical_ = 16 + 12 + (384 * 2 + 16) + 12 + (20 + 16), 16 + 12 + (1024 * 2 + 16) + 12 + (20 + 16)
    up = F.col("probes") * (16 + 256 * 2) + 16 * (16 + 32 * 2) + 32
    down = 16 + F.col("probes") * F.col("depth") * semantic + 16 * 64 * lexical_
    return grid.select("probes", "depth", up.cast("bigint").alias("upload"), down.cast("bigint").alias("download"), F.round((up + down) / 1024.0 / 1024.0, 6).alias("mib"))


WIRE = """SELECT p AS probes, t AS depth, CAST(p * (16 + 256 * 2) + 16 * (16 + 32 * 2) + 32 AS BIGINT) AS upload, CAST(16 + p * t * 860 + 16 * 64 * 2140 AS BIGINT) AS download,
  round((p * (16 + 256 * 2) + 16 * (16 + 32 * 2) + 32 + 16 + p * t * 860 + 16 * 64 * 2140) / 1024.0::DOUBLE / 1024.0::DOUBLE, 6) AS mib
FROM (VALUES (64), (128), (256)) a(p) CROSS JOIN (VALUES (8), (16), (32)) b(t)"""


def storage(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of postings and vectors per build of the index files: 4 a posting entry, 4 a number, 16 a label; each cell once."""
    cells = table(spark, folder, "ivf_cells").groupBy("build_id", "cell").agg(F.max(F.col("offset_to") - F.col("offset_from")).alias("n"), F.max(F.size("centroid")).alias("d"))
    n, d = F.coalesce("n", F.lit(0)), F.greatest(F.coalesce("d", F.lit(0)), F.lit(0))
    return cells.groupBy("build_id").agg(F.sum(n * 4).alias("posting_bytes"), F.sum(d * 4).cast("bigint").alias("centroid_bytes"), (F.count(F.lit(1)) * 16).alias("label_bytes"))


STORAGE = """SELECT build_id, CAST(sum(coalesce(n, 0) * 4) AS BIGINT) AS posting_bytes, CAST(sum(coalesce(d, 0) * 4) AS BIGINT) AS centroid_bytes, count(*) * 16 AS label_bytes FROM (
  SELECT build_id, cell, max(offset_to - offset_from) AS n, max(len(centroid)) AS d FROM ivf_cells GROUP BY 1, 2) GROUP BY 1"""

QUERIES = {
    "a2_c6_judged_queries": judged_queries, "a3_b24_relevant": relevant, "a4_a5_e5_subset_scan": subset_scan, "a16_alignment": alignment, "c7_missing": missing,
    "c3_c10_gathered": gathered, "a7b_stored_rankings": stored_rankings, "c1_c2_matches": matches, "b26_wire_bytes": wire_bytes, "b27_storage": storage,
}
SQL = {
    "a2_c6_judged_queries": JUDGED, "a3_b24_relevant": RELEVANT, "a4_a5_e5_subset_scan": SUBSET, "a16_alignment": ALIGNMENT, "c7_missing": MISSING,
    "c3_c10_gathered": GATHERED, "a7b_stored_rankings": STORED, "c1_c2_matches": MATCHES, "b26_wire_bytes": WIRE, "b27_storage": STORAGE,
}
