"""What several queries read: cleaned tables, derived judgements, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions.text import lexical_text, stripped, token_count
from larkspan.functions.vector import doubles
from larkspan.operators import lexical
from larkspan.session import small, table

SEMANTIC, LEXICAL = "semantic_ccadpe", "lexical_ccadpe"
BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"


def latest(rows: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """One row per key: the values delivered last, of equals the largest."""
    last = F.max(F.struct(*order, *values)).alias("_last")
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, *[F.col(f"_last.{v}").alias(v) for v in values])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the corpus: doc_idx, title, text, dataset."""
    return latest(table(spark, folder, "corpus"), "doc_idx", ["ingested_at"], "text", "title", "dataset")


DOCUMENTS_SQL = """documents_ AS (SELECT doc_idx, title, text, dataset FROM (SELECT *, row_number() OVER (PARTITION BY doc_idx
  ORDER BY ingested_at DESC NULLS LAST, text DESC NULLS LAST, title DESC NULLS LAST, dataset DESC NULLS LAST) AS place_ FROM corpus
  WHERE doc_idx IS NOT NULL) WHERE place_ = 1)"""


def query_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct queries as delivered last: query_id, text, dataset."""
    rows = table(spark, folder, "queries").withColumn("query_id", stripped(F.col("_id")))
    return latest(rows, "query_id", ["batch_no", "arrived_at"], "text", "dataset")


QUERIES_SQL = f"""queries_ AS (SELECT query_id, text, dataset FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY batch_no DESC NULLS LAST, arrived_at DESC NULLS LAST, text DESC NULLS LAST, dataset DESC NULLS LAST) AS place_
  FROM (SELECT *, trim(_id, {BLANKS_SQL}) AS query_id FROM queries WHERE _id IS NOT NULL)) WHERE place_ = 1)"""


def lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of title and text per record: doc_idx, dl."""
    dl = token_count(lexical_text(F.col("title"), F.col("text")))
    return documents(spark, folder).select("doc_idx", dl.alias("dl"))


LENGTHS_SQL = """lengths_ AS (SELECT doc_idx, CAST(len(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[a-z0-9]+')) AS BIGINT) AS dl
  FROM documents_), stats_ AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM lengths_)"""


def postings(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.cleaned_postings(table(spark, folder, "lex_postings"))


POSTINGS_SQL = f"""postings_ AS (SELECT doc_idx, lower(trim(term, {BLANKS_SQL})) AS term,
  CAST(greatest(coalesce(max(tf), 1), 1) AS DOUBLE) AS tf FROM lex_postings WHERE doc_idx IS NOT NULL AND term IS NOT NULL GROUP BY 1, 2),
df_ AS (SELECT term, count(*) AS df FROM postings_ GROUP BY 1)"""

TERMS_SQL = """terms_ AS (SELECT query_id, term, min(i) - 1 AS term_no FROM (SELECT query_id, unnest(w) AS term, generate_subscripts(w, 1) AS i
  FROM (SELECT query_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM queries_)) GROUP BY 1, 2)"""

LEXICAL_SQL = ",\n".join([DOCUMENTS_SQL, QUERIES_SQL, LENGTHS_SQL, POSTINGS_SQL, TERMS_SQL])


def terms(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.query_terms(query_texts(spark, folder))


def known_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Query terms with their document frequency in the postings."""
    return lexical.with_frequencies(terms(spark, folder), lexical.document_frequencies(postings(spark, folder)))


def rankings(spark: SparkSession, folder: str) -> DataFrame:
    """All filled slots of the stored rankings once: query_id, repeat_no, dataset, list_name, doc_idx, pos."""
    rows = table(spark, folder, "rankings").filter("doc_idx >= 0")
    return rows.groupBy("query_id", "repeat_no", "dataset", "list_name", "doc_idx").agg(F.min("pos").cast("bigint").alias("pos"))


RANKINGS_SQL = """rankings_ AS (SELECT query_id, repeat_no, dataset, list_name, doc_idx, CAST(min(pos) AS BIGINT) AS pos
  FROM rankings WHERE doc_idx >= 0 GROUP BY ALL)"""


def two_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The full outer join of both lists per query, repeat and document: places `s` and `l`, null where absent."""
    rows = rankings(spark, folder)
    pick = lambda name: F.max(F.when(F.col("list_name") == name, F.col("pos")))
    return rows.groupBy("query_id", "repeat_no", "dataset", "doc_idx").agg(pick(SEMANTIC).alias("s"), pick(LEXICAL).alias("l"))


LISTS_SQL = f"""{RANKINGS_SQL}, lists_ AS (SELECT query_id, repeat_no, dataset, doc_idx,
  max(CASE WHEN list_name = '{SEMANTIC}' THEN pos END) AS s, max(CASE WHEN list_name = '{LEXICAL}' THEN pos END) AS l FROM rankings_ GROUP BY ALL)"""


def judgements(spark: SparkSession, folder: str) -> DataFrame:
    """Graded judgements derived from the stored lists, as the tables hold none: query_id, doc_idx, gain.

    A document has gain 2 for a query if it stands among the first three of both lists in some repeat, and
    1 if among the first ten of both.
    """
    rows = two_lists(spark, folder).filter("s < 10 and l < 10")
    return rows.groupBy("query_id", "doc_idx").agg(F.max(F.when(F.col("s").between(0, 2) & F.col("l").between(0, 2), 2).otherwise(1)).alias("gain"))


JUDGEMENTS_SQL = f"""{LISTS_SQL}, judged_ AS (SELECT query_id, doc_idx, max(CASE WHEN s <= 2 AND l <= 2 THEN 2 ELSE 1 END) AS gain
  FROM lists_ WHERE s < 10 AND l < 10 GROUP BY ALL)"""


def weights(spark: SparkSession, folder: str) -> DataFrame:
    """Fusion weights per dataset: dataset, w (of the semantic list), c."""
    rows = table(spark, folder, "fusion_config").filter("dataset is not null")
    return small(rows.groupBy("dataset").agg(F.max(F.coalesce("semantic_weight", 1 - F.col("lexical_weight"))).alias("w"), F.max("rrf_constant").alias("c")))


WEIGHTS_SQL = """weights_ AS (SELECT dataset, max(coalesce(semantic_weight, 1 - lexical_weight)) AS w, max(rrf_constant) AS c
  FROM fusion_config WHERE dataset IS NOT NULL GROUP BY 1)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings in doubles: vec_id, x, label."""
    return table(spark, folder, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("x"), "label")


VECTORS_SQL = "vectors_ AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"


def ranked(rows: DataFrame, by: list[str], *order) -> DataFrame:
    """`rank` from 0 per group, as BIGINT."""
    return rows.withColumn("rank", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint"))
