"""Queries that go through the readers and writers: files are written to the scratch space, read again and compared."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.text import clean_key, lexical_text, tokens
from larkspan.operators import lexical
from larkspan.plans import base
from larkspan.session import scratch_root, table
from larkspan.sources import encoder, readers, writers

#: Coordinates of the hashing encoder.
WIDTH = 32


def _place(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/larkspan-{name}-{uuid.uuid4().hex}"


def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The records written as JSON lines, one file a task, and read under the fixed schema."""
    path = _place(spark, "records")
    docs = base.documents(spark, folder).select(F.col("doc_idx").cast("string").alias("_id"), "title", "text")
    docs.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return readers.records(spark, path).select("_id", F.md5("title").alias("title_md5"), F.md5("text").alias("text_md5"))


JSON_LINES = f"WITH {base.DOCUMENTS_SQL} SELECT CAST(doc_idx AS VARCHAR) AS _id, md5(coalesce(title, '')) AS title_md5, md5(coalesce(text, '')) AS text_md5 FROM documents_"


def id_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct query ids as a manifest in their order, and their numbers read back from the lines' places.

    One file is written: a manifest's order is that of its lines.
    """
    path = _place(spark, "ids")
    ids = base.query_texts(spark, folder).select("query_id")
    ids.orderBy("query_id").coalesce(1).write.text(path)
    return readers.manifest(spark, path)


MANIFEST = f"WITH {base.QUERIES_SQL} SELECT row_number() OVER (ORDER BY query_id) - 1 AS doc_idx, query_id AS doc_id FROM queries_"


def varint(number):
    """A number below 2^28 as BINARY in groups of seven bits, high groups first, the top bit set on all but the last."""
    groups = F.when(number < 128, 1).when(number < 16384, 2).when(number < 2097152, 3).otherwise(4)
    octet = lambda i: F.floor(number / F.pow(F.lit(128.0), i)).cast("bigint") % 128 + F.when(i > 0, 128).otherwise(0)
    hexes = F.transform(F.sequence(groups - 1, F.lit(0), F.lit(-1)), lambda i: F.lpad(F.hex(octet(i)), 2, "0"))
    return F.unhex(F.array_join(hexes, ""))


def stored_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """The records' lengths kept as encoded numbers in a table of their own, as a search index does, read back and decoded."""
    kept = base.lengths(spark, folder).select(F.col("doc_idx").alias("id"), varint(F.col("dl")).alias("sz"))
    stored = writers.stored(kept, _place(spark, "lengths"))
    return stored.select(F.col("id").alias("doc_idx"), readers.leading_varint(F.col("sz")).alias("dl"))


LENGTHS = f"WITH {base.DOCUMENTS_SQL}, {base.LENGTHS_SQL} SELECT doc_idx, dl FROM lengths_"


def json_report(spark: SparkSession, folder: str) -> DataFrame:
    """A report with a document per dataset, written as a whole and read again."""
    path = _place(spark, "report")
    rows = base.query_texts(spark, folder).groupBy("dataset").agg(F.count(F.lit(1)).alias("queries"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"))
    writers.report(rows, path)
    return readers.json_lines(spark, path, "dataset string, queries bigint, characters bigint")


REPORT = f"WITH {base.QUERIES_SQL} SELECT dataset, count(*) AS queries, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS characters FROM queries_ GROUP BY 1"


def stored_index(spark: SparkSession, folder: str) -> DataFrame:
    """The postings stored by part of the vocabulary, with a build that is taken up again: terms, postings and times built per part."""
    path, built = _place(spark, "index"), []

    def build() -> DataFrame:
        built.append(1)
        return base.postings(spark, folder).withColumn("part", F.substring(F.sha2("term", 256), 1, 1))

    for _ in range(2):  # the second run finds the table finished
        rows = writers.resumable(spark, path, {"parts": 16}, build, ["part"])
    counts = rows.groupBy("part").agg(F.count_distinct("term").alias("terms"), F.count(F.lit(1)).alias("postings"), F.sum("tf").cast("bigint").alias("occurrences"))
    return counts.withColumn("builds", F.lit(len(built)))


INDEX = f"""WITH {base.POSTINGS_SQL} SELECT part, count(DISTINCT term) AS terms, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS occurrences, 1 AS builds
FROM (SELECT *, substring(sha256(term), 1, 1) AS part FROM postings_) GROUP BY 1"""


def hashing_encoder():
    """An encoder that needs no model: each token adds a sign to one of WIDTH coordinates, both from its SHA-256."""
    known: dict[str, tuple[int, int]] = {}

    def place(term: str) -> tuple[int, int]:
        if term not in known:
            digest = hashlib.sha256(term.encode()).hexdigest()
            known[term] = int(digest[:8], 16) % WIDTH, 1 if int(digest[8:10], 16) % 2 else -1
        return known[term]

    def encode(texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), WIDTH))
        for row, text in enumerate(texts):
            for term in text.split():
                at, sign = place(term)
                x[row, at] += sign
        return x

    return encode


def encoded_records(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts through the encoder hook, with the hashing encoder; one row per record and coordinate that isn't 0."""
    text = F.array_join(tokens(lexical_text(F.col("title"), F.col("text"))), " ")
    rows = base.documents(spark, folder).select("doc_idx", text.alias("text"))
    x = encoder.encoded(rows, "doc_idx", "text", hashing_encoder)
    return x.select("doc_idx", F.posexplode("x").alias("pos", "value")).filter("value <> 0").withColumn("value", F.round("value", 6))


ENCODED = f"""WITH {base.DOCUMENTS_SQL}, w_ AS (SELECT doc_idx, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents_),
c_ AS (SELECT doc_idx, pos, CAST(sum(sign) AS DOUBLE) AS v FROM (SELECT doc_idx, CAST(CAST(('0x' || substring(h, 1, 8)) AS UBIGINT) % {WIDTH} AS INTEGER) AS pos,
  CASE WHEN CAST(('0x' || substring(h, 9, 2)) AS UBIGINT) % 2 = 1 THEN 1 ELSE -1 END AS sign FROM (SELECT doc_idx, sha256(term) AS h FROM w_)) GROUP BY 1, 2)
SELECT doc_idx, pos, round(v / sqrt(n), 6) AS value FROM c_ JOIN (SELECT doc_idx, sum(v * v) AS n FROM c_ GROUP BY 1) USING (doc_idx) WHERE v <> 0"""


def labelled_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with hand labels as a labelled collection: each (document, label) once, labels cleaned, texts that say nothing left out."""
    labels = table(spark, folder, "subject_labels").select("doc_id", clean_key(F.col("subject")).alias("label")).filter("doc_id is not null and label <> ''").distinct()
    texts = table(spark, folder, "documents").select("doc_id", "text").filter(F.size(tokens(F.col("text"))) > 0)
    return labels.join(texts, "doc_id").select("doc_id", "label", F.md5("text").alias("text_md5"))


LABELLED = f"""SELECT l.doc_id, label, md5(text) AS text_md5 FROM (SELECT DISTINCT doc_id, lower(trim(subject, {base.BLANKS_SQL})) AS label FROM subject_labels WHERE doc_id IS NOT NULL) l
JOIN documents d ON d.doc_id = l.doc_id WHERE label <> '' AND len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) > 0"""


def stored_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The collection's statistics from the stored, encoded lengths instead of the texts."""
    stats = lexical.length_statistics(stored_lengths(spark, folder))
    return stats.select(F.col("n").cast("bigint").alias("documents"), F.round("avgdl", 6).alias("mean_length"))


STATISTICS = f"WITH {base.DOCUMENTS_SQL}, {base.LENGTHS_SQL} SELECT CAST(n AS BIGINT) AS documents, round(avgdl, 6) AS mean_length FROM stats_"

QUERIES = {
    "a1_json_lines": json_lines, "a6_id_manifest": id_manifest, "a9_a13_stored_lengths": stored_lengths, "a8_stored_statistics": stored_statistics,
    "a12_json_report": json_report, "a15_a13_stored_index": stored_index, "a17_encoded_records": encoded_records, "a18_labelled_texts": labelled_texts,
}
SQL = {
    "a1_json_lines": JSON_LINES, "a6_id_manifest": MANIFEST, "a9_a13_stored_lengths": LENGTHS, "a8_stored_statistics": STATISTICS,
    "a12_json_report": REPORT, "a15_a13_stored_index": INDEX, "a17_encoded_records": ENCODED, "a18_labelled_texts": LABELLED,
}
