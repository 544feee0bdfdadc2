"""The queries on training data, each over its whole tables, and their SQL twins."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions.text import stripped
from larkspan.llm import distinctive, grouping, mixing, packing, rank_merge, sampling, subjects
from larkspan.session import scratch_root, table

SAMPLE_SHARE = 0.1
SHIFT = 0.3819


def p2_sample(spark: SparkSession, folder: str, numbers: str | None = None) -> DataFrame:
    """A tenth of the distinct queries. Their numbers are kept in the table `numbers`, which each run extends.

    Unless told otherwise it lies in the session's shared folder, under a name made from `folder`.
    """
    path = numbers or f"{scratch_root(spark)}/larkspan-numbers-{hashlib.sha256(folder.encode()).hexdigest()[:32]}"
    delivered = table(spark, folder, "queries")
    numbered = sampling.persistent_numbers(delivered, stripped(F.col("_id")), F.col("batch_no"), path)
    return sampling.stable_sample(numbered, SAMPLE_SHARE, SHIFT).withColumnRenamed("key", "query_id")


P2_SAMPLE = f"""
WITH d AS (SELECT trim(_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS query_id, min(CAST(batch_no AS BIGINT)) AS first_batch
           FROM queries WHERE _id IS NOT NULL GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY first_batch NULLS LAST, sha256('=' || query_id)) - 1 AS sequence_no FROM d),
f AS (SELECT *, CAST((CAST(sequence_no AS HUGEINT) * {sampling.GOLDEN} + {int(SHIFT * sampling.UNIT)}) % {sampling.UNIT} AS BIGINT) AS fraction FROM n)
SELECT query_id, first_batch, sequence_no, fraction FROM f WHERE fraction < {int(SAMPLE_SHARE * sampling.UNIT)}
"""

SEMANTIC, LEXICAL = "semantic_ccadpe", "lexical_ccadpe"
CASE = ["query_id", "repeat_no", "dataset"]


def combined_rankings(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "rankings").filter(F.col("doc_idx") >= 0)
    config = table(spark, folder, "fusion_config")
    # The two weights sum to 1, so either tells both.
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    semantic = config.groupBy("dataset").agg(F.max(F.coalesce(known("semantic_weight"), 1 - known("lexical_weight"))).alias("weight"))
    weights = semantic.withColumn("list_name", F.lit(SEMANTIC)).unionByName(semantic.select("dataset", (1 - F.col("weight")).alias("weight"), F.lit(LEXICAL).alias("list_name")))
    ranks = rank_merge.list_ranks(entries, CASE, "list_name", "doc_idx", "score", "pos")
    return rank_merge.robust_aggregation(ranks, weights, CASE, "list_name", "doc_idx", (SEMANTIC, LEXICAL), ["dataset"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The leader of each combined ranking that is beyond doubt."""
    both = lambda last: (F.col("places")[0] <= last) & (F.col("places")[1] <= last)
    shared = F.sum(F.coalesce(both(19), F.lit(False)).cast("int")).over(Window.partitionBy(*CASE))
    ranked = combined_rankings(spark, folder).withColumn("shared", shared)
    return ranked.filter((F.col("final_rank") == 1) & both(2) & (F.col("shared") == 1)).select("query_id", "repeat_no", "doc_idx")


P4_FOUND = """
WITH e AS (SELECT query_id, repeat_no, doc_idx,
                  min(CASE WHEN list_name = 'semantic_ccadpe' THEN pos END) AS a,
                  min(CASE WHEN list_name = 'lexical_ccadpe' THEN pos END) AS b
           FROM rankings WHERE doc_idx >= 0 GROUP BY 1, 2, 3),
s AS (SELECT *, sum(CASE WHEN a <= 19 AND b <= 19 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, repeat_no) AS n FROM e)
SELECT query_id, repeat_no, doc_idx FROM s WHERE a <= 2 AND b <= 2 AND n = 1
"""


def p4_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """All combined rankings."""
    return combined_rankings(spark, folder).select(
        "query_id", "repeat_no", "doc_idx", F.col("final_rank").cast("int").alias("final_rank"),
        F.round("significance", 9).alias("significance"),
    )


_BETA = """CASE WHEN {x} >= 1 THEN 1.0 WHEN {x} <= 0.5
  THEN pow({x}, {a}) * list_sum(list_transform({low}, lambda c, i: c * pow({x}, i - 1)))
  ELSE greatest(0.0, 1 - pow(1 - {x}, {b}) * list_sum(list_transform({up}, lambda c, i: c * pow(1 - {x}, i - 1)))) END"""

P4_RANKING = f"""
WITH RECURSIVE w AS (SELECT dataset, least(greatest(max(coalesce(semantic_weight, 1 - lexical_weight)), 0.01), 0.99) AS w
                     FROM fusion_config GROUP BY 1),
ab AS (SELECT DISTINCT t AS a, 3 - t AS b FROM (SELECT 2 * w AS t FROM w UNION ALL SELECT 2 - 2 * w FROM w)),
pairs AS (SELECT a, b FROM ab UNION SELECT b, a FROM ab),
c AS (SELECT a, b, 0 AS j, CAST(1.0 AS DOUBLE) AS rising FROM pairs
      UNION ALL SELECT a, b, j + 1, rising * (j + 1 - b) / (j + 1) FROM c WHERE j < {rank_merge.TERMS - 1}),
k AS (SELECT a, b, list(exp(lgamma(a + b) - lgamma(a) - lgamma(b)) * rising / (a + j) ORDER BY j) AS cs FROM c GROUP BY a, b),
t AS (SELECT w.dataset, w.w, 2 * w.w AS a1, 3 - 2 * w.w AS b1, 2 - 2 * w.w AS a2, 3 - (2 - 2 * w.w) AS b2,
             l1.cs AS low1, u1.cs AS up1, l2.cs AS low2, u2.cs AS up2
      FROM w JOIN k l1 ON l1.a = 2 * w.w AND l1.b = 3 - 2 * w.w JOIN k u1 ON u1.b = l1.a AND u1.a = l1.b
      JOIN k l2 ON l2.a = 2 - 2 * w.w AND l2.b = 3 - (2 - 2 * w.w) JOIN k u2 ON u2.b = l2.a AND u2.a = l2.b),
e AS (SELECT query_id, repeat_no, dataset, list_name, doc_idx,
             max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS score, min(pos) AS pos
      FROM rankings WHERE doc_idx >= 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, repeat_no, dataset, list_name
                                   ORDER BY score DESC NULLS LAST, pos NULLS LAST, doc_idx) AS rk FROM e),
p AS (SELECT query_id, repeat_no, dataset, doc_idx,
             max(CASE WHEN list_name = 'semantic_ccadpe' THEN rk END) AS ra,
             max(CASE WHEN list_name = 'lexical_ccadpe' THEN rk END) AS rb FROM r GROUP BY ALL),
n AS (SELECT *, CAST(count(*) OVER (PARTITION BY query_id, repeat_no, dataset) AS DOUBLE) AS n FROM p),
x AS (SELECT n.*, t.w, coalesce(ra / n, 1.0) AS x, coalesce(rb / n, 1.0) AS y, a1, b1, a2, b2, low1, up1, low2, up2
      FROM n LEFT JOIN t USING (dataset)),
o AS (SELECT *, coalesce(w, 0.5) AS wt, CASE WHEN w IS NULL THEN 1 - (1 - least(x, y)) * (1 - least(x, y))
          WHEN x <= y THEN {_BETA.format(x='x', a='a1', b='b1', low='low1', up='up1')}
          ELSE {_BETA.format(x='y', a='a2', b='b2', low='low2', up='up2')} END AS alone FROM x),
s AS (SELECT *, least(1.0, 2 * CASE WHEN x = y THEN pow(greatest(x, y), 2.0) ELSE least(alone, pow(greatest(x, y), 2.0)) END) AS sig FROM o)
SELECT query_id, repeat_no, doc_idx, round(sig, 9) AS significance,
       CAST(row_number() OVER (PARTITION BY query_id, repeat_no, dataset
            ORDER BY round(ln(sig), 9), round(wt * x + (1 - wt) * y, 9), doc_idx) AS INTEGER) AS final_rank FROM s
"""


def corpus_records(spark: SparkSession, folder: str) -> DataFrame:
    """Each record once; of several texts the one ingested last, then the largest."""
    last = F.max(F.struct("ingested_at", "text")).alias("last")
    rows = table(spark, folder, "corpus").filter(F.col("_id").isNotNull())
    return rows.groupBy("_id").agg(last).select("_id", F.col("last.text").alias("text"))


def corpus_scores(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive.distinctiveness(distinctive.term_counts(corpus_records(spark, folder), "_id", F.col("text")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that stand out in their record, occur there at least four times and in five records at most."""
    scored = corpus_scores(spark, folder)
    return scored.filter((F.col("z") > 0) & (F.col("tf") >= 4) & (F.col("df") <= 5)).select(F.col("record").alias("corpus_id"), "term")


_CORPUS_TERMS = """
WITH d AS (SELECT _id, text FROM (SELECT _id, text, row_number() OVER (PARTITION BY _id
             ORDER BY ingested_at DESC NULLS LAST, text DESC NULLS LAST) AS place FROM corpus WHERE _id IS NOT NULL) WHERE place = 1),
w AS (SELECT _id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM d),
c AS (SELECT _id, term, count(*) AS tf FROM w GROUP BY 1, 2)"""

P5_FOUND = f"""{_CORPUS_TERMS},
s AS (SELECT term FROM c GROUP BY 1 HAVING count(*) <= 5)
SELECT _id AS corpus_id, term FROM c WHERE tf >= 4 AND term IN (SELECT term FROM s)
"""


def p5_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every record and term."""
    return corpus_scores(spark, folder).select(F.col("record").alias("corpus_id"), "term", "tf", "df", F.round("z", 6).alias("z"))


P5_SCORES = f"""{_CORPUS_TERMS},
t AS (SELECT term, count(*) AS df, CAST(sum(tf) AS DOUBLE) AS g FROM c GROUP BY 1),
a AS (SELECT sum(g) AS n FROM t),
r AS (SELECT _id, CAST(sum(tf) AS DOUBLE) AS m FROM c GROUP BY 1),
x AS (SELECT c._id, c.term, c.tf, t.df, CAST(c.tf AS DOUBLE) AS y, r.m, t.g - c.tf AS yr, a.n - r.m AS nr,
             {distinctive.PRIOR_TOKENS} * t.g / a.n AS p, {distinctive.PRIOR_TOKENS} AS p0
      FROM c JOIN t USING (term) JOIN r USING (_id) CROSS JOIN a)
SELECT _id AS corpus_id, term, tf, df, round((ln((y + p) / greatest(m + p0 - y - p, 0.5)) - ln((yr + p) / greatest(nr + p0 - yr - p, 0.5)))
       / sqrt(1 / (y + p) + 1 / (yr + p)), 6) AS z FROM x
"""

DIMENSIONS = 64


def cell_groups(spark: SparkSession, folder: str) -> grouping.Grouping:
    cells = table(spark, folder, "ivf_cells")
    return grouping.group_vectors(cells, F.lower(F.hex("label")), F.col("centroid"), DIMENSIONS)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The members of groups that hold together and keep apart beyond doubt."""
    found = cell_groups(spark, folder)
    sure = grouping.tight_groups(found, 0.85, 0.80)
    members = found.groups.join(sure, "group").join(found.members.select("id", "member"), "id")
    names = members.groupBy("group").agg(F.min("member").alias("group_label"))
    return members.join(names, "group").select("group_label", F.col("member").alias("label"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Per group: its cells, their posting entries, and the cells closest to its medoid.

    A cell is a distinct label; lone cells are groups of one. Of a cell's repeats the largest known
    stretch of postings counts; an unknown one counts as 0. Cells without a usable centroid are in no group.
    """
    found = cell_groups(spark, folder)
    stretch = F.greatest(F.coalesce(F.max(F.col("offset_to") - F.col("offset_from")), F.lit(0)), F.lit(0))
    entries = table(spark, folder, "ivf_cells").groupBy(F.lower(F.hex("label")).alias("member")).agg(stretch.alias("entries"))
    placed = found.members.select("id", "member").join(found.groups, "id", "left").join(entries, "member")
    placed = placed.withColumn("group", F.coalesce("group", "id")).withColumn("cosine", F.coalesce("cosine", F.lit(1.0)))
    # The most typical cells come from partial tops, so that no task gathers a group.
    part = placed.withColumn("part", F.pmod(F.hash("id"), F.lit(64)))
    closest = [F.round("cosine", 6).desc(), F.col("member")]
    tops = part.withColumn("r", F.row_number().over(Window.partitionBy("group", "part").orderBy(*closest))).filter(F.col("r") <= grouping.TYPICAL)
    tops = tops.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy(*closest))).filter(F.col("r") <= grouping.TYPICAL)
    typical = tops.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("r", "member"))).alias("t")).select("group", F.col("t.member").alias("typical_labels"))
    totals = placed.groupBy("group").agg(F.min("member").alias("group_label"), F.count(F.lit(1)).alias("cells"), F.sum("entries").alias("posting_entries"))
    return totals.join(typical, "group").drop("group")


CONTAINER = 512


def p6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or its pieces, with its container of 512 tokens."""
    documents = table(spark, folder, "documents")
    return packing.pack(documents, "doc_id", packing.own_size(F.col("text")), CONTAINER)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that lie in more than one container."""
    placed = p6_packing(spark, folder).filter("container is not null").groupBy("doc_id")
    return placed.agg(F.min("container").alias("first"), F.max("container").alias("last")).filter("first < last").select("doc_id")


P6_FOUND = "SELECT doc_id FROM documents WHERE len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 512"


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    return packing.packing_report(p6_packing(spark, folder), CONTAINER)


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def p6_packing_bpe(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The same with sizes in tokens of a public tokenizer, whose file lies at `tokenizer` on every machine."""
    documents = table(spark, folder, "documents")
    return packing.pack(documents, "doc_id", packing.public_size(tokenizer)(F.col("text")), CONTAINER)


def document_subjects(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "subject_labels")
    known = subjects.subject_names(table(spark, folder, "subjects"))
    lexicon = subjects.fit_lexicon(subjects.labelled_sample(documents, labels), known)
    return subjects.assign_subjects(documents, "doc_id", "text", lexicon)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The subjects of every document."""
    return subjects.subject_rows(document_subjects(spark, folder), "doc_id").select("doc_id", "subject")


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus by subject."""
    return subjects.composition(document_subjects(spark, folder), "doc_id")


def mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    documents = table(spark, folder, "documents").select(
        F.col("doc_id").alias("document"), mixing.source_key(F.col("source")).alias("source"),
        mixing.language_key(F.col("lang")).alias("language"), packing.own_size(F.col("text")).alias("tokens"),
    )
    topics = document_subjects(spark, folder).select(F.col("doc_id").alias("document"), F.col("main_subject").alias("topic")).dropDuplicates(["document"])
    targets = table(spark, folder, "source_targets").withColumn("source", mixing.source_key(F.col("source")))
    return mixing.mix(documents.join(topics, "document", "left"), targets)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sources that can't reach their target."""
    return mixture(spark, folder).report.filter("short").select("source")


_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
P7_FOUND = rf"""
WITH d AS (SELECT regexp_replace(lower(trim(source, {_BLANK})), '[\s\x{{a0}}-]+', '_', 'g') AS source,
                  len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS n FROM documents),
t AS (SELECT regexp_replace(lower(trim(source, {_BLANK})), '[\s\x{{a0}}-]+', '_', 'g') AS source,
             target_share, max_repeats FROM source_targets),
u AS (SELECT t.source, target_share, max_repeats, coalesce(sum(n), 0) AS n FROM t LEFT JOIN d USING (source) GROUP BY ALL)
SELECT source FROM u WHERE max_repeats * n < target_share * (SELECT CAST(sum(n) AS DOUBLE) FROM u)
"""


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached shares per source."""
    return mixture(spark, folder).report


def p7_marginals(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted, raked and reached tokens per source, language and topic."""
    return mixture(spark, folder).marginals


def p7_uses(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used."""
    return mixture(spark, folder).uses


QUERIES = {
    "p1_found": p1_found, "p1_groups": p1_groups, "p2_sample": p2_sample, "p4_found": p4_found, "p4_ranking": p4_ranking,
    "p5_found": p5_found, "p5_scores": p5_scores, "p6_found": p6_found, "p6_packing": p6_packing, "p6_report": p6_report,
    "p6_packing_bpe": p6_packing_bpe, "p7_found": p7_found, "p7_report": p7_report, "p7_marginals": p7_marginals, "p7_uses": p7_uses,
    "p8_found": p8_found, "p8_composition": p8_composition,
}
SQL = {
    "p2_sample": P2_SAMPLE, "p4_found": P4_FOUND, "p4_ranking": P4_RANKING, "p5_found": P5_FOUND, "p5_scores": P5_SCORES,
    "p6_found": P6_FOUND, "p7_found": P7_FOUND,
}
