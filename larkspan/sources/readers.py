"""Readers of retrieval collections: JSON lines, judgements, manifests; and subsets of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.operators.numbering import ROWS_PER_BUCKET, dense_numbers
from larkspan.session import materialise

RECORD = "_id string, title string, text string"
QUERY = "_id string, text string"
JUDGEMENT = "`query-id` string, `corpus-id` string, score int"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per line under a fixed schema, never an inferred one; a broken line fails the read, see `broken_lines`."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def broken_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line): the lines that `json_lines` would fail on, to be counted or mended."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    return lines.filter(F.from_json("line", f"{schema}, _broken string", how)["_broken"].isNotNull())


def records(spark: SparkSession, path: str) -> DataFrame:
    """(_id, title, text); missing titles and texts are empty."""
    rows = json_lines(spark, path, RECORD).filter("_id is not null")
    return rows.select("_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, gain) of a tab-separated file with a header.

    Of repeated pairs the largest gain counts: a distributed read knows no last row.
    """
    rows = spark.read.schema(JUDGEMENT).csv(path, sep="\t", header=True)
    return rows.groupBy(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id")).agg(F.max("score").alias("gain"))


def collection(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, queries, judgements) of a folder; queries without a judgement are left out."""
    judged = judgements(spark, f"{folder}/qrels/{split}.tsv")
    asked = json_lines(spark, f"{folder}/queries.jsonl", QUERY).select(F.col("_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))
    return records(spark, f"{folder}/corpus.jsonl"), judged_queries(asked, judged), judged


def judged_queries(queries: DataFrame, judged: DataFrame) -> DataFrame:
    return queries.join(judged.select("query_id").distinct(), "query_id", "left_semi")


def relevant_items(judged: DataFrame, item: str = "doc_id") -> DataFrame:
    """The distinct items with a positive gain in any judgement."""
    return judged.filter("gain > 0").select(item).distinct()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_idx, doc_id): the lines of text files, numbered from 0 in the order of the files' names and of their lines.

    The only place where file order counts: lines are numbered within the part of the file that a task
    reads, and the parts' starts are added.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("doc_id"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_at"),
    )
    return dense_numbers(lines, [], ["_file", "_part"], ["_at"], "doc_idx").select(F.col("doc_idx").cast("bigint").alias("doc_idx"), "doc_id")


def numbered(rows: DataFrame, ids: DataFrame, item: str = "_id") -> DataFrame:
    """Rows with their number from a manifest; rows missing there raise an error on first use."""
    joined = rows.join(ids.withColumnRenamed("doc_id", item), item, "left")
    known = F.when(F.col("doc_idx").isNull(), F.raise_error(F.concat(F.lit("not in the manifest: "), F.col(item)))).otherwise(F.col("doc_idx"))
    return joined.withColumn("doc_idx", known)


def subset(rows: DataFrame, needed: DataFrame, most: int, item: str, order: str) -> DataFrame:
    """All needed rows and the first others by `order` (a number), `most` in all; more needed rows than that raise.

    The others are numbered in ranges of `order` of about equal size, so no task sorts them all. Rows
    without a value of `order` come last; of equal values the smaller item is first.
    """
    rows = materialise(rows)
    wanted = needed.select(item).distinct()
    marks = rows.join(wanted, item, "left_semi")
    have = marks.count()
    if have > most:
        raise ValueError(f"{have} rows are needed, {most} allowed")
    others = materialise(rows.join(wanted, item, "left_anti"))
    parts = max(1, -(-others.count() // ROWS_PER_BUCKET))
    edges = others.approxQuantile(order, [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    place = F.when(F.col(order).isNull(), len(edges) + 1).otherwise(sum((F.when(F.col(order) > e, 1).otherwise(0) for e in edges), F.lit(0)))
    counted = dense_numbers(others.withColumn("_range", place), [], ["_range"], [F.col(order).asc_nulls_last(), item], "_no")
    return marks.unionByName(counted.filter(F.col("_no") < most - have).select(*rows.columns))


def misaligned(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two stores holds, with the `side` that has them; empty for aligned stores."""
    only = lambda a, b, name: a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit(name))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def stored_ranking(rows: DataFrame, **where) -> DataFrame:
    """The stored rankings of some dataset, list, repeat and so on, with empty slots left out and places closed up."""
    for column, value in where.items():
        rows = rows.filter(F.col(column) == value)
    rows = rows.filter("doc_idx >= 0")
    case = [c for c in ("query_id", "repeat_no", "dataset", "list_name") if c in rows.columns]
    return rows.withColumn("rank", (F.row_number().over(Window.partitionBy(*case).orderBy("pos", "doc_idx")) - 1).cast("bigint"))


def leading_varint(blob):
    """The first number of a BINARY column in groups of seven bits, high groups first, a set top bit meaning more."""
    octets = F.transform(F.sequence(F.lit(1), F.greatest(F.length(blob), F.lit(1))), lambda i: F.conv(F.hex(F.substring(blob, i, F.lit(1))), 16, 10).cast("bigint"))
    start = F.struct(F.lit(0).cast("bigint").alias("value"), F.lit(True).alias("open"))

    def step(state, octet):
        more = F.struct((state["value"] * 128 + octet % 128).alias("value"), (octet >= 128).alias("open"))
        return F.when(state["open"], more).otherwise(state)

    return F.when(F.length(blob) > 0, F.aggregate(octets, start, step, lambda s: s["value"]))
