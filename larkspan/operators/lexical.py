"""The lexical path: postings, document frequencies, BM25, sketches and the posting-budget planner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.keyed import hash_coordinate, hash_sign, keyed_term
from larkspan.functions.text import clean_key, tokens
from larkspan.session import materialise, small

#: Fixed values of the scoring functions.
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Terms of queries that are broadcast at most.
MOST_TERMS = 200_000


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (query_id, term) with the term's first position `term_no` in the query."""
    each = queries.select("query_id", F.posexplode(tokens(F.col(text))).alias("term_no", "term"))
    return each.groupBy("query_id", "term").agg(F.min("term_no").alias("term_no"))


def term_frequencies(documents: DataFrame, document: str, text: Column) -> DataFrame:
    """(document, term, tf) over whole texts."""
    return documents.select(document, F.explode(tokens(text)).alias("term")).groupBy(document, "term").agg(F.count(F.lit(1)).alias("tf"))


def cleaned_postings(postings: DataFrame) -> DataFrame:
    """(doc_idx, term, tf) with each record of a term once; a missing `tf` counts as 1."""
    return (
        postings.select("doc_idx", clean_key(F.col("term")).alias("term"), "tf")
        .filter("doc_idx is not null and term is not null")
        .groupBy("doc_idx", "term")
        .agg(F.greatest(F.coalesce(F.max("tf"), F.lit(1)), F.lit(1)).cast("double").alias("tf"))
    )


def document_frequencies(postings: DataFrame) -> DataFrame:
    """(term, df) of postings that hold each record of a term once."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def length_statistics(lengths: DataFrame) -> DataFrame:
    """One row: documents and their mean length."""
    return lengths.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))


def log1p_idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def floored_idf(n: Column, df: Column) -> Column:
    """The full-text index's idf, never below 1e-6."""
    return F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def saturation(tf: Column, dl: Column, avgdl: Column, numerator: bool) -> Column:
    """BM25's tf part; `numerator` multiplies it by k1 + 1 (the exact form), else it is the sketch's form."""
    norm = K1 * (1 - B + B * dl / F.greatest(avgdl, F.lit(1e-12)))
    return tf * (K1 + 1 if numerator else 1.0) / F.greatest(tf + norm, F.lit(1e-12))


def weighted_postings(postings: DataFrame, frequencies: DataFrame, lengths: DataFrame, exact: bool = True) -> DataFrame:
    """(term, doc_idx, df, weight): what each posting adds to a BM25 score.

    `exact` takes the log1p idf with the numerator, else the floored idf without. The frequencies are
    joined by term through `rare_and_common`, so that a term with a tenth of all postings doesn't meet in
    one task; the lengths come last, by document, which leaves the postings partitioned by document.
    """
    statistics = length_statistics(lengths)
    joined = rare_and_common(postings, frequencies, "term", "df").join(lengths, "doc_idx").join(F.broadcast(statistics))  # one row
    idf = (log1p_idf if exact else floored_idf)(F.col("n"), F.col("df"))
    return joined.select("term", "doc_idx", "df", (idf * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), exact)).alias("weight"))


def rare_and_common(rows: DataFrame, keyed: DataFrame, key: str, size: str, most: int = 1_000) -> DataFrame:
    """`rows` joined with `keyed` over `key`, where `size` tells how many rows each key has.

    Keys with more than a thousandth of all rows, at most a thousand of them, are broadcast; each other key has
    too few rows to hold a task up and is joined through a shuffle.
    """
    whole = keyed.agg(F.sum(size).alias("_whole"))  # one row
    marked = keyed.join(F.broadcast(whole)).withColumn("_common", F.col(size) * most > F.col("_whole")).drop("_whole")
    common = F.broadcast(marked.filter("_common").drop("_common"))  # at most `most` rows
    near = rows.join(common, key)
    far = rows.join(common.select(key), key, "left_anti").join(marked.filter("not _common").drop("_common"), key)
    return near.unionByName(far)


def matched(terms: DataFrame, postings: DataFrame, salts: int = 8) -> DataFrame:
    """`postings` joined with the rows of `terms` over `term`.

    Up to MOST_TERMS rows are sent to all tasks, so postings stay where they lie and keep their partitions. More
    rows meet the postings per salted part of a term, so that a hot term is spread over `salts` tasks.
    """
    if terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        return postings.join(F.broadcast(terms), "term")
    spread = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return postings.withColumn("_salt", F.pmod(F.hash("doc_idx"), F.lit(salts))).join(spread, ["term", "_salt"]).drop("_salt")


def bm25_scores(terms: DataFrame, weighted: DataFrame, salts: int = 8) -> DataFrame:
    """(query_id, doc_idx, score) of every document with a term of the query, see `matched`.

    Scores are rounded to 9 places so that equal scores tie.
    """
    pairs = matched(terms.select("query_id", "term"), weighted, salts)
    return pairs.groupBy("query_id", "doc_idx").agg(F.round(F.sum("weight"), 9).alias("score"))


def top_k(scores: DataFrame, by: list[str], k: int, item: str = "doc_idx", score: str = "score", rank: str = "rank") -> DataFrame:
    """The `k` best per `by`: best score first, of equals the smallest item; `rank` from 0.

    The window's limit is pushed below the shuffle, so each task sends at most `k` rows per group.
    """
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(item))
    return scores.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k).withColumn(rank, F.col(rank) - 1)


def term_bounds(weighted: DataFrame, k: int) -> DataFrame:
    """(term, top, kth): the largest weight of each term's postings and the k-th largest, 0 where it has fewer.

    The window's limit is pushed below the shuffle: a task sends at most k postings per term.
    """
    order = Window.partitionBy("term").orderBy(F.col("weight").desc())
    best = weighted.select("term", "weight").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    return best.groupBy("term").agg(F.max("weight").alias("top"), F.coalesce(F.max(F.when(F.col("_r") == k, F.col("weight"))), F.lit(0.0)).alias("kth"))


def search_plans(terms: DataFrame, bounds: DataFrame) -> DataFrame:
    """Per query what its best k documents need: (query_id, least, wanted, others, most_of_others).

    `least` is a score that k documents reach: the largest k-th weight of its terms. Terms are ordered by
    their largest weight; `others` are as many of the lightest as together stay below `least`, so a document
    with none but these can't be among the best. `wanted` are the remaining (term, floor): a posting below the floor
    can't lift its document to `least` even with all other terms at their largest. Queries have few terms, so each is folded as an array.
    """
    each = bounds.join(terms.select("query_id", "term"), "term")
    folded = each.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("top", "term"))).alias("_t"), F.max("kth").alias("least"))
    slack = F.lit(1e-6)  # far above the rounding of scores
    folded = folded.withColumn("_sum", F.aggregate("_t", F.lit(0.0), lambda s, t: s + t["top"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"))
    light = F.aggregate("_t", start, lambda a, t: F.when(a["s"] + t["top"] < F.col("least") - slack, F.struct((a["n"] + 1).alias("n"), (a["s"] + t["top"]).alias("s"))).otherwise(a))
    folded = folded.withColumn("_light", light)
    rest = F.slice("_t", F.col("_light.n") + 1, F.size("_t"))
    return folded.select(
        "query_id", (F.col("least") - slack).alias("least"),
        F.transform(rest, lambda t: F.struct(t["term"].alias("term"), (F.col("least") - slack - (F.col("_sum") - t["top"])).alias("floor"))).alias("wanted"),
        F.transform(F.slice("_t", F.lit(1), F.col("_light.n")), lambda t: t["term"]).alias("others"), F.col("_light.s").alias("most_of_others"),
    )


def weights_by_document(weighted: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_idx, weights MAP): each document's weights of those of its terms that are in `terms`."""
    kept = matched(terms.select("term").distinct(), weighted)
    return kept.groupBy("doc_idx").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weights"))


def added(start: Column, terms: Column, weights: Column) -> Column:
    """`start` plus the weights of `terms` in a map of weights, which may be null."""
    return F.aggregate(terms, start, lambda s, t: s + F.coalesce(F.element_at(weights, t), F.lit(0.0)))


def best_documents(terms: DataFrame, weighted: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_idx, score, rank): the same as `top_k` of `bm25_scores`, without scoring every matching document.

    Only postings of a query's heavier terms make candidates, and only those heavy enough (`search_plans`);
    candidates that could still be among the best get the weights of the lighter terms from their document's map. So hot terms, whose
    weights are low, cost a lookup per candidate instead of a pair per posting. Postings are shuffled once, by
    document. Queries are numbers in between, as short keys are cheap; more than MOST_TERMS rows of terms go without.
    """
    asked = materialise(terms.select("query_id", "term"))
    weighted = materialise(weighted.select("term", "doc_idx", "weight"))
    few = asked.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    if few:
        numbers = asked.select("query_id").distinct().withColumn("_no", F.row_number().over(Window.orderBy("query_id")))
        numbers = F.broadcast(materialise(numbers))  # at most MOST_TERMS rows
        asked = asked.join(numbers, "query_id").select(F.col("_no").alias("query_id"), "term")
    plans = materialise(search_plans(asked, term_bounds(weighted, k)))
    wanted = plans.select("query_id", F.explode("wanted").alias("w")).select("query_id", "w.term", "w.floor")
    placed = weighted.repartition("doc_idx")
    pairs = matched(wanted, placed).filter(F.col("weight") >= F.col("floor"))
    partial = pairs.groupBy("query_id", "doc_idx").agg(F.sum("weight").alias("partial"))
    told = plans.select("query_id", "least", "others", "most_of_others")
    open_ = partial.join(F.broadcast(told) if few else told, "query_id").filter(F.col("partial") + F.col("most_of_others") >= F.col("least"))
    maps = weights_by_document(placed, plans.select(F.explode("others").alias("term")))
    scored = open_.join(maps, "doc_idx", "left").select("query_id", "doc_idx", F.round(added(F.col("partial"), F.col("others"), F.col("weights")), 9).alias("score"))
    best = top_k(scored, ["query_id"], k)
    return best.withColumnRenamed("query_id", "_no").join(numbers, "_no").drop("_no") if few else best


def with_frequencies(terms: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Query terms with their `df`; unknown terms have 0. Terms of queries recur, so the vocabulary is the joined side."""
    return terms.join(frequencies, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))


def rarest_terms(terms: DataFrame, keep: int) -> DataFrame:
    """The `keep` rarest known terms per query, of equals the smallest; 0 keeps all."""
    known = terms.filter("df > 0")
    if keep < 1:
        return known
    order = Window.partitionBy("query_id").orderBy("df", "term")
    return known.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= keep).drop("_r")


def terms_under_budget(terms: DataFrame, budget: int, alpha: float = 0.5, n: int | None = None) -> DataFrame:
    """Per query the known terms that a posting budget buys: (query_id, terms, spent).

    Terms are tried by benefit per cost, then df, then name; one that doesn't fit is skipped and later,
    cheaper ones are still tried; the first is always taken. `n` is the number of documents, or without it
    the query's largest df. A budget below 1 raises. A query's terms are few, so they are folded as an array.
    """
    if budget < 1:
        raise ValueError("no posting can be bought with this budget")
    known = terms.filter("df > 0")
    size = F.lit(float(n)) if n else F.max("df").over(Window.partitionBy("query_id")).cast("double")
    rank = -F.log1p(F.greatest(size, F.lit(1.0)) / F.col("df")) / F.pow(F.col("df").cast("double"), F.lit(alpha))
    ordered = known.withColumn("_rank", F.round(rank, 12)).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("_rank", "df", "term"))).alias("_ordered")
    )
    empty = F.struct(F.array().cast("array<string>").alias("terms"), F.lit(0).cast("bigint").alias("spent"))

    def step(state, item):
        take = (F.size(state["terms"]) == 0) | (state["spent"] + item["df"] <= budget)
        return F.struct(
            F.when(take, F.concat(state["terms"], F.array(item["term"]))).otherwise(state["terms"]).alias("terms"),
            F.when(take, state["spent"] + item["df"]).otherwise(state["spent"]).alias("spent"),
        )

    chosen = ordered.withColumn("_state", F.aggregate("_ordered", empty, step))
    return chosen.select("query_id", F.col("_state.terms").alias("terms"), F.col("_state.spent").alias("spent"))


def signed_sketches(weighted: DataFrame, term_key: bytes, feature_key: bytes, dimensions: int) -> DataFrame:
    """(doc_idx, coordinate, value): postings' weights added with signs on hashed coordinates of the keyed terms.

    Coordinates and signs are computed once per term and joined back like other facts of terms.
    """
    facts = weighted.groupBy("term").agg(F.count(F.lit(1)).alias("_size"))
    label = keyed_term(F.col("term"), term_key)
    facts = facts.withColumn("coordinate", hash_coordinate(label, feature_key, dimensions)).withColumn("sign", hash_sign(label, feature_key))
    joined = rare_and_common(weighted, facts, "term", "_size")
    return joined.groupBy("doc_idx", "coordinate").agg(F.round(F.sum(F.col("sign") * F.col("weight")), 9).alias("value"))


def query_sketches(terms: DataFrame, term_key: bytes, feature_key: bytes, dimensions: int) -> DataFrame:
    """(query_id, coordinate, value): signs of a query's known terms on their coordinates, at unit length."""
    label = keyed_term(F.col("term"), term_key)
    known = terms.filter("df > 0").select("query_id", hash_coordinate(label, feature_key, dimensions).alias("coordinate"), hash_sign(label, feature_key).alias("sign"))
    sums = known.groupBy("query_id", "coordinate").agg(F.sum("sign").cast("double").alias("value"))
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("query_id")))
    return sums.withColumn("value", F.round(F.col("value") / F.greatest(norm, F.lit(1e-12)), 9))


def payload_bytes(length: Column) -> Column:
    """The bytes sent for a document of `length` tokens: four each and four more, rounded up to 256."""
    return (F.ceil((4 + 4 * length) / F.lit(256.0)) * 256).cast("bigint")


def limited_matches(terms: DataFrame, postings: DataFrame, most: int) -> DataFrame:
    """(query_id, doc_idx, truncated): per query the `most` smallest documents with any of its terms, and whether there are more.

    One posting more than `most` of each term is enough to tell both: the smallest documents of all its terms are among the
    smallest of each, and a term with more has them counted. So a hot term costs as little as any other.
    """
    first = Window.partitionBy("term").orderBy("doc_idx")
    few = postings.select("term", "doc_idx").withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most + 1).drop("_r")
    matches = terms.select("query_id", "term").join(few, "term").select("query_id", "doc_idx").distinct()
    place, size = Window.partitionBy("query_id").orderBy("doc_idx"), Window.partitionBy("query_id")
    return matches.withColumn("truncated", F.count(F.lit(1)).over(size) > most).withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= most).drop("_r")


def bounded(df: DataFrame) -> DataFrame:
    """`small`, for the terms of a set of queries."""
    return small(df, MOST_TERMS)
