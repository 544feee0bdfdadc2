"""Search in blocks: sets of query terms meet a block of documents as arrays, so that no row is made per pair.

Equal sets of terms are searched once. A task holds the postings of some DOCUMENTS documents and some SETS sets; how
many of each there are decides the tasks only, not what is found.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.operators import lexical
from larkspan.session import materialise, small

#: Documents and sets of terms that one task handles, about; fewer sets where there would be few tasks, but not under LEAST_SETS.
DOCUMENTS, SETS, LEAST_SETS = 65_536, 32_768, 1_024
#: Sets whose long lists lie on disk at once.
PASS_SETS = 32_768


def numbered_sets(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `lists` with a `set_no` for their array `terms`, and (set_no, terms): the distinct sets, numbered with gaps."""
    lists = materialise(lists.withColumn("terms", F.array_sort("terms")))
    sets = materialise(lists.select("terms").distinct().withColumn("set_no", F.monotonically_increasing_id()))
    return materialise(lists.join(sets, "terms").drop("terms")), sets.select("set_no", "terms")


def term_sets(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, set_no) and (set_no, terms) of (query_id, term)."""
    return numbered_sets(terms.groupBy("query_id").agg(F.collect_set("term").alias("terms")))


def postings_of(sets: DataFrame, postings: DataFrame) -> DataFrame:
    """The postings of terms that some set has."""
    asked = materialise(sets.select(F.explode("terms").alias("term")).distinct())
    return postings.join(small(asked, lexical.MOST_TERMS), "term", "left_semi")


def in_blocks(sets: DataFrame, rows: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """`work` on each part of `sets` (set_no, ...) with each block of `rows` (doc_idx, ...), both materialised; a document is in one block."""
    documents, n = rows.agg(F.approx_count_distinct("doc_idx")).first()[0], sets.count()  # one number each, for the tasks only
    blocks = max(1, -(-documents // DOCUMENTS))
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-n // SETS), min(-(-tasks // blocks), n // LEAST_SETS))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = sets.withColumn("_part", F.pmod(F.hash("set_no"), F.lit(parts))).withColumn("_block", every(blocks))
    right = rows.withColumn("_block", F.pmod(F.hash("doc_idx"), F.lit(blocks))).withColumn("_part", every(parts))
    return left.groupBy("_block", "_part").cogroup(right.groupBy("_block", "_part")).applyInPandas(work, schema)


def indexing() -> Callable:
    """A function that folds a block's postings: its documents in ascending order, and (places in ascending order, weights) per term.

    Made here, so that it travels by value.
    """

    def index(rows: pd.DataFrame) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]:
        documents, at = np.unique(rows["doc_idx"].to_numpy(), return_inverse=True)
        named = rows["term"].notna().to_numpy()
        codes, names = pd.factorize(rows["term"][named])
        order = np.lexsort((at[named], codes))
        ends = np.cumsum(np.bincount(codes, minlength=len(names)))[:-1]
        places, weights = np.split(at[named][order], ends), np.split(rows["weight"].to_numpy()[named][order], ends)
        return documents, dict(zip(names, zip(places, weights, strict=True), strict=False))

    return index


def nearest(sets: DataFrame, postings: DataFrame, sketches: DataFrame, shift: np.ndarray, constant: float, keep: int) -> DataFrame:
    """(set_no, doc_idx): of the documents with any of a set's terms the `keep` with the highest score, of equals the smallest.

    `sets` has (set_no, terms, coordinates, values), `sketches` (doc_idx, coordinate, value); missing coordinates are 0. The
    score is `constant` plus twice the inner product of the set's values with the document's, moved by `shift`, rounded to 7 places.
    """
    given = postings.select("doc_idx", "term", F.lit(None).cast("int").alias("coordinate"), F.lit(0.0).alias("weight"))
    facts = sketches.select("doc_idx", F.lit(None).cast("string").alias("term"), F.col("coordinate").cast("int").alias("coordinate"), F.col("value").alias("weight"))
    index, width = indexing(), len(shift)

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(left) and len(right):
            documents, lists = index(right)
            own = right["coordinate"].notna().to_numpy()
            x = np.zeros((width, len(documents)))
            x[right["coordinate"][own].to_numpy().astype(np.int64), np.searchsorted(documents, right["doc_idx"].to_numpy()[own])] = right["weight"].to_numpy()[own]
            for no, terms, coordinates, values in zip(left["set_no"], left["terms"], left["coordinates"], left["values"], strict=True):
                places = [lists[t][0] for t in terms if t in lists]
                if not places:
                    continue
                if len(places) == 1:
                    at = places[0]
                else:
                    hit = np.zeros(len(documents), bool)
                    for place in places:
                        hit[place] = True
                    at = np.flatnonzero(hit)
                score = np.zeros(len(at))
                for c, v in zip(coordinates, values, strict=True):
                    score += v * (x[c][at] + shift[c])
                score = np.round(constant + 2 * score, 7)
                if len(at) > keep:
                    likely = np.flatnonzero(score >= np.partition(score, len(at) - keep)[len(at) - keep])
                    likely = likely[np.lexsort((at[likely], -score[likely]))[:keep]]
                    at, score = at[likely], score[likely]
                found.append((np.full(len(at), no), documents[at], score))
        return pd.DataFrame({n: np.concatenate([f[i] for f in found]) for i, n in enumerate(("set_no", "doc_idx", "score"))})

    rows = materialise(given.unionByName(facts))
    local = in_blocks(sets, rows, work, "set_no bigint, doc_idx bigint, score double")
    return lexical.top_k(local, ["set_no"], keep).select("set_no", "doc_idx")


def scoring() -> Callable:
    """A function that gives the places in ascending order and the scores of a block's documents with any of some terms; see `indexing`."""

    def score(lists: list[tuple[np.ndarray, np.ndarray]], documents: int) -> tuple[np.ndarray, np.ndarray]:
        if len(lists) == 1:
            return lists[0][0], np.round(lists[0][1], 9)
        sums, hit = np.zeros(documents), np.zeros(documents, bool)
        for places, weights in lists:
            sums[places] += weights
            hit[places] = True
        at = np.flatnonzero(hit)
        return at, np.round(sums[at], 9)

    return score


def totals(sets: DataFrame, weighted: DataFrame) -> DataFrame:
    """(set_no, n, score, first): how many documents have any of a set's terms, the best score and the smallest document that has it.

    Scores are sums of the weights in `weighted` (term, doc_idx, weight), rounded to 9 places.
    """
    index, score = indexing(), scoring()

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            documents, lists = index(right)
            for no, terms in zip(left["set_no"], left["terms"], strict=True):
                if own := [lists[t] for t in terms if t in lists]:
                    at, scores = score(own, len(documents))
                    top = scores.argmax()
                    found.append((no, len(at), scores[top], documents[at[top]]))
        return pd.DataFrame(found, columns=["set_no", "n", "score", "first"])

    rows = materialise(postings_of(sets, weighted).select("term", "doc_idx", "weight"))
    local = in_blocks(sets, rows, work, "set_no bigint, n bigint, score double, first bigint")
    best = F.max(F.struct("score", (-F.col("first")).alias("f"))).alias("b")
    return local.groupBy("set_no").agg(F.sum("n").alias("n"), best).select("set_no", "n", "b.score", (-F.col("b.f")).alias("first"))


def best(sets: DataFrame, weighted: DataFrame, k: int) -> DataFrame:
    """(set_no, doc_idx, score, rank): the same as `lexical.top_k` of the scores of all documents with any of a set's terms.

    A block leaves out documents below the largest k-th weight of the set's terms, which k documents reach.
    """
    index, score = indexing(), scoring()
    rows = materialise(postings_of(sets, weighted).select("term", "doc_idx", "weight"))
    least = sets.select("set_no", F.explode("terms").alias("term")).join(lexical.bounded(lexical.term_bounds(rows, k)), "term")
    least = least.groupBy("set_no").agg((F.max("kth") - 1e-6).alias("least"))  # far above the rounding of scores
    told = materialise(sets.join(least, "set_no"))

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(left) and len(right):
            documents, lists = index(right)
            for no, terms, least in zip(left["set_no"], left["terms"], left["least"], strict=True):
                if own := [lists[t] for t in terms if t in lists]:
                    at, scores = score(own, len(documents))
                    likely = np.flatnonzero(scores >= least)
                    if len(likely) > k:
                        likely = likely[scores[likely] >= np.partition(scores[likely], len(likely) - k)[len(likely) - k]]
                        likely = likely[np.lexsort((likely, -scores[likely]))[:k]]
                    found.append((np.full(len(likely), no), documents[at[likely]], scores[likely]))
        return pd.DataFrame({n: np.concatenate([f[i] for f in found]) for i, n in enumerate(("set_no", "doc_idx", "score"))})

    return lexical.top_k(in_blocks(told, rows, work, "set_no bigint, doc_idx bigint, score double"), ["set_no"], k)


def counted(sets: DataFrame, postings: DataFrame) -> DataFrame:
    """(set_no, with_any, with_all, postings): documents with any and with all of a set's terms, and these terms' postings."""
    index = indexing()

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            documents, lists = index(right)
            words = -(-len(documents) // 64)

            def bits(places: np.ndarray) -> np.ndarray:
                mark = np.zeros(words * 64, bool)
                mark[places] = True
                return np.packbits(mark).view(np.uint64)

            hot = {t: bits(places) for t, (places, _) in lists.items() if len(places) >= words}  # at most 64 times a document's terms
            for no, terms in zip(left["set_no"], left["terms"], strict=True):
                own = [t for t in terms if t in lists]
                if len(own) == 1:
                    n = len(lists[own[0]][0])
                    found.append((no, n, n * (len(terms) == 1), n))
                elif own:
                    marks = [hot[t] if t in hot else bits(lists[t][0]) for t in own]
                    some, every = marks[0], marks[0]
                    for mark in marks[1:]:
                        some, every = some | mark, every & mark
                    whole = int(np.bitwise_count(every).sum()) if len(own) == len(terms) else 0
                    found.append((no, int(np.bitwise_count(some).sum()), whole, sum(len(lists[t][0]) for t in own)))
        return pd.DataFrame(found, columns=["set_no", "with_any", "with_all", "postings"])

    rows = materialise(postings_of(sets, postings).select("term", "doc_idx", F.lit(0.0).alias("weight")))
    local = in_blocks(sets, rows, work, "set_no bigint, with_any bigint, with_all bigint, postings bigint")
    return local.groupBy("set_no").agg(*[F.sum(c).alias(c) for c in ("with_any", "with_all", "postings")])


def nearest_in_cells(found: DataFrame, asked: DataFrame, stored: DataFrame, maps: tuple[np.ndarray, np.ndarray], keep: int) -> DataFrame:
    """The rows of `found` (set_no, doc_idx, cell, rank) that are among the `keep` nearest of their set and cell, of equals the smallest document.

    `asked` (set_no, x) and `stored` (doc_idx, cell, x) have sparse vectors, x an array of (coordinate, value); `maps` are
    each cell's matrix and shift. Twice the inner product minus the stored vector's squared norm, rounded to 7 places, tells how near.
    """
    matrices, shifts = maps
    width = matrices.shape[2]
    parts = max(1, -(-asked.count() // SETS))  # one number
    part, every = F.pmod(F.hash("set_no"), F.lit(parts)), lambda kind, count: F.explode(F.sequence(F.lit(0).cast(kind), F.lit(count - 1).cast(kind)))
    of_set = asked.select("set_no", F.lit(None).cast("bigint").alias("doc_idx"), "x", part.alias("_part")).withColumn("cell", every("bigint", len(matrices)))
    of_document = stored.withColumn("set_no", F.lit(None).cast("bigint")).select("set_no", "doc_idx", "cell", "x").withColumn("_part", every("int", parts))
    facts = of_set.unionByName(of_document)
    facts = facts.select("set_no", "doc_idx", "cell", "_part", F.col("x.coordinate").alias("coordinates"), F.col("x.value").alias("values"))

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left.iloc[:0][["set_no", "doc_idx", "rank"]]
        matrix, shift = matrices[left["cell"].iloc[0]], shifts[left["cell"].iloc[0]]

        def local(rows: pd.DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
            rows = rows.sort_values(name)
            out = np.empty((len(rows), len(shift)))
            for start in range(0, len(rows), 16_384):
                some = rows.iloc[start : start + 16_384]
                x, sizes = np.zeros((len(some), width)), some["coordinates"].str.len().to_numpy()
                x[np.repeat(np.arange(len(some)), sizes), np.concatenate(some["coordinates"].to_numpy())] = np.concatenate(some["values"].to_numpy())
                out[start : start + len(some)] = x @ matrix.T + shift
            return rows[name].to_numpy().astype(np.int64), out

        asks = right["doc_idx"].isna()
        (sets, q), (documents, y) = local(right[asks], "set_no"), local(right[~asks], "doc_idx")
        norms = np.einsum("ij,ij->i", y, y)
        no, doc = left["set_no"].to_numpy(), left["doc_idx"].to_numpy()
        a, b, score = np.searchsorted(sets, no), np.searchsorted(documents, doc), np.empty(len(left))
        for start in range(0, len(left), 65_536):
            s = slice(start, start + 65_536)
            score[s] = np.round(2 * np.einsum("ij,ij->i", q[a[s]], y[b[s]]) - norms[b[s]], 7)
        order = np.lexsort((doc, -score, no))
        begins = np.flatnonzero(np.r_[True, no[order][1:] != no[order][:-1]])
        place = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
        return left.iloc[order[place < keep]][["set_no", "doc_idx", "rank"]]

    by = found.withColumn("_part", part).groupBy("cell", "_part").cogroup(facts.groupBy("cell", "_part"))
    return by.applyInPandas(work, "set_no bigint, doc_idx bigint, rank bigint")


def in_passes(sets: DataFrame, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`of` over all `sets`, PASS_SETS at once; each pass is written, so what it shuffled needn't lie there with the next one's."""
    spark, passes = sets.sparkSession, max(1, -(-sets.count() // PASS_SETS))  # one number
    out = None
    for i in range(passes):
        done = materialise(of(materialise(sets.filter(F.pmod(F.xxhash64("set_no"), F.lit(passes)) == i))))
        out = done if out is None else out.unionByName(done)
        if passes > 1:
            spark.sparkContext._jvm.System.gc()  # the driver's: shuffle files go with the plans that made them
    return out
