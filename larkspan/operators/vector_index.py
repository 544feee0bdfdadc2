"""The semantic path: residual vectors, spherical cells, probing and exact search.

Tables are (item, x) with x an array<double>. Centroids are a bounded table (cell, x): at most
MOST_CENTROIDS rows, which every task gets as a matrix, so that assigning vectors needs no join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.vector import inverse_norm, minus, scaled
from larkspan.session import materialise

MOST_CENTROIDS, LEAST_CENTROIDS = 65_536, 16
#: Rows that seeds are chosen from, at most; they are collected. The rounds that follow read all rows.
SEED_ROWS = 50_000
#: Rows of probes that are sent to all tasks, at most; more meet the cells' postings in salted parts.
MOST_PROBES = 200_000
#: Bytes of queries that are compared with all vectors in one pass, and queries multiplied with a batch at once.
QUERY_BYTES, QUERY_BLOCK = 64_000_000, 4_096


def normalised(rows: DataFrame, vector: str = "x") -> DataFrame:
    """Vectors at unit length; a zero vector stays zero."""
    # The norm is used once per element: kept apart by a struct, it is computed once per row.
    both = F.array(F.struct(inverse_norm(F.col(vector)).alias("f"), F.col(vector).alias("v")))
    return rows.withColumn(vector, F.transform(both, lambda p: scaled(p["v"], p["f"]))[0])


def mean_vector(rows: DataFrame, vector: str = "x") -> DataFrame:
    """One row: `mean`, the mean of all vectors by position."""
    each = rows.select(F.posexplode(vector).alias("pos", "value")).groupBy("pos").agg(F.avg("value").alias("m"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))


def residuals(rows: DataFrame, vector: str = "x", mean: DataFrame | None = None) -> DataFrame:
    """Vectors minus the mean of all (or the one row of `mean`), at unit length again."""
    centre = mean_vector(rows, vector) if mean is None else mean
    moved = rows.join(F.broadcast(centre)).withColumn(vector, minus(F.col(vector), F.col("mean"))).drop("mean")  # one row
    return normalised(moved, vector)


def matrix_of(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The cells in ascending order and their vectors; more than MOST_CENTROIDS raise an error."""
    rows = centroids.select("cell", "x").limit(MOST_CENTROIDS + 1).collect()  # bounded by the check that follows
    if len(rows) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    rows.sort(key=lambda r: r["cell"])
    return np.array([r["cell"] for r in rows], dtype=np.int64), np.array([r["x"] for r in rows], dtype=np.float64)


def nearest_cells(rows: DataFrame, item: str, centroids: DataFrame, keep: int) -> DataFrame:
    """(item, cell, score, rank): the `keep` cells of highest inner product, of equals the smallest cell.

    A matrix product per Arrow batch; no shuffle. Scores are rounded to 9 places before ranking.
    """
    cells, matrix = matrix_of(centroids)
    told = rows.sparkSession.sparkContext.broadcast((cells, matrix))  # bounded
    kind = dict(rows.dtypes)[item]
    keep = min(keep, len(cells))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, vectors = told.value
        for batch in batches:
            if not len(batch) or not keep:
                continue
            x = np.stack(batch["x"].to_numpy()).astype(np.float64)
            scores = np.round(x @ vectors.T, 9)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
            yield pd.DataFrame({
                "item": np.repeat(batch["item"].to_numpy(), keep), "cell": names[best].ravel(),
                "score": np.take_along_axis(scores, best, 1).ravel(), "rank": np.tile(np.arange(keep), len(batch)),
            })

    given = rows.select(F.col(item).alias("item"), "x").filter("item is not null and x is not null")
    return given.mapInPandas(assign, f"item {kind}, cell bigint, score double, rank bigint").withColumnRenamed("item", item)


def lloyd_step(rows: DataFrame, centroids: DataFrame, item: str = "item", reseed: bool = False) -> DataFrame:
    """New centroids: the mean direction of each cell's vectors; a cell without any keeps its centroid.

    With `reseed` a cell without any instead takes one of the vectors that lie farthest from their
    centroids. Each task adds up its vectors per cell, so sums are shuffled and no vectors.
    """
    cells, matrix = matrix_of(centroids)
    told = rows.sparkSession.sparkContext.broadcast((cells, matrix))  # bounded
    apart = 8 if reseed else 0

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, vectors = told.value
        counts, total, far = np.zeros(len(names), dtype=np.int64), np.zeros_like(vectors), []
        for batch in batches:
            if len(batch) and len(names):
                x = np.stack(batch["x"].to_numpy()).astype(np.float64)
                scores = np.round(x @ vectors.T, 9)
                own = scores.argmax(1)  # of equals the smallest cell
                np.add.at(total, own, x)
                counts += np.bincount(own, minlength=len(names))
                best = scores[np.arange(len(x)), own]
                for i in np.argsort(best, kind="stable")[:apart]:
                    far.append((best[i], batch["item"].iloc[i], x[i]))
        held = np.flatnonzero(counts)
        if len(held):
            yield pd.DataFrame({"cell": names[held], "n": counts[held], "item": None, "score": np.nan, "x": list(total[held])})
        if far:
            far = sorted(far, key=lambda f: (f[0], str(f[1])))[:apart]
            yield pd.DataFrame({"cell": -1, "n": 0, "item": [str(f[1]) for f in far], "score": [f[0] for f in far], "x": [f[2] for f in far]})

    given = rows.select(F.col(item).alias("item"), "x").filter("item is not null and x is not null")
    told_back = given.mapInPandas(sums, "cell bigint, n bigint, item string, score double, x array<double>")
    if reseed:
        told_back = materialise(told_back)  # sums per task and cell, read twice
    each = told_back.filter("n > 0").select("cell", "n", F.posexplode("x").alias("pos", "value")).groupBy("cell", "pos").agg((F.sum("value") / F.sum("n")).alias("m"))
    means = each.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("new"))
    joined = centroids.select(F.col("cell").cast("bigint").alias("cell"), "x").join(means, "cell", "left")
    if reseed:
        # Both numberings are over at most as many rows as there are cells.
        empty = joined.filter("new is null").select("cell", F.row_number().over(Window.orderBy("cell")).alias("no"))
        farthest = told_back.filter("n = 0").orderBy("score", "item").limit(len(cells))
        farthest = farthest.select(F.row_number().over(Window.orderBy("score", "item")).alias("no"), F.col("x").alias("seed"))
        joined = joined.join(empty.join(farthest, "no").select("cell", "seed"), "cell", "left").withColumn("new", F.coalesce("new", "seed"))
    return normalised(joined.select("cell", F.coalesce("new", "x").alias("x")))


def first_centroids(rows: DataFrame, item: str, cells: int) -> DataFrame:
    """The vectors of the `cells` smallest hashes of their items, numbered in that order."""
    chosen = rows.select(F.sha2(F.col(item).cast("string"), 256).alias("h"), "x").orderBy("h").limit(cells)
    order = F.row_number().over(Window.orderBy("h"))  # at most `cells` rows
    return chosen.select((order - 1).cast("bigint").alias("cell"), "x")


def cells_for(count: int) -> int:
    """Cells for so many vectors: their square root, so that cells and their postings grow alike."""
    return int(min(MOST_CENTROIDS, max(LEAST_CENTROIDS, np.ceil(count**0.5))))


def spread_seeds(x: np.ndarray, cells: int, random: np.random.Generator) -> np.ndarray:
    """k-means++ on unit vectors: rows drawn one after another in proportion to their squared distance from those before."""
    chosen = [int(random.integers(len(x)))]
    apart = np.maximum(0.0, 2 - 2 * (x @ x[chosen[0]]))
    # Where many are wanted, some are drawn between updates of the distances.
    step = max(1, cells // 256)
    while len(chosen) < min(cells, len(x)):
        left = np.flatnonzero(apart > 1e-12)
        if not len(left):
            break
        more = random.choice(left, size=min(step, cells - len(chosen), len(left)), replace=False, p=apart[left] / apart[left].sum())
        chosen += more.tolist()
        apart = np.minimum(apart, np.maximum(0.0, 2 - 2 * (x @ x[more].T)).min(1))
    return x[chosen]


def train(rows: DataFrame, item: str, cells: int, rounds: int = 10, starts: int = 3, seed_rows: int = SEED_ROWS) -> DataFrame:
    """Centroids (cell, x) by spherical k-means, the same in every run.

    From at most `seed_rows` vectors, chosen by hash, each of `starts` takes k-means++ seeds and three
    rounds; the start with the highest mean cosine goes on with `rounds` rounds over all rows, in which
    empty cells are seeded anew. Rows must be of unit length. There are fewer cells where there are
    fewer distinct vectors, and none without rows.
    """
    sampled = rows.filter(F.col("x").isNotNull() & F.col(item).isNotNull()).select(F.sha2(F.col(item).cast("string"), 256).alias("h"), "x").orderBy("h").limit(seed_rows)
    x = np.array([r["x"] for r in sampled.collect()], dtype=np.float64)  # at most `seed_rows`
    if not len(x):
        return rows.sparkSession.createDataFrame([], "cell bigint, x array<double>")
    best, kept = -np.inf, None
    for start in range(starts):
        centres = spread_seeds(x, cells, np.random.default_rng(start))
        for _ in range(3):
            own = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
            total = np.zeros_like(centres)
            np.add.at(total, own, x)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            centres = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centres)
        mean = float(np.concatenate([(x[i : i + 4096] @ centres.T).max(1) for i in range(0, len(x), 4096)]).mean())
        if mean > best:
            best, kept = mean, centres
    centroids = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(kept)], "cell bigint, x array<double>")
    for _ in range(rounds):
        centroids = materialise(lloyd_step(rows, centroids, item, reseed=True))
    return centroids


def cell_offsets(assigned: DataFrame, cells: int) -> DataFrame:
    """(cell, size, offset_from, offset_to) for all cells, empty ones too: the layout of the postings."""
    spark = assigned.sparkSession
    sizes = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    every = spark.range(cells).withColumnRenamed("id", "cell").join(sizes, "cell", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    upto = F.sum("size").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))  # one row per cell
    return every.withColumn("offset_to", upto).withColumn("offset_from", F.col("offset_to") - F.col("size"))


def per_cell(asked: DataFrame, stored: DataFrame, item: str, salts: int = 16) -> DataFrame:
    """`stored` joined with the rows of `asked` over `cell`, with no cell meeting in one task.

    Up to MOST_PROBES rows of `asked` go to all tasks; more meet the cell's postings in `salts` parts.
    """
    if asked.limit(MOST_PROBES + 1).count() <= MOST_PROBES:
        return stored.join(F.broadcast(asked), "cell")
    spread = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return stored.withColumn("_salt", F.pmod(F.hash(item), F.lit(salts))).join(spread, ["cell", "_salt"]).drop("_salt")


def candidates(probes: DataFrame, assigned: DataFrame, query: str, item: str) -> DataFrame:
    """(query, cell, item) for the postings of probed cells; an item may come from several cells."""
    return per_cell(probes.select(query, "cell"), assigned.select("cell", item), item).select(query, "cell", item)


def candidate_trace(found: DataFrame, query: str, item: str) -> DataFrame:
    """Per query: entries read, distinct items, the largest posting, and the cells that had any."""
    per_cell = found.groupBy(query, "cell").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_cell.groupBy(query).agg(F.sum("n").alias("entries_read"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("nonempty"))
    unique = found.select(query, item).distinct().groupBy(query).agg(F.count(F.lit(1)).alias("unique_candidates"))
    return sizes.join(unique, query)


def exact_top(queries: DataFrame, rows: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """The `k` items of highest inner product per query, with `rank` from 0; of equals the smallest item.

    Queries are sent to all tasks in sets of at most QUERY_BYTES, one pass over the vectors for each, and
    multiplied with a batch of vectors QUERY_BLOCK at a time. Each pass keeps `k` per query and Arrow batch,
    so what is shuffled grows with the number of batches, not of vectors. Passes are written one by one.
    """
    given_queries = queries.select(F.col(query).alias("q"), "x").filter("q is not null and x is not null")
    size = given_queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()  # one row
    passes = max(1, -(-size["n"] * 8 * (size["d"] or 1) // QUERY_BYTES))
    kinds = dict(queries.dtypes)[query], dict(rows.dtypes)[item]
    marked = given_queries.withColumn("part", F.pmod(F.hash("q"), F.lit(passes)))
    given = rows.select(F.col(item).alias("i"), "x").filter("i is not null and x is not null")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "i")
    found, block = None, QUERY_BLOCK
    for number in range(passes):
        chosen = marked.filter(F.col("part") == number).drop("part").collect()  # about QUERY_BYTES
        told = rows.sparkSession.sparkContext.broadcast(([r["q"] for r in chosen], np.array([r["x"] for r in chosen], dtype=np.float64)))

        def scan(batches: Iterator[pd.DataFrame], told=told) -> Iterator[pd.DataFrame]:
            names, vectors = told.value
            names = np.array(names)
            for batch in batches:
                if not len(batch) or not len(names):
                    continue
                items = batch["i"].to_numpy()
                by_item = np.argsort(items, kind="stable")
                items = items[by_item]
                x = np.stack(batch["x"].to_numpy()).astype(np.float64)[by_item]
                for start in range(0, len(names), block):
                    scores = np.round(vectors[start : start + block] @ x.T, 9)
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    yield pd.DataFrame({"q": np.repeat(names[start : start + block], best.shape[1]), "i": items[best].ravel(), "score": np.take_along_axis(scores, best, 1).ravel()})

        part = given.mapInPandas(scan, f"q {kinds[0]}, i {kinds[1]}, score double")
        part = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        part = part if passes == 1 else materialise(part)
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("q").alias(query), F.col("i").alias(item), "score", (F.col("rank") - 1).cast("bigint").alias("rank"))
