"""Defensive measurements of what keyed views give away."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators.metrics import wilson_interval
from larkspan.session import materialise, small


def balanced_sample(rows: DataFrame, label: str, item: str, most: int, seed: str = "sample") -> DataFrame:
    """At most `most` rows per label, by hash of the item: the feature is the sample."""
    order = Window.partitionBy(label).orderBy(F.sha2(F.concat(F.lit(seed + ":"), F.col(item).cast("string")), 256))
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def one_hot(rows: DataFrame, cell: str, cells: int) -> DataFrame:
    """`features`: a sparse vector with a 1 at the cell."""
    encoder = OneHotEncoder(inputCols=[cell], outputCols=["features"], dropLast=False, handleInvalid="keep")
    frame = rows.sparkSession.range(cells).select(F.col("id").cast("double").alias(cell))
    return encoder.fit(frame).transform(rows.withColumn(cell, F.col(cell).cast("double")))


def block_features(rows: DataFrame, cell: str, y: str, cells: int, width: int) -> DataFrame:
    """`features`: a constant and the coordinates in the block of the row's cell, zeros elsewhere."""
    filled = F.concat(F.array(F.lit(1.0)), F.col(y))
    before = F.array_repeat(F.lit(0.0), (F.col(cell) * (width + 1)).cast("int"))
    after = F.array_repeat(F.lit(0.0), ((cells - 1 - F.col(cell)) * (width + 1)).cast("int"))
    return rows.withColumn("features", array_to_vector(F.concat(before, filled, after)))


def topic_inference(rows: DataFrame, label: str, held_out: str, rounds: int = 100) -> DataFrame:
    """One row: the accuracy of a multinomial logistic model on the held-out rows, with its Wilson interval."""
    model = LogisticRegression(family="multinomial", maxIter=rounds, regParam=0.01, labelCol=label).fit(rows.filter(~F.col(held_out)))
    told = model.transform(rows.filter(F.col(held_out)))
    counts = told.agg(F.sum((F.col("prediction") == F.col(label)).cast("int")).alias("hits"), F.count(F.lit(1)).alias("trials"))
    low, high = wilson_interval(F.col("hits"), F.col("trials"))
    return counts.select("hits", "trials", (F.col("hits") / F.col("trials")).alias("accuracy"), low.alias("low"), high.alias("high"))


def cooccurrence(first: DataFrame, second: DataFrame, query: str, a: str, b: str) -> DataFrame:
    """(a, b, n): in how many queries each pair of aliases appears together; lists are of bounded depth."""
    return first.select(query, a).join(second.select(query, b), query).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def linked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): each alias's most frequent partner, of equals the smallest."""
    order = Window.partitionBy(a).orderBy(F.col("n").desc(), b)
    return pairs.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column for each row of a square cost matrix with the least sum (shortest augmenting paths)."""
    n = len(cost)
    u, v, match, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        slack, used = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=bool)
        while match[j]:
            used[j] = True
            row = match[j]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (reduced < slack[1:])
            slack[1:][better], way[1:][better] = reduced[better], j
            free = np.where(used[1:], np.inf, slack[1:])
            step_to = int(free.argmin()) + 1
            step = free[step_to - 1]
            u[match[used]] += step
            v[used] -= step
            slack[~used] -= step
            j = step_to
        while j:
            match[j] = match[way[j]]
            j = way[j]
    out = np.zeros(n, dtype=int)
    out[match[1:] - 1] = np.arange(n)
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - y[None, :, :]) ** 2).sum(2), 0.0))


def local_alignment(rows: DataFrame, counts: tuple[int, ...], targets: int = 20, seed: str = "anchor") -> DataFrame:
    """(anchors, cell, targets, correct): records recognised from their distances to known anchors of their cell.

    `rows` are (cell, item, x, y); each number of anchors in `counts` is tried on its own. Of each cell the first
    anchors + targets items by hash take part, so that a task gets a bounded number of rows; the measure is that
    sample, and smaller cells are left out.
    """
    order = Window.partitionBy("cell").orderBy(F.sha2(F.concat(F.lit(seed + ":"), F.col("item").cast("string")), 256))
    kept = rows.select("cell", "x", "y", (F.row_number().over(order) - 1).alias("r")).filter(F.col("r") < max(counts) + targets)
    tried = kept.withColumn("anchors", F.explode(F.array(*map(F.lit, counts)))).filter(F.col("r") < F.col("anchors") + targets)

    def align(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("r")
        anchors = int(cell["anchors"].iloc[0])
        x, y = np.stack(cell["x"].to_numpy()), np.stack(cell["y"].to_numpy())
        if len(cell) < anchors + 3:
            return pd.DataFrame({"anchors": [], "cell": [], "targets": [], "correct": []}).astype("int64")
        known = _distances(x[anchors:], x[:anchors])
        seen = _distances(y[anchors:], y[:anchors])
        cost = _distances(known, seen[::-1])  # the observer doesn't know the order
        found = assignment(cost)
        correct = int((found == np.arange(len(found))[::-1]).sum())
        return pd.DataFrame({"anchors": [anchors], "cell": [int(cell["cell"].iloc[0])], "targets": [len(found)], "correct": [correct]})

    return tried.groupBy("anchors", "cell").applyInPandas(align, "anchors bigint, cell bigint, targets bigint, correct bigint")


def global_alignment(rows: DataFrame, counts: tuple[int, ...], targets: int, repeats: int = 10, seed: str = "global") -> DataFrame:
    """(repeat_no, anchors, targets, covered, correct): the same with anchors drawn from all cells.

    A target without an anchor in its cell has no fingerprint; it costs the same everywhere. Each repeat
    draws a bounded sample of its own by hash, which one task solves for each number of anchors.
    """
    most = max(counts)
    each = rows.select("cell", "item", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat_no"))
    key = F.sha2(F.concat_ws(":", F.lit(seed), "repeat_no", F.col("item").cast("string")), 256)
    order = Window.partitionBy("repeat_no").orderBy("h")
    kept = each.withColumn("h", key).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most + targets)

    def align(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        x, y, cell = np.stack(pdf["x"].to_numpy()), np.stack(pdf["y"].to_numpy()), pdf["cell"].to_numpy()
        ids = np.arange(min(most, len(pdf)), len(pdf))[::-1]
        out = []
        for anchors in counts:
            cost, covered = np.zeros((len(ids), len(ids))), 0
            for column, i in enumerate(ids):
                local = np.flatnonzero(cell[: min(anchors, len(pdf))] == cell[i])
                if len(local):
                    covered += 1
                    gap = _distances(x[ids[::-1]], x[local]) - _distances(y[[i]], y[local])
                    cost[:, column] = np.abs(gap).mean(1)
            found = assignment(cost) if len(ids) else np.zeros(0, dtype=int)
            correct = int((ids[found] == ids[::-1]).sum()) if len(ids) else 0
            out.append((int(pdf["repeat_no"].iloc[0]), anchors, len(ids), covered, correct))
        return pd.DataFrame(out, columns=["repeat_no", "anchors", "targets", "covered", "correct"])

    return kept.groupBy("repeat_no").applyInPandas(align, "repeat_no bigint, anchors bigint, targets bigint, covered bigint, correct bigint")


def affine_recovery(known: DataFrame, asked: DataFrame) -> DataFrame:
    """(item, covered, cosine, baseline): vectors recovered from keyed coordinates by a least-squares map per cell.

    `known` and `asked` are (cell, item, x, y). A cell's map is the solution of its normal equations,
    whose sums each task adds up for its own rows, so all known pairs count and no cell is gathered. In
    a cell without any, the guess is the mean of all known vectors; `baseline` is the cosine of that
    mean with the vector. Cells must be few enough for their maps to fit on the driver (see `matrix_of`).
    """
    each = known.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"))
    mean = [r["m"] for r in each.orderBy("pos").collect()]  # one vector

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for cell, rows in batch.groupby("cell"):
                x, y = np.stack(rows["x"].to_numpy()), np.stack(rows["y"].to_numpy())
                y = np.hstack([y, np.ones((len(y), 1))])
                one, other = held.get(cell, (0.0, 0.0))
                held[cell] = one + y.T @ y, other + y.T @ x
        if held:
            yield pd.DataFrame({"cell": list(held), "own": [a.ravel() for a, _ in held.values()], "cross": [b.ravel() for _, b in held.values()]})

    def solve(cell: pd.DataFrame) -> pd.DataFrame:
        own, cross = cell["own"].sum(), cell["cross"].sum()  # element by element, over tasks
        width = int(round(len(own) ** 0.5))
        found, *_ = np.linalg.lstsq(own.reshape(width, width), cross.reshape(width, -1), rcond=1e-12)
        return pd.DataFrame({"cell": [int(cell["cell"].iloc[0])], "map": [found.ravel()]})

    def recover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        middle = np.array(mean)
        for batch in batches:
            for _, rows in batch.groupby("cell"):
                truth, y = np.stack(rows["x"].to_numpy()), np.stack(rows["y"].to_numpy())
                covered = rows["map"].iloc[0] is not None
                plain = np.tile(middle, (len(y), 1)) if len(middle) else np.zeros_like(truth)
                guess = np.hstack([y, np.ones((len(y), 1))]) @ np.asarray(rows["map"].iloc[0]).reshape(y.shape[1] + 1, -1) if covered else plain
                cosine = lambda g, t=truth: (g * t).sum(1) / np.maximum(np.linalg.norm(g, axis=1) * np.linalg.norm(t, axis=1), 1e-12)
                yield pd.DataFrame({"item": rows["item"].to_numpy(), "covered": covered, "cosine": cosine(guess), "baseline": cosine(plain)})

    parts = known.select("cell", "x", "y").mapInPandas(sums, "cell bigint, own array<double>, cross array<double>")
    maps = materialise(parts.groupBy("cell").applyInPandas(solve, "cell bigint, map array<double>"))
    joined = asked.select("cell", "item", "x", "y").join(small(maps), "cell", "left")
    return joined.mapInPandas(recover, "item bigint, covered boolean, cosine double, baseline double")
