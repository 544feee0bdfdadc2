"""Keyed coordinates: rotated vectors, per-cell selections of them, and search within cells.

Keys are derived from SHA-256 in counter mode, so every key bit, choice and normal number can be
recomputed anywhere and doesn't depend on partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.keyed import hash_normal, hash_uniform
from larkspan.functions.vector import dot, fast_hadamard
from larkspan.operators.vector_index import matrix_of, nearest_cells, per_cell
from larkspan.session import materialise, small


def global_key(spark, width: int, name: str) -> DataFrame:
    """(pos, sign1, sign2, source): two sign rows and a permutation of `width` coordinates; one row each."""
    pos = spark.range(width).select(F.col("id").alias("pos"))
    draw = lambda what: hash_uniform(F.lit(f"{name}:{what}"), F.col("pos"))
    order = F.row_number().over(Window.orderBy(draw("order"), "pos"))  # `width` rows
    return pos.select(
        "pos", F.when(draw("sign1") < 0.5, -1.0).otherwise(1.0).alias("sign1"), F.when(draw("sign2") < 0.5, -1.0).otherwise(1.0).alias("sign2"),
        (order - 1).cast("bigint").alias("source"),
    )


def cell_keys(spark, cells: int, width: int, chosen: int, name: str) -> DataFrame:
    """(cell, slot, pos, sign, multiplier, shift): each cell's `chosen` of `width` coordinates, in ascending order."""
    if chosen > width:
        raise ValueError("more coordinates chosen than there are")
    grid = spark.range(cells * width).select((F.col("id") / width).cast("bigint").alias("cell"), (F.col("id") % width).alias("pos"))
    draw = lambda what: hash_uniform(F.lit(f"{name}:{what}"), F.col("cell"), F.col("pos"))
    kept = grid.withColumn("_r", F.row_number().over(Window.partitionBy("cell").orderBy(draw("choice"), "pos"))).filter(F.col("_r") <= chosen)
    slot = F.row_number().over(Window.partitionBy("cell").orderBy("pos")) - 1
    return kept.select(
        "cell", slot.cast("bigint").alias("slot"), "pos", F.when(draw("sign") < 0.5, -1.0).otherwise(1.0).alias("sign"),
        F.lit((width / chosen) ** 0.5).alias("multiplier"), hash_normal(F.lit(f"{name}:shift"), F.col("cell"), F.col("pos")).alias("shift"),
    )


def rotated(x: Column, key: Column, width: int) -> Column:
    """The rotated vector: signs, fast Hadamard transform, and coordinates in the key's order with signs again.

    `key` is a struct of the arrays signs1 (per coordinate), source and sign2 (per output coordinate).
    """
    turned = F.array(fast_hadamard(F.zip_with(x, key["signs1"], lambda v, s: v * s), width))  # once per row
    gather = lambda t: F.zip_with(key["source"], key["sign2"], lambda i, s: F.element_at(t, (i + 1).cast("int")) * s)
    return F.transform(turned, gather)[0]


def local_vectors(rows: DataFrame, item: str, keys: DataFrame, noise: float = 0.0, seed: str = "") -> DataFrame:
    """(item, cell, y): vectors under their cell's key; rows have (item, cell, x) with x already rotated.

    `keys` is folded into one row per cell, which is broadcast if there are few enough. With `noise`, each
    vector is first moved by a vector drawn evenly from the ball of that radius, the same in all its cells.
    """
    folded = keys.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("slot", "pos", "sign", "multiplier", "shift"))).alias("key"))
    if noise > 0:
        moved = rows.select(item, "x").dropDuplicates([item]).select(item, F.zip_with("x", ball_noise(item, F.size("x"), noise, seed), lambda v, e: v + e).alias("x"))
        rows = rows.drop("x").join(materialise(moved), item)
    joined = rows.join(small(materialise(folded)), "cell")

    def local(k):
        return F.element_at(F.col("x"), (k["pos"] + 1).cast("int")) * k["sign"] * k["multiplier"] + k["shift"]

    return joined.select(item, "cell", F.transform("key", local).alias("y"))


def ball_noise(item: str, width: Column, radius: float, seed: str) -> Column:
    """A point drawn evenly from the ball: a normal direction times radius U^(1/width).

    Every coordinate is drawn, so those that a cell selects have exactly the distribution of a part of such a point.
    """
    normal = F.transform(F.sequence(F.lit(0), width - 1), lambda i: hash_normal(F.lit(seed), F.col(item), i))
    length = F.lit(radius) * F.pow(hash_uniform(F.lit(seed + ":length"), F.col(item)), 1 / width)
    both = F.array(F.struct(normal.alias("n")))
    scaled = F.transform(both, lambda b: F.struct(b["n"].alias("n"), (length / F.sqrt(F.aggregate(b["n"], F.lit(0.0), lambda s, v: s + v * v))).alias("f")))
    return F.transform(scaled, lambda b: F.transform(b["n"], lambda v: v * b["f"]))[0]


def noise_radius(scale: float, beta: float, of_query: bool) -> float:
    """The noise of stored vectors is three times that of queries."""
    return (1 if of_query else 3) * scale * beta / 8.0


def search_cells(queries: DataFrame, stored: DataFrame, query: str, item: str, top: int) -> DataFrame:
    """(query, cell, item, score, local_rank): the `top` nearest items per query and cell.

    The score is twice the inner product minus the stored vector's squared norm. The window's limit is
    pushed below the shuffle, so a task sends at most `top` rows per query and cell.
    """
    norms = stored.withColumn("norm2", dot(F.col("y"), F.col("y")))
    pairs = per_cell(queries.select(query, "cell", F.col("y").alias("q")), norms, item)
    scored = pairs.select(query, "cell", item, F.round(2 * dot(F.col("q"), F.col("y")) - F.col("norm2"), 9).alias("score"))
    order = Window.partitionBy(query, "cell").orderBy(F.col("score").desc(), item)
    kept = scored.withColumn("local_rank", F.row_number().over(order)).filter(F.col("local_rank") <= top)
    return kept.withColumn("local_rank", (F.col("local_rank") - 1).cast("bigint"))


def interleaved(found: DataFrame, query: str, item: str) -> DataFrame:
    """Distinct items per query in the order of their best local rank, then cell, then item; `rank` from 0."""
    best = found.groupBy(query, item).agg(F.min(F.struct("local_rank", "cell")).alias("b"))
    order = Window.partitionBy(query).orderBy("b.local_rank", "b.cell", item)
    return best.withColumn("rank", (F.row_number().over(order) - 1).cast("bigint")).select(query, item, "rank")


class CompartmentIndex:
    """Vectors under the keys of their cells, searched within each probed cell.

    `name` stands for the secret: keys, signs and noise follow from it. `width` is the vectors' length,
    `chosen` the coordinates that a cell keeps; `beta` above 0 adds noise to stored vectors and queries.
    """

    def __init__(self, name: str, width: int, chosen: int, scale: float = 1.0, beta: float = 0.0):
        self.name, self.width, self.chosen, self.scale, self.beta = name, width, chosen, scale, beta
        self.stored: DataFrame | None = None

    def _keys(self) -> DataFrame:
        spark = self.centroids.sparkSession
        cells = self.centroids.agg(F.max("cell")).first()[0]  # one number
        return cell_keys(spark, (-1 if cells is None else cells) + 1, self.width, self.chosen, self.name)

    def _local(self, rows: DataFrame, item: str, of_query: bool, seed: str) -> DataFrame:
        local = local_vectors(rows, item, self._keys(), noise_radius(self.scale, self.beta, of_query), f"{self.name}:{seed}")
        return local.withColumn("y", F.transform("y", lambda v: v * self.scale))

    def build(self, rows: DataFrame, item: str, centroids: DataFrame, assignments: int = 2) -> dict[str, int]:
        """Store every row (item, x) in its `assignments` nearest cells; returns the index' dimensions."""
        self.item, self.centroids = item, centroids
        assigned = nearest_cells(rows, item, centroids, assignments).select(item, "cell")
        self.stored = materialise(self._local(rows.select(item, "x").join(assigned, item), item, False, "stored"))
        return {"projection_dimension": self.chosen, "cells": self.centroids.count(), "entries": self.stored.count()}

    def candidates(self, queries: DataFrame, query: str, probes: int, top: int, nonce: int = 0) -> tuple[DataFrame, DataFrame]:
        """(query, item, rank) and a trace (query, entries_read, distances) of queries (query, x).

        Of each probed cell the `top` nearest rows are taken, so a query has at most probes times top
        different candidates, in the order of their places within the cells. `nonce` renews the noise.
        """
        probed = nearest_cells(queries, query, self.centroids, probes).select(query, "cell")
        asked = materialise(self._local(queries.select(query, "x").join(probed, query), query, True, f"asked:{nonce}"))
        found = search_cells(asked, self.stored, query, self.item, top)
        sizes = self.stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        trace = asked.select(query, "cell").join(small(materialise(sizes)), "cell").groupBy(query).agg(F.sum("n").alias("entries_read"), F.sum("n").alias("distances"))
        return interleaved(found, query, self.item), trace

    def primary_view(self, rows: DataFrame, item: str, of_query: bool = False) -> DataFrame:
        """(item, cell, y): each row under the key of its nearest cell, what an observer of that cell sees."""
        own = nearest_cells(rows, item, self.centroids, 1).select(item, "cell")
        return self._local(rows.select(item, "x").join(own, item), item, of_query, "view")


def selected_local(rows: DataFrame, item: str, keys: DataFrame, key: DataFrame, width: int) -> DataFrame:
    """(item, cell, y) of (item, cell, x) with x not rotated: only the cell's chosen coordinates are ever computed.

    A rotated coordinate is one row of the Hadamard matrix between two sign rows, so it needs neither the
    transform nor the other coordinates. Vectors may be shorter than `width`; the rest counts as zeros.
    """
    signs = key.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sign1"))), lambda s: s["sign1"]).alias("signs1"))
    flips = key.select(F.col("pos").alias("source"), F.col("sign2").alias("flip"))
    full = keys.join(key.select("pos", "source"), "pos").join(flips, "source")
    folded = full.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("slot", "source", "flip", "sign", "multiplier", "shift"))).alias("key"))
    joined = rows.join(small(materialise(folded.join(F.broadcast(signs)))), "cell")  # signs are one row, keys one per cell
    joined = joined.withColumn("z", F.zip_with("x", F.slice("signs1", F.lit(1), F.size("x")), lambda v, s: v * s))

    def one(k):
        terms = F.transform("z", lambda v, i: F.when(F.bit_count(k["source"].bitwiseAND(i)) % 2 == 0, v).otherwise(-v))
        value = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) * k["flip"] / float(width) ** 0.5
        return value * k["sign"] * k["multiplier"] + k["shift"]

    return joined.select(item, "cell", F.transform("key", one).alias("y"))


def matrices_of(keys: DataFrame, key: DataFrame, width: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrices, shifts) per cell: `selected_local` of a vector x of `dimensions` numbers is its cell's matrix times x plus its shift.

    Cells are numbered from 0 and keep equally many coordinates; the keys are small and collected.
    """
    columns = sorted(tuple(r) for r in key.select("pos", "sign1", "sign2", "source").collect())  # `width` rows
    sign1, sign2, source = (np.array(c) for c in list(zip(*columns, strict=True))[1:])
    slots = sorted(tuple(r) for r in keys.select("cell", "slot", "pos", "sign", "multiplier", "shift").collect())  # cells x chosen rows
    cell, _, pos, sign, multiplier, shift = (np.array(c) for c in zip(*slots, strict=True))
    chosen = source[pos].astype(np.int64)  # the rows of the Hadamard matrix
    signs = np.where(np.bitwise_count(chosen[:, None] & np.arange(dimensions)[None, :]) % 2 == 0, 1.0, -1.0) * sign1[None, :dimensions]
    matrix = signs * (sign2[chosen] * sign * multiplier)[:, None] / width**0.5
    return matrix.reshape(cell.max() + 1, -1, dimensions), shift.reshape(cell.max() + 1, -1)


def shift_of(keys: DataFrame, key: DataFrame, width: int) -> tuple[np.ndarray, float]:
    """A cell's shift turned back to the vectors' coordinates, and its squared length, for a cell that keeps all `width`.

    There the local vectors Rx + b have an orthogonal R, so twice the inner product of the query's Rp + b with them minus
    their squared norm is |b|^2 - |x|^2 + 2 p(x + g), with the shift g = R'b and the length |b|^2.
    """
    matrices, shifts = matrices_of(keys, key, width, width)
    if matrices.shape != (1, width, width):
        raise ValueError("distances stay the same only where one cell keeps all coordinates")
    return matrices[0].T @ shifts[0], float(shifts[0] @ shifts[0])


def projections(cells: list[int], width: int, chosen: int, name: str, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per cell a random orthogonal projection to `chosen` dimensions, stretched by sqrt(width / chosen), and a translation.

    The cell's generator is seeded by SHA-256 of the name and the cell, so each task can make it anew.
    """
    out = {}
    for cell in cells:
        seed = int.from_bytes(hashlib.sha256(f"{name}:{cell}:{width}:{chosen}".encode()).digest()[:8], "big")
        random = np.random.default_rng(seed)
        turn, _ = np.linalg.qr(random.normal(size=(width, chosen)))
        out[cell] = turn * (width / chosen) ** 0.5, random.normal(0.0, scale, chosen)
    return out


def projected(rows: DataFrame, item: str, means: DataFrame, width: int, chosen: int, name: str, scale: float = 1.0) -> DataFrame:
    """(item, cell, y): vectors minus their cell's mean, under the cell's projection and translation.

    `means` (cell, x) is a bounded table like centroids. Batches are projected cell by cell; nothing is shuffled.
    """
    cells, centres = matrix_of(means)
    told = rows.sparkSession.sparkContext.broadcast({int(c): m for c, m in zip(cells, centres, strict=True)})
    kind = dict(rows.dtypes)[item]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            for cell, part in batch.groupby("cell"):
                if cell not in known:
                    known |= projections([int(cell)], width, chosen, name, scale)
                turn, shift = known[cell]
                y = scale * (np.stack(part["x"].to_numpy()) - told.value[int(cell)]) @ turn + shift
                yield pd.DataFrame({"item": part["item"].to_numpy(), "cell": int(cell), "y": list(y)})

    given = rows.select(F.col(item).alias("item"), "cell", "x")
    return given.mapInPandas(project, f"item {kind}, cell bigint, y array<double>").withColumnRenamed("item", item)
