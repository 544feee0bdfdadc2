"""The index under cell keys as a whole: bounded unions without repeats, determinism, and views that differ by key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.operators import vector_index
from larkspan.operators.compartment import CompartmentIndex


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(7).normal(size=(48, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item bigint, x array<double>")
    return x, rows, vector_index.train(rows, "item", 4, 3)


def test_routing_is_deterministic(spark, data):
    _, rows, trained = data
    again = vector_index.train(rows.repartition(5), "item", 4, 3)
    cells = lambda t: sorted(map(tuple, vector_index.nearest_cells(rows, "item", t, 2).select("item", "cell").collect()))
    assert cells(trained) == cells(again)


@pytest.mark.parametrize("beta", [0.0, 0.1])
def test_union_is_bounded_and_unique(data, beta):
    _, rows, trained = data
    index = CompartmentIndex("one", 16, 6, scale=3.0, beta=beta)
    assert index.build(rows, "item", trained) == {"projection_dimension": 6, "cells": 4, "entries": 96}
    asked = rows.filter("item < 5").withColumnRenamed("item", "query_id")
    found, trace = index.candidates(asked, "query_id", 2, 3)
    per = {}
    for r in found.collect():
        per.setdefault(r["query_id"], []).append((r["rank"], r["item"]))
    assert len(per) == 5
    for got in per.values():
        assert len(got) <= 6 and len({i for _, i in got}) == len(got) and sorted(r for r, _ in got) == list(range(len(got)))
    assert all(r["entries_read"] == r["distances"] >= 6 for r in trace.collect())
    same, _ = index.candidates(asked.repartition(3), "query_id", 2, 3)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, found.collect()))


def test_whole_cells_without_noise_find_the_nearest(data):
    """With all cells, all coordinates and no cut the order is that of exact distances, whatever the key."""
    x, rows, trained = data
    index = CompartmentIndex("two", 16, 16)
    index.build(rows, "item", trained, 1)
    found, _ = index.candidates(rows.filter("item = 3").withColumnRenamed("item", "query_id"), "query_id", 4, 1)
    cell = {r["item"]: r["cell"] for r in vector_index.nearest_cells(rows, "item", trained, 1).collect()}
    best = {c: max((i for i in cell if cell[i] == c), key=lambda i: x[3] @ x[i]) for c in set(cell.values())}
    assert {r["item"] for r in found.collect()} == set(best.values())


def test_keys_change_what_is_seen(data):
    _, rows, trained = data
    views = []
    for name in ("path one", "path two", "path one"):
        index = CompartmentIndex(name, 16, 6, scale=3.0)
        index.build(rows, "item", trained, 1)
        views.append({r["item"]: (r["cell"], r["y"]) for r in index.primary_view(rows, "item").collect()})
    assert {i: c for i, (c, _) in views[0].items()} == {i: c for i, (c, _) in views[1].items()}
    assert not any(np.allclose(views[0][i][1], views[1][i][1]) for i in views[0])
    assert views[0] == views[2]


def test_blake_partitions(spark):
    import hashlib

    from larkspan.functions.keyed import blake_partition

    got = {r["n"]: r["p"] for r in spark.createDataFrame([(0,), (7,), (2**40,), (None,), (-1,)], "n bigint").select("n", blake_partition(F.col("n"), b"key", 16).alias("p")).collect()}
    want = lambda n: int.from_bytes(hashlib.blake2b(n.to_bytes(8, "big"), key=b"key", digest_size=8).digest(), "big") % 16
    assert got == {0: want(0), 7: want(7), 2**40: want(2**40), None: None, -1: None}
