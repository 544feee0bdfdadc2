"""The approximate searches find at least 0.9 of what brute force finds, in NumPy and apart from the SQL twins."""

import duckdb
import numpy as np
import pytest

from larkspan.plans import vectors

FOLDERS = ("/root/testdata/sf0.01", "/root/testdata/sf0.1")


def brute_force(folder):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    x = unit(unit(x) - unit(x).mean(0))
    asked = np.flatnonzero(ids % 100 == 0)
    scores = np.round(x[asked] @ x.T, 9)
    return {int(ids[q]): set(ids[np.lexsort((ids, -s))[:10]].tolist()) for q, s in zip(asked, scores, strict=True)}


def recall(rows, folder):
    best, found = brute_force(folder), {}
    for r in rows:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    return sum(len(b & found.get(q, set())) for q, b in best.items()) / sum(map(len, best.values()))


@pytest.mark.parametrize("folder", FOLDERS)
def test_probed_cells(spark, folder):
    assert recall(vectors.ivf_exact(spark, folder).collect(), folder) >= 0.9
    told = [r["recall"] for r in vectors.ivf_recall(spark, folder).collect()]
    assert sum(told) / len(told) >= 0.9


@pytest.mark.parametrize("folder", FOLDERS)
def test_global_key_with_noise(spark, folder):
    assert recall(vectors.global_rerank(spark, folder).collect(), folder) >= 0.9


@pytest.mark.parametrize("folder", FOLDERS)
def test_local_bests(spark, folder):
    assert recall(vectors.compartment_ranking(spark, folder).collect(), folder) >= 0.9
    told = vectors.projected_ranking(spark, folder).collect()
    assert sum(r["hits"] for r in told) / sum(r["wanted"] for r in told) >= 0.9
