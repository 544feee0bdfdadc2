import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.operators import compartment, fusion, heavy_keys, leakage, lexical, metrics, vector_index
from larkspan.operators.components import connected_components
from larkspan.operators.numbering import dense_numbers, hash_key, prefix_length


def test_budget_fold(spark):
    rows = [("q", "a", 900), ("q", "b", 10), ("q", "c", 45), ("q", "d", 500), ("one", "big", 900), ("none", "x", 0)]
    known = spark.createDataFrame(rows, "query_id string, term string, df bigint")
    got = {r["query_id"]: (r["terms"], r["spent"]) for r in lexical.terms_under_budget(known, 100, 0.5, 1000).collect()}
    assert got == {"q": (["b", "c"], 55), "one": (["big"], 900)}
    with pytest.raises(ValueError):
        lexical.terms_under_budget(known, 0)


def test_rrf(spark):
    rows = [("q", "s", 10, 0), ("q", "s", 11, 1), ("q", "l", 11, 0), ("q", "l", 12, 1)]
    df = spark.createDataFrame(rows, "query_id string, list string, doc int, pos int")
    got = fusion.fused(df, ["query_id"], "doc", "pos", F.lit(0.5), 10).orderBy("rank").collect()
    assert [r["doc"] for r in got] == [11, 10, 12]
    assert [round(r["score"], 9) for r in got] == [0.016261237, 0.008196721, 0.008064516]


def test_ndcg(spark):
    ranking = spark.createDataFrame([("q", 1, 0), ("q", 2, 1), ("q", 3, 2), ("r", 1, 0)], "query_id string, doc_idx int, rank int")
    judged = spark.createDataFrame([("q", 2, 2), ("q", 3, 1), ("r", 9, 0)], "query_id string, doc_idx int, gain int")
    got = metrics.query_metrics(ranking, judged, ["query_id"]).collect()
    assert len(got) == 1 and abs(got[0]["ndcg10"] - 0.659002) < 1e-6 and got[0]["mrr10"] == 0.5 and got[0]["recall10"] == 1


def test_bootstrap(spark):
    rows = spark.createDataFrame([(0.1,)] * 50 + [(-0.02,)] * 20, "d double")
    a = metrics.paired_bootstrap(rows, "d", 1000).first()
    assert a["resamples"] == 1000 and a["low"] < a["mean_difference"] < a["high"] and a["p_value"] < 0.01
    assert a == metrics.paired_bootstrap(rows.repartition(7), "d", 1000).first()
    assert metrics.paired_bootstrap(rows.limit(0), "d", 10).first()["mean_difference"] is None


@pytest.mark.parametrize("per_bucket", [20_000, 40])
def test_bootstrap_against_numpy(spark, per_bucket):
    """The interval of resampling row by row, whether all values are in one bucket or in many; nulls and NaN are left out."""
    rng = np.random.default_rng(4)
    d = np.concatenate([rng.normal(0.05, 1.0, 300), np.zeros(150)])
    rows = spark.createDataFrame([(float(v),) for v in d] + [(None,), (float("nan"),)], "d double")
    got = metrics.paired_bootstrap(rows, "d", 4000, per_bucket=per_bucket).first()
    means = d[rng.integers(0, len(d), (4000, len(d)))].mean(1)
    low, high = np.percentile(means, [2.5, 97.5])
    spread = means.std()
    assert got["cases"] == 450 and got["resamples"] == 4000 and abs(got["mean_difference"] - d.mean()) < 1e-12
    assert abs(got["low"] - low) < 0.15 * spread and abs(got["high"] - high) < 0.15 * spread
    assert abs(got["p_value"] - (1 + (means <= 0).sum()) / 4001) < 0.04


def test_noise_fills_the_ball(spark):
    """Coordinates of the noise are those of points drawn evenly from the ball, and the same for each cell of an item."""
    rows = spark.range(4000).select(F.col("id").alias("item"), F.array(*[F.lit(0.0)] * 8).alias("x"))
    e = np.array([r[0] for r in rows.select(compartment.ball_noise("item", F.size("x"), 2.0, "s")).collect()])
    length = np.linalg.norm(e, axis=1)
    assert length.max() <= 2.0 + 1e-9
    for q in (0.1, 0.5, 0.9):  # P(length < t) = (t / 2)^8
        assert abs((length < 2.0 * q ** (1 / 8)).mean() - q) < 0.03
    assert np.abs(e.mean(0)).max() < 0.06 and np.abs(np.cov(e.T) / (4 / 10) - np.eye(8)).max() < 0.1  # variance r^2 / (d + 2)
    keys = compartment.cell_keys(spark, 2, 8, 8, "t")
    cells = rows.limit(20).withColumn("cell", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    local = {}
    for r in compartment.local_vectors(cells, "item", keys, 2.0, "s").collect():
        local.setdefault(r["item"], {})[r["cell"]] = np.array(r["y"])
    told = {(r["cell"], r["slot"]): r for r in keys.collect()}
    for of in local.values():
        back = [np.array([(of[c][s] - told[c, s]["shift"]) / told[c, s]["sign"] / told[c, s]["multiplier"] for s in range(8)]) for c in (0, 1)]
        assert np.allclose(back[0], back[1])


def test_fast_hadamard(spark):
    from larkspan.functions.vector import fast_hadamard

    rng = np.random.default_rng(1)
    hadamard_matrix = lambda n: np.array([[(-1.0) ** bin(i & j).count("1") for j in range(n)] for i in range(n)])
    for width in (1, 2, 8, 64):
        x = rng.normal(size=width)
        got = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(fast_hadamard(F.col("x"), width)).first()[0]
        assert np.allclose(got, hadamard_matrix(width) @ x / width**0.5)
    with pytest.raises(ValueError):
        fast_hadamard(F.col("x"), 6)


def test_masked_queries_keep_the_first_list(spark, monkeypatch):
    from larkspan.operators import learning

    monkeypatch.setattr(learning, "learned_ranking", lambda model, rows, features, case, item, depth: rows.select(*case, item, F.lit(1.0).alias("score"), F.lit(0).cast("bigint").alias("rank")))
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 2), ("b", 4, 0), ("c", 7, 3)], "q string, item int, s int")
    mask = F.when(F.col("q") == "b", True).when(F.col("q") == "a", False)  # unknown for c
    got = sorted((r["q"], r["item"], r["rank"], r["score"]) for r in learning.masked_ranking(None, rows, [], ["q"], "item", "s", mask, 1).collect())
    assert got == [("a", 3, 0, None), ("b", 4, 0, 1.0), ("c", 7, 0, None)]


def test_numbering_is_dense_and_stable(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", F.lit("x").alias("extra"))
    df = df.withColumn("g", F.when(F.col("g") == 2, None).otherwise(F.col("g"))).withColumn("h", hash_key(F.col("id"))).withColumn("b", F.substring("h", 1, 1))
    first = dense_numbers(df, ["g"], ["b"], ["h"], "n").select("g", "id", "n").collect()
    again = dense_numbers(df.repartition(13), ["g"], ["b"], ["h"], "n").select("g", "id", "n").collect()
    assert sorted(first, key=str) == sorted(again, key=str)
    per = defaultdict(list)
    for r in first:
        per[r["g"]].append(r["n"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values()) and len(per) == 3
    assert prefix_length(10) == 0 and prefix_length(200_001) == 1


def test_heavy_keys_against_brute_force(spark):
    random.seed(5)
    rows = [("hot" if random.random() < 0.4 else random.choice("abc"), random.choice([None, 1, 2, 2, 5, 9]), "clash") for _ in range(2000)]
    rows += [(None, 1, "clash"), ("lonely", None, "clash")]
    df = spark.createDataFrame(rows, "k string, v int, value string")
    freq = heavy_keys.value_frequencies(df, F.col("k"), F.col("v"))
    totals = {r["key"]: r for r in heavy_keys.key_totals(freq).collect()}
    modes = {r["key"]: (r["mode"], r["mode_rows"]) for r in heavy_keys.key_modes(freq).collect()}
    spread = {r["key"]: r for r in heavy_keys.key_percentiles(freq, {"p50": 0.5, "p90": 0.9}).collect()}
    groups = defaultdict(list)
    for k, v, _ in rows:
        if k is not None:
            groups[k].append(v)
    assert set(totals) == set(groups)
    for k, values in groups.items():
        filled = [v for v in values if v is not None]
        assert (totals[k]["rows"], totals[k]["filled"], totals[k]["distinct_values"]) == (len(values), len(filled), len(set(filled)))
        if filled:
            best = min(Counter(filled).items(), key=lambda x: (-x[1], x[0]))
            assert modes[k] == best
            assert abs(spread[k]["p50"] - np.percentile(filled, 50)) < 1e-9 and abs(spread[k]["p90"] - np.percentile(filled, 90)) < 1e-9
    assert "lonely" not in spread and totals["lonely"]["filled"] == 0
    assert {r["key"] for r in heavy_keys.heavy_keys(heavy_keys.key_totals(freq), "rows", 0.3).collect()} == {"hot"}
    empty = heavy_keys.value_frequencies(df.limit(0), F.col("k"), F.col("v"))
    assert heavy_keys.key_totals(empty).count() == 0 and heavy_keys.key_percentiles(empty, {"p": 0.5}).count() == 0
    assert heavy_keys.heavy_keys(heavy_keys.key_totals(empty), "rows", 0.1).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 101), (200, 200), (100, 105)]
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r["component"]].add(r["id"])
    assert sorted(map(sorted, groups.values())) == [list(range(61)), [100, 101, 105], [200]]


def vectors(spark, n=48, d=16):
    x = np.random.default_rng(7).normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item bigint, x array<double>")


def test_cells_and_compartments(spark):
    x, rows = vectors(spark)
    centroids = vector_index.train(rows, "item", 4, 3)
    again = vector_index.train(rows.repartition(5), "item", 4, 3)
    key = lambda df: sorted((r["cell"], [round(v, 9) for v in r["x"]]) for r in df.collect())
    assert key(centroids) == key(again)
    assigned = vector_index.nearest_cells(rows, "item", centroids, 2)
    assert assigned.count() == 96
    queries = rows.filter("item < 3").withColumnRenamed("item", "query_id")
    everything = vector_index.candidates(vector_index.nearest_cells(queries, "query_id", centroids, 4), assigned, "query_id", "item")
    assert everything.select("query_id", "item").distinct().count() == 3 * 48  # all cells probed: all items
    exact = vector_index.exact_top(queries, rows, "query_id", "item", 5).collect()
    for q in range(3):
        best = np.argsort(-(x @ x[q]), kind="stable")[:5].tolist()
        assert [r["item"] for r in sorted((r for r in exact if r["query_id"] == q), key=lambda r: r["rank"])] == best
    # All coordinates and no noise: keyed distances order items as the vectors do.
    keys = compartment.cell_keys(spark, 4, 16, 16, "t")
    stored = compartment.local_vectors(rows.join(assigned.select("item", "cell"), "item"), "item", keys)
    asked = compartment.local_vectors(queries.join(vector_index.nearest_cells(queries, "query_id", centroids, 2).select("query_id", "cell"), "query_id"), "query_id", keys)
    found = compartment.search_cells(asked, stored, "query_id", "item", 3)
    assert found.count() <= 3 * 2 * 3
    first = {(r["query_id"], r["cell"]): r["item"] for r in found.filter("local_rank = 0").collect()}
    assert all(q == i for (q, _), i in first.items())  # a query's own vector is nearest
    noisy = compartment.local_vectors(rows.join(assigned.select("item", "cell"), "item"), "item", keys, 0.3, "s")
    assert noisy.orderBy("item", "cell").collect() == compartment.local_vectors(rows.repartition(9).join(assigned.select("item", "cell"), "item"), "item", keys, 0.3, "s").orderBy("item", "cell").collect()
    other = compartment.local_vectors(rows.join(assigned.select("item", "cell"), "item"), "item", compartment.cell_keys(spark, 4, 16, 16, "u"))
    assert stored.first()["y"] != other.first()["y"]  # other keys, same cells, other coordinates
    with pytest.raises(ValueError):
        compartment.cell_keys(spark, 2, 4, 5, "t")


def test_assignment():
    rng = np.random.default_rng(3)
    from itertools import permutations

    for _ in range(20):
        cost = rng.random((5, 5))
        best = min(sum(cost[i, p[i]] for i in range(5)) for p in permutations(range(5)))
        got = leakage.assignment(cost)
        assert sorted(got) == list(range(5)) and abs(cost[np.arange(5), got].sum() - best) < 1e-9


def test_affine_recovery(spark):
    x, rows = vectors(spark, 60, 4)
    seen = rows.select(F.lit(0).cast("bigint").alias("cell"), "item", "x", F.transform("x", lambda v: v * 2 + 1).alias("y"))
    told = leakage.affine_recovery(seen.filter("item < 40").repartition(7), seen.filter("item >= 40")).collect()
    assert len(told) == 20 and all(r["covered"] and r["cosine"] > 0.999999 for r in told)
    mean = x[:40].mean(0)
    assert all(abs(r["baseline"] - x[r["item"]] @ mean / np.linalg.norm(x[r["item"]]) / np.linalg.norm(mean)) < 1e-9 for r in told)
    lost = leakage.affine_recovery(seen.filter("item < 40"), seen.filter("item >= 40").withColumn("cell", F.lit(1).cast("bigint"))).collect()
    assert len(lost) == 20 and not any(r["covered"] for r in lost)


def test_selected_coordinates_equal_the_rotation(spark):
    from larkspan.plans import vectors as plans

    _, rows = vectors(spark, 20, 64)
    rows = rows.withColumn("cell", F.col("item") % 3)
    keys = compartment.cell_keys(spark, 3, 64, 10, "k")
    whole = compartment.local_vectors(plans.rotate(rows, spark), "item", keys)
    some = compartment.selected_local(rows, "item", keys, compartment.global_key(spark, 64, plans.KEY), 64)
    key = lambda df: {(r["item"], r["cell"]): r["y"] for r in df.collect()}
    a, b = key(whole), key(some)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_projection_keeps_distances(spark):
    x, rows = vectors(spark, 30, 16)
    rows = rows.withColumn("cell", F.lit(0).cast("bigint"))
    means = spark.createDataFrame([(0, [0.0] * 16)], "cell bigint, x array<double>")
    y = {r["item"]: np.array(r["y"]) for r in compartment.projected(rows, "item", means, 16, 16, "p").collect()}
    assert all(abs(np.linalg.norm(y[i] - y[j]) - np.linalg.norm(x[i] - x[j])) < 1e-9 for i in range(5) for j in range(5))


def test_encoder_hook(spark):
    from larkspan.sources.encoder import encoded

    rows = spark.createDataFrame([(1, "ab"), (2, None)], "item int, text string")
    got = {r["item"]: r["x"] for r in encoded(rows, "item", "text", lambda: lambda ts: np.array([[3.0 * len(t), 4.0 * len(t)] for t in ts])).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0]}
