"""The operators on training data against brute force and on hard inputs."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from larkspan.llm import distinctive, grouping, mixing, packing, queries, rank_merge, sampling, subjects

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle.connection(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    assert oracle.compare(queries.QUERIES[name](spark, FOLDER), duck, queries.SQL[name]) == ""


# 1. grouping


def bundles(seed=1, d=64):
    """Groups of 2 to 40 vectors around far directions, a loose chain, and lone vectors."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v)
    rows, truth = [], {}
    for g, size in enumerate([2, 3, 5, 10, 40]):
        centre = unit(rng.normal(size=d))
        for i in range(size):
            v = unit(centre + 0.2 * unit(rng.normal(size=d)))
            rows.append((f"g{g}-{i:02}", (v * rng.uniform(0.1, 50)).tolist()))
            truth[f"g{g}-{i:02}"] = f"g{g}-00"
    a, b = unit(rng.normal(size=d)), unit(rng.normal(size=d))
    b = unit(b - (a @ b) * a)
    for i, turn in enumerate(np.arange(0, 1.6, 0.4)):  # neighbours have a cosine of 0.92, others less than 0.8
        rows.append((f"chain{i}", (np.cos(turn) * a + np.sin(turn) * b).tolist()))
    rows += [(f"lone{i}", rng.normal(size=d).tolist()) for i in range(60)]
    return rows, truth


def test_groups(spark):
    rows, truth = bundles()
    dirt = [rows[0], ("g0-00", None), ("zero", [0.0] * 64), ("null", None), ("short", [1.0]), (None, rows[1][1]), ("nan", [float("nan")] * 64)]
    df = spark.createDataFrame([(m, v, "x", 7) for m, v in rows + dirt], "m string, v array<double>, id string, component int")
    found = grouping.group_vectors(df, F.col("m"), F.col("v"), 64)
    assert found.members.count() == len(rows)
    sure = grouping.tight_groups(found, 0.85, 0.80)
    names = found.groups.join(sure, "group").join(found.members.select("id", "member"), "id").select("group", "member").collect()
    groups = defaultdict(set)
    for r in names:
        groups[r["group"]].add(r["member"])
    got = {m: min(g) for g in groups.values() for m in g}
    assert got == truth  # the chain's groups touch each other, so none of them is beyond doubt
    again = grouping.group_vectors(df.repartition(7), F.col("m"), F.col("v"), 64)
    key = lambda f: sorted(map(tuple, f.groups.select("id", "group").collect()))
    assert key(found) == key(again)
    chain = found.groups.join(found.members.select("id", "member"), "id").filter("member like 'chain%'").collect()
    assert len(chain) == 4 and len({r["group"] for r in chain}) > 1 and all(r["cosine"] >= 0.8 or r["id"] == r["group"] for r in chain)


def test_groups_salted_and_empty(spark, monkeypatch):
    rows, truth = bundles(2)
    df = spark.createDataFrame(rows, "m string, v array<double>")
    for name, value in (("BUCKET", 20), ("HOT", 8), ("BLOCK", 8)):
        monkeypatch.setattr(grouping, name, value)
    found = grouping.group_vectors(df, F.col("m"), F.col("v"), 64)
    sure = grouping.tight_groups(found, 0.85, 0.80)
    assert found.groups.join(sure, "group").count() == len(truth)
    empty = grouping.group_vectors(df.limit(0), F.col("m"), F.col("v"), 64)
    assert empty.groups.count() == 0 and grouping.tight_groups(empty, 0.85, 0.8).count() == 0


def hot_region(loose=6000, pairs=150, d=64):
    """Loose rows with a cosine of about 0.5 with each other, and isolated pairs of cosine 0.92 among them."""
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centre = unit(rng.normal(size=d))
    own = lambda n: unit(unit(rng.normal(size=(n, d))) + centre)
    near = own(pairs)
    side = rng.normal(size=(pairs, d))
    side = unit(side - (side * near).sum(1, keepdims=True) * near)
    rows = [(f"p{i}a", v.tolist()) for i, v in enumerate(near)] + [(f"p{i}b", v.tolist()) for i, v in enumerate(0.92 * near + (1 - 0.92**2) ** 0.5 * side)]
    return rows + [(f"loose{i}", v.tolist()) for i, v in enumerate(own(loose))]


@pytest.mark.parametrize("block", [4096, 50])
def test_pairs_behind_an_unrelated_head(spark, monkeypatch, block):
    monkeypatch.setattr(grouping, "BLOCK", block)
    rows = hot_region()
    found = grouping.group_vectors(spark.createDataFrame(rows, "m string, v array<double>"), F.col("m"), F.col("v"), 64)
    name = {r["id"]: r["member"] for r in found.members.select("id", "member").collect()}
    links = {frozenset((name[r["a"]], name[r["b"]])) for r in found.links.collect()}
    linked = sum(frozenset((f"p{i}a", f"p{i}b")) in links for i in range(150))
    assert linked >= 146  # 0.97; the rest share no bucket


def test_buckets_in_parts(spark, monkeypatch):
    """Candidates of the streaming pass, over small batches, against each bucket taken alone."""
    rng = np.random.default_rng(9)
    sizes = [1, 2, 3, 70, 400, 1, 900, 5, 60, 2500, 1, 130]
    rows, members, calm, i = [], defaultdict(list), defaultdict(list), 0
    for bucket, n in zip(rng.integers(-(2**62), 2**62, len(sizes)), sizes, strict=True):
        centre = rng.integers(0, 2, 128)
        for k in range(n):
            noise = rng.choice([0.05, 0.1, 0.4])
            calm[int(bucket)] += [k] if noise < 0.1 else []
            bits = centre ^ (rng.random(128) < noise)
            sketch = np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()
            rows.append((i, sketch, [int(bucket)]))
            members[int(bucket)].append((i, bits))
            i += 1
    random.Random(1).shuffle(rows)
    monkeypatch.setattr(grouping, "BUCKET", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = grouping.bucket_candidates(spark.createDataFrame(rows, "id bigint, sketch array<bigint>, bands array<bigint>")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    links, alone = defaultdict(set), defaultdict(set)
    bits = {j: b for own in members.values() for j, b in own}
    of = {j: k for k, own in members.items() for j, _ in own}
    for r in got:
        if r["a"] is None:
            alone[r["bucket"]].add(r["b"])
        else:
            assert r["a"] < r["b"] and of[r["a"]] == of[r["b"]] and (bits[r["a"]] != bits[r["b"]]).sum() <= grouping.NEAR_BITS
            links[of[r["a"]]].add((r["a"], r["b"]))
    for bucket, own in members.items():
        first = own[0][0]
        if len(own) > 1000:
            near = {j for j, b in own[1:] if (b != bits[first]).sum() <= grouping.NEAR_BITS}
            assert links[bucket] == {(first, j) for j in near} and alone[bucket] == {j for j, _ in own[1:]} - near
            continue
        # One link at most for each but the first, and members that are all near each other hang together.
        assert not alone[bucket] and len(links[bucket]) < len(own)
        root = {j: j for j, _ in own}
        def find(j):
            while root[j] != j:
                j = root[j]
            return j
        for a, b in links[bucket]:
            root[find(a)] = find(b)
        apart = np.array([b for _, b in own])
        apart = (apart[:, None] != apart[None]).sum(2)
        core = [k for k in range(len(own)) if (apart[k][calm[bucket]] <= grouping.NEAR_BITS).all() and k in calm[bucket]]
        assert len({find(own[k][0]) for k in core}) <= 1


def test_exact_check_of_wide_groups(spark, monkeypatch):
    """Groups whose members lie at all angles to the medoid, against all pairs; also in several blocks."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    members, groups, truth = [], [], set()
    for g in range(40):
        n = int(rng.choice([1, 2, 3, 30, 70, 150]))
        centre = unit(rng.normal(size=8))
        x = unit(centre + rng.choice([0.1, 0.2, 0.25, 0.3]) * unit(rng.normal(size=(n, 8)))).astype(np.float32)
        x[0] = centre
        for v in x:
            members.append((len(members), f"m{len(members)}", v.tolist()))
            groups.append((len(members) - 1, g, float(v.astype(float) @ x[0].astype(float))))
        if n > 1 and (x.astype(float) @ x.astype(float).T).min() >= 0.85 - 1e-7:
            truth.add(g)
    assert 5 < len(truth) < 35
    frame = grouping.Grouping(
        spark.createDataFrame(members, "id bigint, member string, vec array<float>"), spark.createDataFrame(groups, "id bigint, group bigint, cosine double"),
        spark.createDataFrame([], "a bigint, b bigint"),
    )
    for block in (4096, 20):
        monkeypatch.setattr(grouping, "BLOCK", block)
        assert {r["group"] for r in grouping.tight_groups(frame, 0.85, 0.80).collect()} == truth


def test_many_medoids_at_once(spark):
    """A long loose chain of small dense groups is split in few rounds, each group around a member of high degree."""
    n, per = 60, 5
    rng = np.random.default_rng(3)
    # Each group has its own pair of axes, one of them shared with the next group.
    vecs = np.zeros((n * per, n + 1))
    for i in range(n * per):
        g = i // per
        angle = 0.25 + rng.uniform(-0.02, 0.02)
        vecs[i, g], vecs[i, g + 1] = np.cos(angle), np.sin(angle)
    cos = vecs @ vecs.T
    links = [(a, b) for a in range(n * per) for b in range(a + 1, n * per) if cos[a, b] >= 0.9 or (a % per == per - 1 and b == a + 1)]
    degree = Counter(i for link in links for i in link)
    members = spark.createDataFrame([(i, 0, degree[i], v.astype(np.float32).tolist()) for i, v in enumerate(vecs)], "id bigint, component bigint, degree bigint, vec array<float>")
    rounds = []
    original = grouping.around_local_medoids
    grouping.around_local_medoids = lambda *a: (rounds.append(1), original(*a))[1]
    try:
        placed = grouping.around_medoids(members, spark.createDataFrame(links, "a bigint, b bigint")).collect()
    finally:
        grouping.around_local_medoids = original
    assert len(placed) == n * per and len(rounds) <= 6
    assert all(r["cosine"] >= grouping.LEAST_COSINE and r["id"] // per == r["group"] // per for r in placed)
    assert len({r["group"] for r in placed}) == n and all(degree[r["group"]] == max(degree[i] for i in range(r["group"] // per * per, r["group"] // per * per + per)) for r in placed)


def test_medoid_is_central(spark):
    """The medoid of a group is one of its central members, not the one with the smallest id."""
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    rows, central = [], 0
    for g in range(20):
        centre, out = unit(rng.normal(size=64)), unit(rng.normal(size=(60, 64)))
        spread = np.r_[np.full(20, 0.15), np.full(40, 0.55)]
        rows += [(f"{g:02}-{i:02}", v.tolist()) for i, v in enumerate(unit(centre + spread[:, None] * out))]
    found = grouping.group_vectors(spark.createDataFrame(rows, "m string, v array<double>"), F.col("m"), F.col("v"), 64)
    placed = found.groups.join(found.members.select("id", "member"), "id").select("group", "id", "member").collect()
    name = {r["id"]: r["member"] for r in placed}
    largest = Counter(r["group"] for r in placed).most_common(20)
    smallest = {g: min(r["id"] for r in placed if r["group"] == g) for g, _ in largest}
    central = sum(int(name[g][3:]) < 20 for g, _ in largest)
    assert all(size >= 30 for _, size in largest) and central >= 16 and sum(smallest[g] == g for g, _ in largest) <= 4


def test_links_do_not_depend_on_size(spark, monkeypatch):
    """Pairs at a cosine of 0.85 are linked or not whatever number of other members there is."""
    rng = np.random.default_rng(21)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x, side = unit(rng.normal(size=(300, 64))), rng.normal(size=(300, 64))
    y = 0.855 * x + (1 - 0.855**2) ** 0.5 * unit(side - (side * x).sum(1, keepdims=True) * x)
    rows = [(f"{i}{s}", v.tolist()) for i in range(300) for s, v in (("a", x[i]), ("b", y[i]))]
    lone = [(f"lone{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(600, 64)))]
    monkeypatch.setattr(grouping, "UNRELATED", 1_000)  # more members had bands of more hashes

    def linked(rows):
        found = grouping.group_vectors(spark.createDataFrame(rows, "m string, v array<double>"), F.col("m"), F.col("v"), 64)
        name = {r["id"]: r["member"] for r in found.members.select("id", "member").collect()}
        return {frozenset((name[r["a"]], name[r["b"]])) for r in found.links.collect()}

    alone = linked(rows)
    assert len(alone) >= 0.9 * 300 and linked(rows + lone) == alone


@pytest.mark.parametrize("block", [4096, 3])
def test_open_members_of_a_large_bucket(spark, monkeypatch, block):
    """A member far from a large bucket's first is compared with those near the first, too, and these not with each other."""
    monkeypatch.setattr(grouping, "BUCKET", 10)
    monkeypatch.setattr(grouping, "BLOCK", block)
    rng = np.random.default_rng(22)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    first, side = np.eye(64)[0], np.eye(64)[1]
    near = np.array([np.cos(0.6) * first + np.sin(0.6) * u for u in np.vstack([side, unit(rng.normal(size=(18, 62))) @ np.eye(64)[2:]])])
    vectors = np.vstack([first, near, np.cos(1.05) * first + np.sin(1.05) * side])
    close = set(np.flatnonzero(vectors[:20] @ vectors[20] >= 0.8).tolist())
    assert 1 in close and 0 not in close
    numbered = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, vec array<float>")
    signed = numbered.select("id", F.array(F.lit(7).cast("bigint")).alias("bands"))
    tried = spark.createDataFrame([(0, i) for i in range(1, 20)], "a bigint, b bigint")
    leftover = spark.createDataFrame([(7, 20)], "bucket bigint, id bigint")
    links = {tuple(r) for r in grouping.remaining_links(grouping.open_members(tried, tried, leftover, signed), numbered).collect()}
    assert (1, 20) in links and links <= {(j, 20) for j in close}


def test_more_bands_for_more_members():
    shapes = [grouping.band_shape(n) for n in (0, 1000, 250_000, 250_001, 25_000_000, 10**9)]
    assert shapes[:3] == [(64, 2)] * 3 and [r for _, r in shapes[3:]] == [3, 3, 4] and shapes[3][0] == 275


# 2. sampling


def test_sample_grows_and_stays(spark):
    rows = [(f"id{i}", i % 10) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, batch int")
    take = lambda part, **k: {r["key"] for r in sampling.stable_sample(sampling.sequence_numbers(part, F.col("key"), F.col("batch"), **k), 0.2).collect()}
    before = set()
    for upto in range(10):
        now = take(df.filter(F.col("batch") <= upto))
        assert before <= now and abs(len(now) - 0.2 * 300 * (upto + 1)) <= 4
        before = now
    assert take(df.unionAll(df.filter("batch = 3").withColumn("batch", F.lit(8))).repartition(11)) == before
    assert take(df, per_bucket=20) == before
    smaller = {r["key"] for r in sampling.stable_sample(sampling.sequence_numbers(df, F.col("key"), F.col("batch")), 0.1).collect()}
    assert smaller <= before
    with pytest.raises(ValueError):
        sampling.stable_sample(df, 1.5)


def test_sample_registry_and_dirt(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", None, "x"), (None, 1, "x"), ("b", None, "x"), ("c", 5, "x")], "key string, batch int, first_batch string")
    kept = sampling.sequence_numbers(df, F.col("key"), F.col("batch"))
    assert sorted(map(tuple, kept.collect())) == [("a", 0, 0), ("b", None, 2), ("c", 5, 1)]
    more = df.unionAll(spark.createDataFrame([("d", 0, "x")], df.schema))
    later = {r["key"]: r["sequence_no"] for r in sampling.sequence_numbers(more, F.col("key"), F.col("batch"), known=kept).collect()}
    assert later == {"a": 0, "c": 1, "b": 2, "d": 3}
    assert sampling.sequence_numbers(df.limit(0), F.col("key"), F.col("batch")).count() == 0


def test_late_keys_move_nothing(spark, tmp_path):
    take = lambda df, path, **k: {r["key"] for r in sampling.stable_sample(sampling.persistent_numbers(df, F.col("key"), F.col("batch"), path, **k), 0.2).collect()}
    frame = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "key string, batch int, sequence_no string")
    rows, before, path = [(f"a{i}", 0) for i in range(500)] + [(f"n{i}", None) for i in range(500)], set(), str(tmp_path / "numbers")
    grown = [[], [(f"b{i}", 1) for i in range(333)], [(f"late{i}", 0) for i in range(50)], [(f"m{i}", None) for i in range(70)], [("n3", 0), ("n4", 2), ("a7", None), (None, 3)], []]
    for more in grown:
        rows = rows + more
        now = take(frame(rows), path)
        assert before <= now and abs(len(now) - 0.2 * len({k for k, _ in rows if k})) <= 4
        before = now
    assert take(frame(rows).repartition(11), path, per_bucket=20) == before
    assert take(frame(rows[:500]), path) == {k for k in before if k.startswith("a")}  # numbers of keys that aren't there have no row
    (tmp_path / "numbers" / "part-00000099").mkdir()  # a part that was never finished
    assert before <= take(frame([*rows, ("z", 0)]), path)
    assert take(frame(rows).limit(0), str(tmp_path / "none")) == set()


def test_sample_query_keeps_its_numbers(spark, tmp_path):
    import shutil

    folder, numbers = str(tmp_path / "in"), str(tmp_path / "numbers")
    os.mkdir(folder)
    whole = spark.read.parquet(f"{FOLDER}/queries.parquet")
    late = whole.filter("batch_no = 2").limit(5).select("_id")
    take = lambda df: (shutil.rmtree(f"{folder}/queries.parquet", ignore_errors=True), df.write.parquet(f"{folder}/queries.parquet"), {r[0] for r in queries.p2_sample(spark, folder, numbers).select("query_id").collect()})[2]
    first = take(whole.filter("batch_no <= 5").join(late, "_id", "left_anti"))
    assert first and first <= take(whole)


# 4. merging


def test_beta_probability(spark):
    def quad(x, a, b, n=200_000):
        from math import lgamma

        u = (np.arange(n) + 0.5) / n * x ** a  # substitution t = u^(1/a) tames the pole at 0
        f = (1 - u ** (1 / a)) ** (b - 1) / a
        return f.mean() * x ** a * np.exp(lgamma(a + b) - lgamma(a) - lgamma(b))

    for a in (0.4, 0.8, 1.0, 1.2, 1.6):
        b = 3 - a
        for x in (0.01, 0.3, 0.5, 0.7, 0.99):
            a_, b_ = F.lit(a), F.lit(b)
            got = spark.range(1).select(rank_merge.beta_probability(F.lit(x), a_, b_, rank_merge.beta_coefficients(a_, b_), rank_merge.beta_coefficients(b_, a_))).first()[0]
            assert abs(got - quad(x, a, b)) < 1e-4


def test_ln_gamma(spark):
    from math import lgamma

    for r in spark.createDataFrame([(z,) for z in (1e-9, 0.01, 0.5, 1.0, 2.0, 3.7, 13.0)], "z double").select("z", rank_merge.ln_gamma(F.col("z")).alias("g")).collect():
        assert abs(r["g"] - lgamma(r["z"])) < 1e-11


def test_merge_of_three_lists(spark):
    """Against the definition, item by item: weighted, with a list of no weight, and equal lists."""
    from math import comb

    random.seed(8)
    rows = [("q", name, i, float(s)) for name, n in (("a", 9), ("b", 7), ("c", 8), ("d", 5)) for s, i in enumerate(random.sample(range(12), n))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "q string, which string, item int, score double, ds string")
    ranks = rank_merge.list_ranks(df, ["q", "ds"], "which", "item", "score")
    told = {(r["which"], r["item"]): r["list_rank"] for r in ranks.collect()}
    schema = "ds string, which string, weight double"

    def definition(lists):
        items = {i for w, i in told if w in "abcd"}
        out = {}
        for i in items:
            xs, n = sorted(told[w, i] / len(items) if (w, i) in told else 1.0 for w in lists), len(lists)
            tail = lambda k, x: sum(comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(k, n + 1))
            out[i] = min(1.0, n * min(tail(k + 1, x) for k, x in enumerate(xs)))
        return out

    def merged(weights, lists=("a", "b", "c", "d")):
        got = rank_merge.robust_aggregation(ranks, spark.createDataFrame(weights, schema), ["q", "ds"], "which", "item", lists, ["ds"])
        return {r["item"]: r["significance"] for r in got.collect()}

    def same(x, y):
        return x.keys() == y.keys() and all(abs(x[i] - y[i]) < 1e-9 for i in x)

    assert same(merged([]), definition("abcd")) and same(merged([("x", w, 3.0) for w in "abcd"]), definition("abcd"))
    assert same(merged([("x", "a", 0.5), ("x", "b", 0.5), ("x", "c", float("nan")), ("x", "d", -1.0), ("x", "a", 0.1), ("y", "a", 0.0)]), merged([("x", "a", 0.5), ("x", "b", 0.5), ("x", "c", None), ("x", "d", 0.0)]))
    assert same(merged([("x", "a", 0.5), ("x", "b", 0.5), ("x", "c", None), ("x", "d", 0.0)]), merged([("x", "a", 0.5), ("x", "b", 0.5), ("x", "c", 1 / 3), ("x", "d", 0.0)]))
    assert same(merged([("x", "a", 0.5), ("x", "b", 0.5), ("x", "c", 0.5), ("x", "d", 0.0)]), definition("abc"))
    assert same(merged([("x", "a", 1.0), ("x", "b", 0.0), ("x", "c", 0.0), ("x", "d", 0.0)]), definition("a"))
    heavy = merged([("x", "a", 10.0), ("x", "b", 1.0), ("x", "c", 1.0), ("x", "d", 1.0)])
    assert min(heavy, key=heavy.get) in {i for (w, i), r in told.items() if w == "a" and r <= 3}
    with pytest.raises(ValueError):
        merged([], tuple("abcdefghijklm"))


def test_merge(spark):
    rows = [("q", "s", i, 1000.0 - i) for i in range(20)] + [("q", "l", 100 + i, 0.9 - i / 100) for i in range(20)] + [("q", "l", 2, 0.895), ("q", "l", 2, 0.1)]
    rows += [("one", "s", 5, None), ("one", "s", 6, float("nan")), ("one", "s", 7, -3.0), ("one", "s", None, 1.0), ("tie", "s", 2, 1.0), ("tie", "s", 1, 1.0), ("tie", "l", 2, 1.0), ("tie", "l", 1, 1.0)]
    df = spark.createDataFrame([(*r, "d", 3) for r in rows], "q string, which string, item int, score double, ds string, list_rank int")
    ranks = rank_merge.list_ranks(df, ["q", "ds"], "which", "item", "score")
    weighted = lambda w: spark.createDataFrame([("d", "s", w), ("d", "l", 1 - w), ("other", "s", 0.0)], "ds string, which string, weight double")
    merge = lambda weights: rank_merge.robust_aggregation(ranks, weights, ["q", "ds"], "which", "item", ("s", "l"), ["ds"])
    merged = merge(weighted(0.6))
    best = {r["q"]: [x["item"] for x in sorted(merged.filter(F.col("q") == r["q"]).collect(), key=lambda x: x["final_rank"])] for r in merged.select("q").distinct().collect()}
    assert best["q"][0] == 2 and len(best["q"]) == 40  # good in both lists beats first in either
    assert best["q"][1] == 0  # the list with more weight comes first among single places
    assert best["one"] == [7, 5, 6] and best["tie"] == [1, 2]
    flipped = merge(weighted(0.4))
    order = [r["item"] for r in flipped.filter("q = 'q'").orderBy("final_rank").collect()]
    assert order[0] == 2 and order[1] == 100
    plain, equal = merge(weighted(0.6).filter("ds = 'none'")), merge(weighted(0.5))
    key = lambda m: [(r["q"], r["item"], round(r["significance"], 9), r["final_rank"]) for r in m.orderBy("q", "final_rank").collect()]
    assert key(plain) == key(equal)
    assert rank_merge.list_ranks(df.limit(0), ["q", "ds"], "which", "item", "score").count() == 0


# 5. distinctiveness


def test_distinctive(spark):
    texts = [("a", "the zork zork zork zork the"), ("b", "the cat, the dog"), ("c", "The CAT the mat"), ("d", None), ("e", ""), (None, "the the"), ("f", "the " * 20_000)]
    df = spark.createDataFrame([(*t, "x") for t in texts], "r string, t string, term string")
    counts = distinctive.term_counts(df, "r", F.col("t"))
    got = {(r["record"], r["term"]): r for r in distinctive.distinctiveness(counts).collect()}
    words = {r: Counter((t or "").lower().replace(",", " ").split()) for r, t in texts if r}
    assert set(got) == {(r, w) for r, c in words.items() for w in c}
    total = sum((c for c in words.values()), Counter())
    n, p0 = sum(total.values()), distinctive.PRIOR_TOKENS
    for (r, w), row in got.items():
        m, y, p = sum(words[r].values()), words[r][w], p0 * total[w] / n
        odds = lambda k, size: np.log((k + p) / max(size + p0 - k - p, 0.5))
        z = (odds(y, m) - odds(total[w] - y, n - m)) / np.sqrt(1 / (y + p) + 1 / (total[w] - y + p))
        assert abs(row["z"] - z) < 1e-9 and row["tf"] == y and row["df"] == sum(w in c for c in words.values())
    # "the" is common everywhere but in the record that says nothing else; "zork" stands out where it recurs.
    assert got["a", "zork"]["z"] > 1.96 and got["a", "the"]["z"] < 0 < got["f", "the"]["z"]
    assert max((k for k in got if k[0] == "a"), key=lambda k: got[k]["z"]) == ("a", "zork")
    assert distinctive.distinctiveness(distinctive.term_counts(df.limit(0), "r", F.col("t"))).count() == 0


# 6. packing


def brute_fill(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= s]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(30))
def test_rules_are_best_fit_decreasing(seed):
    random.seed(seed)
    capacity = random.choice([7, 16, 50, 512])
    sizes = [min(capacity, max(1, int(random.paretovariate(0.8)))) if seed % 2 else random.randint(1, capacity) for _ in range(random.randint(0, 400))]
    rules = packing.best_fit_decreasing(Counter(sizes), capacity)
    left, seen = defaultdict(lambda: capacity), Counter()
    for size, first, items, start, per in rules:
        assert first == seen[size]
        seen[size] += items
        for i in range(items):
            left[start + i // per] -= size
    assert seen == Counter(sizes) and sorted(left.values()) == brute_fill(sizes, capacity)


def test_pack(spark):
    random.seed(1)
    rows = [(i, random.choice([1, 5, 60, 200, 512, 513, 1500])) for i in range(400)] + [(1000, 0), (1001, None), (1002, -5), (None, 10), (5, 60), (5, 60), (1003, 1_000_000)]
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "doc int, size bigint, tokens string")
    packed = packing.pack(df, "doc", F.col("size"), 512).collect()
    tokens, cut = Counter(), []
    for r in packed:
        assert (r["container"] is None) == (r["tokens"] == 0)
        if r["container"] is not None:
            tokens[r["container"]] += r["tokens"]
        if r["piece_no"] > 0:
            cut.append(r["doc"])
    assert max(tokens.values()) <= 512 and sum(tokens.values()) == sum(max(0, s or 0) for _, s in rows)
    assert set(cut) == {i for i, s in rows if s and s > 512}
    sizes = [p for _, s in rows if s and s > 0 for p in [512] * (s // 512) + ([s % 512] if s % 512 else [])]
    assert sorted(512 - t for t in tokens.values()) == brute_fill(sizes, 512)
    key = lambda x: sorted(map(str, x))
    assert key(packed) == key(packing.pack(df.repartition(9), "doc", F.col("size"), 512).collect())
    small = packing.pack(df, "doc", F.col("size"), 512, per_bucket=10).collect()
    assert sorted(Counter(r["tokens"] for r in small).items()) == sorted(Counter(r["tokens"] for r in packed).items())
    assert packing.pack(df.limit(0), "doc", F.col("size"), 512).count() == 0
    report = packing.packing_report(packing.pack(df, "doc", F.col("size"), 512), 512).first()
    assert report["containers"] == len(tokens) and report["containers"] >= report["least_containers"]


def test_public_tokenizer(spark):
    if not os.path.exists(queries.TOKENIZER):
        pytest.skip("no tokenizer files")
    got = spark.createDataFrame([("hello world",), (None,), ("<|endoftext|>",)], "t string").select(packing.public_size(queries.TOKENIZER)(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got][:2] == [2, 0] and got[2]["n"] > 1


# 7. mixing


def test_mixture(spark):
    random.seed(3)
    rows = [(i, random.choice(["big"] * 8 + ["mid"] * 3 + ["tiny"]), random.choice(["en", "de", None]), random.choice(["law", "art", None]), random.randint(0, 300)) for i in range(4000)]
    rows += [(9999, "big", "en", "law", 200_000), (9998, None, "en", "law", 50), (9997, "unknown", "en", "law", 50), (9996, "mid", "en", "law", 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "document int, source string, language string, topic string, tokens bigint, weight string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.15, 2), ("absent", 0.05, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    uses, report, marginals = mixing.mix(df, targets)
    got = {r["document"]: r["uses"] for r in uses.collect()}
    assert set(got) == {r[0] for r in rows if r[1] in ("big", "mid", "tiny")}
    caps = {"big": 1, "mid": 2, "tiny": 2}
    assert all(0 <= got[r[0]] <= caps[r[1]] for r in rows if r[0] in got)
    told = {r["source"]: r for r in report.collect()}
    total = sum(r[4] for r in rows if r[1] in caps)
    for s, r in told.items():
        own = sum(x[4] for x in rows if x[1] == s)
        assert r["available_tokens"] == own and r["short"] == (r["max_repeats"] * own < r["target_share"] * total)
        assert r["reached_tokens"] == sum(x[4] * got[x[0]] for x in rows if x[1] == s)
        assert abs(r["raked_tokens"] - min(r["target_tokens"], caps.get(s, 3) * own)) < 1e-6
    sides = {(r["axis"], r["value"]): r for r in marginals.collect()}
    for axis, at in (("language", 2), ("topic", 3)):
        named = {"language": "unknown", "topic": "none"}[axis]
        for v in {r[at] for r in rows if r[1] in caps}:
            side = sides[axis, v or named]
            assert side["reached_tokens"] == sum(r[4] * got[r[0]] for r in rows if r[1] in caps and r[at] == v)
            assert side["available_tokens"] == sum(r[4] for r in rows if r[1] in caps and r[at] == v)
    for axis in ("source", "language", "topic"):
        assert abs(sum(s["raked_tokens"] for k, s in sides.items() if k[0] == axis) - sum(r["raked_tokens"] for r in told.values())) < 1e-3
    # The other language's or topic's share can't be met where one document is half of the source it comes from.
    assert {s["converged"] for s in sides.values()} in ({True}, {False}) and all(s["rounds"] <= mixing.ROUNDS for s in sides.values())
    assert told["absent"]["short"] and told["tiny"]["short"] and told["tiny"]["reached_tokens"] == 2 * told["tiny"]["available_tokens"]
    assert abs(told["mid"]["reached_tokens"] - told["mid"]["target_tokens"]) < 0.02 * told["mid"]["target_tokens"]
    assert got == {r["document"]: r["uses"] for r in mixing.mix(df.repartition(9), targets).uses.collect()}
    empty = mixing.mix(df.limit(0), targets)
    assert empty.uses.count() == 0 and empty.marginals.count() == 0 and all(r["reached_share"] is None for r in empty.report.collect())


def test_too_many_cells_raise(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_CELLS", 2)
    df = spark.createDataFrame([(i, "s", "en", f"t{i}", 5) for i in range(3)], "document int, source string, language string, topic string, tokens bigint")
    with pytest.raises(ValueError, match="cells"):
        mixing.mix(df, spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int"))
    with pytest.raises(ValueError, match="target sources"):
        mixing.mix(df, spark.createDataFrame([(f"s{i}", 0.3, 1) for i in range(3)], "source string, target_share double, max_repeats int"))


def test_names(spark):
    rows = [(" Wiki Pages\t", "EN"), ("wiki-pages", "de-x"), ("wiki -  pages", " fr"), (None, None), ("", "zz")]
    got = [tuple(r) for r in spark.createDataFrame(rows, "s string, l string").select(mixing.source_key(F.col("s")), mixing.language_key(F.col("l"))).collect()]
    assert got == [("wiki_pages", "en"), ("wiki_pages", "de"), ("wiki_pages", "fr"), (None, "unknown"), ("", "other")]


def test_rake_meets_all_marginals():
    cells = [(s, l, t, n) for (s, l, t), n in zip([(s, l, t) for s in "ab" for l in "xy" for t in "pq"], [100, 300, 50, 70, 200, 20, 400, 90], strict=True)]
    w, rounds, change = mixing.rake(cells, {"a": 0.6, "b": 0.4}, {"a": 9, "b": 9}, 1230)
    assert change < mixing.CLOSE and 1 < rounds < mixing.ROUNDS
    tokens = np.array([c[3] for c in cells])
    for axis in (1, 2):
        for v in {c[axis] for c in cells}:
            at = np.array([c[axis] == v for c in cells])
            assert abs((tokens * w)[at].sum() - tokens[at].sum()) < 1e-3
    assert abs((tokens * w)[:4].sum() - 0.6 * 1230) < 1e-6


# 8. subjects


def corpus(n, seed=4):
    random.seed(seed)
    words = {"law": ["jury", "court", "judge", "plaintiff"], "food": ["oven", "dough", "butter", "garlic"]}
    filler = ["see the notes at the end.", "nobody said so first!", "the list goes on for a while."]
    out = []
    for i in range(n):
        about = random.choice([["law"], ["food"], ["law", "food"], []])
        parts = [f"the {random.choice(words[s])} met another {random.choice(words[s])}." for s in about for _ in range(4)]
        parts += [random.choice(filler) for _ in range(random.randint(1, 3))]
        if len(about) == 1:  # a passing mention of the other subject
            other = "food" if about == ["law"] else "law"
            parts.append(f"the {words[other][0]} met another {words[other][1]}.") if random.random() < 0.3 else None
        random.shuffle(parts)
        out.append((i, " ".join(parts).title() if i % 7 == 0 else " ".join(parts), set(about) or {"none"}))
    return out


def test_subjects_held_out(spark):
    known, fresh = corpus(400), corpus(200, 5)
    wrong = [(t, {random.choice(["law", "food", "none"])}) if i % 12 == 0 else (t, s) for i, t, s in known]
    lexicon = subjects.fit_lexicon(wrong, ["food", "law"])
    rows = [(i, t, "x") for i, t, _ in fresh] + [(1000, None, "x"), (1001, " \n ", "x"), (1002, "?!", "x"), (1003, "the jury met another judge. " * 5000, "x"), (0, fresh[0][1], "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, subjects string")
    assigned = subjects.assign_subjects(df, "doc_id", "text", lexicon)
    assert assigned.count() == len(rows)
    got = defaultdict(set)
    for r in subjects.subject_rows(assigned, "doc_id").collect():
        got[r["doc_id"]].add(r["subject"])
    right = sum(got[i] == s - {"none"} for i, _, s in fresh)
    assert right >= 0.97 * len(fresh)
    assert got[1003] == {"law"} and not (got[1000] or got[1001] or got[1002])
    shares = {r["subject"]: r["documents"] for r in subjects.composition(assigned, "doc_id").collect()}
    assert sum(len(v) for v in got.values()) == shares["law"] + shares["food"]


def test_subjects_without_labels(spark):
    lexicon = subjects.fit_lexicon([], ["law"])
    df = spark.createDataFrame([(1, "the jury")], "doc_id int, text string")
    assert subjects.assign_subjects(df, "doc_id", "text", lexicon).first()["main_subject"] is None
    assert subjects.composition(subjects.assign_subjects(df.limit(0), "doc_id", "text", lexicon), "doc_id").count() == 0
    labels = spark.createDataFrame([(1, " LAW "), (1, None), (2, "law"), (None, "law")], "doc_id int, subject string")
    assert subjects.labelled_sample(df, labels) == [("the jury", {"law"})]
