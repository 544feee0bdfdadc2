"""Queries of the semantic path. Searches take every vector whose id is divisible by 100 as a query, against all."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions.vector import augmented, dot, doubles, hadamard
from larkspan.operators import compartment, lexical, vector_index
from larkspan.plans import base
from larkspan.session import materialise, table

#: Nine of sixteen cells: with fewer than eight the probes find less than 0.9 of the exact ten.
CELLS, ASSIGNMENTS, PROBES = 16, 2, 9
#: The reference's largest local depth: by 16 of 64 coordinates 64 rows a cell find 0.835 of the exact ten (sf0.1), 96 find 0.915.
WIDTH, CHOSEN, LOCAL_TOP, TOP = 64, 16, 128, 10
KEY = "semantic"
#: Rows that reach the exact rerank of the search under one global key.
CANDIDATES = 100
#: The local depths that the reference sweeps.
DEPTHS = (2, 4, 8, 16, 32, 64, 128)
#: The share of a trained index' cells that is probed, and the rounds of its training over all rows.
TRAINED_PROBES, TRAINING_ROUNDS = 0.45, 10


def unit(spark: SparkSession, folder: str) -> DataFrame:
    return vector_index.normalised(base.vectors(spark, folder)).select("vec_id", "x", "label")


def _norm_sql(v: str) -> str:
    return f"greatest(sqrt(list_dot_product({v}, {v})), 1e-12)"


def _scaled_sql(v: str) -> str:
    return f"list_transform({v}, lambda e: e / {_norm_sql(v)})"


UNIT_SQL = f"{base.VECTORS_SQL}, unit_ AS (SELECT vec_id, {_scaled_sql('x')} AS x, label FROM vectors_)"


def _long(rows: DataFrame, item: str = "vec_id") -> DataFrame:
    return rows.select(item, F.posexplode("x").alias("pos", "value")).withColumn("value", F.round("value", 6))


def _long_sql(source: str, item: str = "vec_id") -> str:
    return f"SELECT {item}, CAST(i - 1 AS INTEGER) AS pos, round(v, 6) AS value FROM (SELECT {item}, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM {source})"


def unit_long(spark: SparkSession, folder: str) -> DataFrame:
    return _long(unit(spark, folder))


UNIT_LONG = f"WITH {UNIT_SQL} {_long_sql('unit_')}"


def mean_long(spark: SparkSession, folder: str) -> DataFrame:
    mean = vector_index.mean_vector(unit(spark, folder))
    return mean.select(F.posexplode("mean").alias("pos", "value")).withColumn("value", F.round("value", 6))


MEAN_SQL = """mean_ AS (SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(v) AS m FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS i FROM unit_) GROUP BY 1))"""
MEAN_LONG = f"WITH {UNIT_SQL}, {MEAN_SQL} SELECT CAST(i - 1 AS INTEGER) AS pos, round(v, 6) AS value FROM (SELECT unnest(mean) AS v, generate_subscripts(mean, 1) AS i FROM mean_)"


def residual(spark: SparkSession, folder: str) -> DataFrame:
    return vector_index.residuals(unit(spark, folder).select("vec_id", "x"))


RESIDUAL_SQL = f"""{UNIT_SQL}, {MEAN_SQL}, moved_ AS (SELECT vec_id, list_transform(list_zip(x, mean), lambda p: p[1] - p[2]) AS x FROM unit_ CROSS JOIN mean_),
residual_ AS (SELECT vec_id, {_scaled_sql('x')} AS x FROM moved_)"""


def residual_long(spark: SparkSession, folder: str) -> DataFrame:
    return _long(residual(spark, folder))


RESIDUAL_LONG = f"WITH {RESIDUAL_SQL} {_long_sql('residual_')}"


def hadamard_long(spark: SparkSession, folder: str) -> DataFrame:
    rows = unit(spark, folder).select("vec_id", hadamard(F.col("x"), WIDTH).alias("x"))
    return _long(rows)


HADAMARD_LONG = f"""WITH {UNIT_SQL}, w_ AS (SELECT vec_id, list_transform(range({WIDTH}), lambda r: list_sum(list_transform(x, lambda v, i:
  CASE WHEN bit_count(r & (i - 1)) % 2 = 0 THEN v ELSE -v END)) / sqrt({WIDTH}.0::DOUBLE)) AS x FROM unit_) {_long_sql('w_')}"""


def augmented_long(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors divided by the largest norm, with the coordinate that makes their length one."""
    rows = base.vectors(spark, folder).select("vec_id", "x")
    largest = rows.agg(F.max(F.sqrt(dot(F.col("x"), F.col("x")))).alias("m"))  # one row
    shrunk = rows.join(F.broadcast(largest)).withColumn("x", F.transform("x", lambda v: v / F.col("m") * 0.9))
    return _long(shrunk.select("vec_id", augmented(F.col("x")).alias("x")))


AUGMENTED_LONG = f"""WITH {base.VECTORS_SQL}, s_ AS (SELECT vec_id, list_transform(x, lambda v: v / m * 0.9::DOUBLE) AS x FROM vectors_
  CROSS JOIN (SELECT max(sqrt(list_dot_product(x, x))) AS m FROM vectors_)),
a_ AS (SELECT vec_id, list_append(x, sqrt(greatest(0.0, 1 - list_dot_product(x, x)))) AS x FROM s_) {_long_sql('a_')}"""


class Index:
    """The vectors' residuals and everything built on them, each made once per query that asks for it."""

    probed = PROBES

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.rows = materialise(residual(spark, folder))

    @cached_property
    def start(self) -> DataFrame:
        return materialise(vector_index.first_centroids(self.rows, "vec_id", CELLS))

    @cached_property
    def centroids(self) -> DataFrame:
        """Centroids after one round, the last thing that both engines compute alike."""
        return materialise(vector_index.lloyd_step(self.rows, self.start, "vec_id"))

    @cached_property
    def assigned(self) -> DataFrame:
        """The two nearest cells of every vector."""
        return materialise(vector_index.nearest_cells(self.rows, "vec_id", self.centroids, ASSIGNMENTS))

    @cached_property
    def asked(self) -> DataFrame:
        return self.rows.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id")

    @cached_property
    def probes(self) -> DataFrame:
        return materialise(vector_index.nearest_cells(self.asked, "query_id", self.centroids, self.probed))

    @cached_property
    def found(self) -> DataFrame:
        return vector_index.candidates(self.probes, self.assigned, "query_id", "vec_id")

    @cached_property
    def rotated(self) -> DataFrame:
        return materialise(rotate(self.rows, self.spark))

    @cached_property
    def keys(self) -> DataFrame:
        return compartment.cell_keys(self.spark, CELLS, WIDTH, CHOSEN, KEY)

    def stored(self, noise: float = 0.0) -> DataFrame:
        rows = self.rotated.join(self.assigned.select("vec_id", "cell"), "vec_id")
        return compartment.local_vectors(rows, "vec_id", self.keys, noise, "stored")

    def local_queries(self, noise: float = 0.0, seed: str = "asked") -> DataFrame:
        asked = self.rotated.withColumnRenamed("vec_id", "query_id").join(self.probes.select("query_id", "cell"), "query_id")
        return compartment.local_vectors(asked, "query_id", self.keys, noise, seed)

    def local_best(self) -> DataFrame:
        return compartment.search_cells(self.local_queries(), self.stored(), "query_id", "vec_id", LOCAL_TOP)

    def scored(self, pairs: DataFrame) -> DataFrame:
        rows, asked = self.rows.select("vec_id", "x"), self.asked.select("query_id", F.col("x").alias("q"))
        return pairs.join(rows, "vec_id").join(asked, "query_id").select("query_id", "vec_id", F.round(dot(F.col("q"), F.col("x")), 9).alias("score"))


class TrainedIndex(Index):
    """An index on trained centroids; cells and probes grow with the number of vectors."""

    @cached_property
    def cells(self) -> int:
        return vector_index.cells_for(self.rows.count())

    @cached_property
    def probed(self) -> int:
        return max(1, round(self.cells * TRAINED_PROBES))

    @cached_property
    def centroids(self) -> DataFrame:
        return materialise(vector_index.train(self.rows, "vec_id", self.cells, TRAINING_ROUNDS))


START_SQL = f"""{RESIDUAL_SQL}, start_ AS (SELECT row_number() OVER (ORDER BY sha256(CAST(vec_id AS VARCHAR))) - 1 AS cell, x FROM residual_
  ORDER BY sha256(CAST(vec_id AS VARCHAR)) LIMIT {CELLS})"""


CENTROIDS_SQL = f"""{START_SQL}, own_ AS (SELECT vec_id, x, arg_max(cell, (score, -cell)) AS cell FROM (SELECT r.vec_id, r.x, c.cell,
  round(list_dot_product(r.x, c.x), 9) AS score FROM residual_ r CROSS JOIN start_ c) GROUP BY 1, 2),
new_ AS (SELECT cell, list(m ORDER BY i) AS x FROM (SELECT cell, i, avg(v) AS m FROM (SELECT cell, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM own_) GROUP BY 1, 2) GROUP BY 1),
centroids_ AS (SELECT cell, {_scaled_sql('x')} AS x FROM (SELECT cell, coalesce(n.x, s.x) AS x FROM start_ s LEFT JOIN new_ n USING (cell)))"""


def lloyd_long(spark: SparkSession, folder: str) -> DataFrame:
    return _long(Index(spark, folder).centroids, "cell")


LLOYD_LONG = f"WITH {CENTROIDS_SQL} {_long_sql('centroids_', 'cell')}"


_NEAR = """(SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cell) - 1 AS rank FROM (
  SELECT r.vec_id, c.cell, round(list_dot_product(r.x, c.x), 9) AS score FROM {source} r CROSS JOIN centroids_ c))"""
ASSIGNED_SQL = f"{CENTROIDS_SQL}, assigned_ AS (SELECT * FROM {_NEAR.format(source='residual_')} WHERE rank < {ASSIGNMENTS})"


def assigned_rows(spark: SparkSession, folder: str) -> DataFrame:
    return Index(spark, folder).assigned.withColumn("score", F.round("score", 6))


ASSIGNED = f"WITH {ASSIGNED_SQL} SELECT vec_id, cell, round(score, 6) AS score, rank FROM assigned_"


def offsets(spark: SparkSession, folder: str) -> DataFrame:
    return vector_index.cell_offsets(Index(spark, folder).assigned, CELLS)


OFFSETS = f"""WITH {ASSIGNED_SQL}, z_ AS (SELECT cell, coalesce(n, 0) AS size FROM (SELECT unnest(range({CELLS})) AS cell)
  LEFT JOIN (SELECT cell, count(*) AS n FROM assigned_ GROUP BY 1) USING (cell))
SELECT cell, size, CAST(sum(size) OVER (ORDER BY cell) AS BIGINT) AS offset_to, CAST(sum(size) OVER (ORDER BY cell) - size AS BIGINT) AS offset_from FROM z_"""


FOUND_SQL = f"""{ASSIGNED_SQL}, asked_ AS (SELECT vec_id, x FROM residual_ WHERE vec_id % 100 = 0),
probes_ AS (SELECT vec_id AS query_id, cell FROM {_NEAR.format(source='asked_')} WHERE rank < {PROBES}),
found_ AS (SELECT query_id, cell, vec_id FROM probes_ JOIN assigned_ USING (cell))"""


def probe_trace(spark: SparkSession, folder: str) -> DataFrame:
    return vector_index.candidate_trace(Index(spark, folder).found, "query_id", "vec_id")


TRACE = f"""WITH {FOUND_SQL} SELECT query_id, CAST(sum(n) AS BIGINT) AS entries_read, max(n) AS largest, count(*) AS nonempty, any_value(u) AS unique_candidates
FROM (SELECT query_id, cell, count(*) AS n FROM found_ GROUP BY 1, 2) JOIN (SELECT query_id, count(DISTINCT vec_id) AS u FROM found_ GROUP BY 1) USING (query_id) GROUP BY 1"""


def _top(scores: DataFrame) -> DataFrame:
    best = lexical.top_k(scores, ["query_id"], TOP, "vec_id")
    return best.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def ivf_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best of the probed cells by exact score."""
    index = Index(spark, folder)
    return _top(index.scored(index.found.select("query_id", "vec_id").distinct()))


def _top_sql(source: str) -> str:
    return f"""SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM (
  SELECT query_id, f.vec_id, round(list_dot_product(q.x, r.x), 9) AS score FROM {source} f JOIN residual_ r ON r.vec_id = f.vec_id JOIN asked_ q ON q.vec_id = f.query_id)) WHERE rank < {TOP}"""


IVF_EXACT = f"WITH {FOUND_SQL} {_top_sql('(SELECT DISTINCT query_id, vec_id FROM found_)')}"


def exact(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best of all vectors."""
    return exact_best(Index(spark, folder))


def exact_best(index: Index) -> DataFrame:
    best = vector_index.exact_top(index.asked, index.rows, "query_id", "vec_id", TOP)
    return best.withColumn("score", F.round("score", 6))


EXACT = f"WITH {RESIDUAL_SQL}, asked_ AS (SELECT vec_id, x FROM residual_ WHERE vec_id % 100 = 0) {_top_sql('(SELECT a.vec_id AS query_id, b.vec_id FROM asked_ a CROSS JOIN residual_ b)')}"


def ivf_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The share of the exact ten that probing finds, per query."""
    index = Index(spark, folder)
    near = index.found.select("query_id", "vec_id").distinct().withColumn("hit", F.lit(1))
    best = exact_best(index).join(near, ["query_id", "vec_id"], "left")
    return best.groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


RECALL = f"""WITH {FOUND_SQL}, best_ AS ({_top_sql('(SELECT a.vec_id AS query_id, b.vec_id FROM asked_ a CROSS JOIN residual_ b)')})
SELECT query_id, round(avg(CASE WHEN f.vec_id IS NULL THEN 0 ELSE 1 END), 6) AS recall FROM best_ LEFT JOIN (SELECT DISTINCT query_id, vec_id FROM found_) f USING (query_id, vec_id) GROUP BY 1"""


def _uniform(what: str, *parts: str) -> str:
    text = " || ':' || ".join([f"'{what}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"((CAST(('0x' || substring(sha256({text}), 1, 12)) AS UBIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)"


def _uniform_tail(what: str, tail: str, *parts: str) -> str:
    text = " || ':' || ".join([f"'{what}'", *[f"CAST({p} AS VARCHAR)" for p in parts], f"'{tail}'"])
    return f"((CAST(('0x' || substring(sha256({text}), 1, 12)) AS UBIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)"


def global_sql(name: str, width: int) -> str:
    return f"""global_ AS (SELECT pos, CASE WHEN {_uniform(name + ':sign1', 'pos')} < 0.5 THEN -1.0 ELSE 1.0 END AS sign1,
  CASE WHEN {_uniform(name + ':sign2', 'pos')} < 0.5 THEN -1.0 ELSE 1.0 END AS sign2,
  row_number() OVER (ORDER BY {_uniform(name + ':order', 'pos')}, pos) - 1 AS source FROM (SELECT unnest(range({width})) AS pos))"""


def keys_sql(name: str, cells: int, width: int, chosen: int) -> str:
    return f"""keys_ AS (SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY pos) - 1 AS slot, pos,
  CASE WHEN {_uniform(name + ':sign', 'cell', 'pos')} < 0.5 THEN -1.0 ELSE 1.0 END AS sign, sqrt({width}.0::DOUBLE / {chosen}) AS multiplier,
  sqrt(-2 * ln({_uniform_tail(name + ':shift', 'u', 'cell', 'pos')})) * cos(2 * 3.141592653589793::DOUBLE * {_uniform_tail(name + ':shift', 'v', 'cell', 'pos')}) AS shift
  FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {_uniform(name + ':choice', 'cell', 'pos')}, pos) AS r
    FROM (SELECT c.cell, p.pos FROM (SELECT unnest(range({cells})) AS cell) c CROSS JOIN (SELECT unnest(range({width})) AS pos) p)) WHERE r <= {chosen})"""


GLOBAL_SQL = global_sql(KEY, WIDTH)
KEYS_SQL = keys_sql(KEY, CELLS, WIDTH, CHOSEN)


def keys_of_cells(spark: SparkSession, folder: str) -> DataFrame:
    keys = compartment.cell_keys(spark, CELLS, WIDTH, CHOSEN, KEY)
    return keys.withColumn("multiplier", F.round("multiplier", 9)).withColumn("shift", F.round("shift", 9))


CELL_KEYS = f"WITH {KEYS_SQL} SELECT cell, slot, pos, CAST(sign AS DOUBLE) AS sign, round(multiplier, 9) AS multiplier, round(shift, 9) AS shift FROM keys_"


def rotate(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Vectors of `WIDTH` under the global key."""
    key = compartment.global_key(spark, WIDTH, KEY)
    flip = key.select(F.col("pos").alias("source"), F.col("sign2").alias("flip"))
    # Output p takes the Hadamard row `source` of p, with that row's second sign.
    entry = F.struct("pos", "sign1", "source", F.col("flip").alias("sign2"))
    packed = key.select("pos", "sign1", "source").join(flip, "source").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    packed = packed.select(F.struct(F.col("e.sign1").alias("signs1"), F.col("e.source").alias("source"), F.col("e.sign2").alias("sign2")).alias("key"))
    return rows.join(F.broadcast(packed)).withColumn("x", compartment.rotated(F.col("x"), F.col("key"), WIDTH)).drop("key")  # one row


ROTATED_SQL = f"""{GLOBAL_SQL}, signs_ AS (SELECT list(sign1 ORDER BY pos) AS s1 FROM global_),
packed_ AS (SELECT list({{'source': source, 'flip': flip}} ORDER BY pos) AS rows FROM (SELECT g.pos, g.source, f.sign2 AS flip FROM global_ g JOIN global_ f ON f.pos = g.source)),
rotated_ AS (SELECT vec_id, list_transform(rows, lambda r: list_sum(list_transform(z, lambda v, i: CASE WHEN bit_count(r.source & (i - 1)) % 2 = 0 THEN v ELSE -v END)) * r.flip / sqrt({WIDTH}.0::DOUBLE)) AS x
  FROM (SELECT vec_id, list_transform(list_zip(x, s1), lambda p: p[1] * p[2]) AS z FROM residual_ CROSS JOIN signs_) CROSS JOIN packed_)"""


def rotated_long(spark: SparkSession, folder: str) -> DataFrame:
    return _long(rotate(residual(spark, folder), spark))


ROTATED_LONG = f"WITH {RESIDUAL_SQL}, {ROTATED_SQL} {_long_sql('rotated_')}"


def local_long(spark: SparkSession, folder: str) -> DataFrame:
    """All stored vectors under their cells' keys."""
    return Index(spark, folder).stored().select("vec_id", "cell", F.posexplode("y").alias("slot", "value")).withColumn("value", F.round("value", 6))


LOCAL_SQL = f"""{ROTATED_SQL}, {KEYS_SQL}, folded_ AS (SELECT cell, list({{'pos': pos, 'sign': sign, 'multiplier': multiplier, 'shift': shift}} ORDER BY slot) AS k FROM keys_ GROUP BY 1),
stored_ AS (SELECT vec_id, cell, list_transform(k, lambda e: x[e.pos + 1] * e.sign * e.multiplier + e.shift) AS y FROM rotated_ JOIN assigned_ USING (vec_id) JOIN folded_ USING (cell)),
asks_ AS (SELECT query_id, cell, list_transform(k, lambda e: x[e.pos + 1] * e.sign * e.multiplier + e.shift) AS y FROM probes_ JOIN rotated_ ON vec_id = query_id JOIN folded_ USING (cell))"""
LOCAL_LONG = f"WITH {FOUND_SQL}, {LOCAL_SQL} SELECT vec_id, cell, CAST(i - 1 AS INTEGER) AS slot, round(v, 6) AS value FROM (SELECT vec_id, cell, unnest(y) AS v, generate_subscripts(y, 1) AS i FROM stored_)"


def compartment_local(spark: SparkSession, folder: str) -> DataFrame:
    """The local best per query and probed cell, without noise."""
    return Index(spark, folder).local_best().withColumn("score", F.round("score", 6))


LOCAL_TOP_SQL = f"""{LOCAL_SQL}, local_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cell ORDER BY score DESC, vec_id) - 1 AS local_rank FROM (
  SELECT query_id, cell, vec_id, round(2 * list_dot_product(a.y, s.y) - list_dot_product(s.y, s.y), 9) AS score FROM asks_ a JOIN stored_ s USING (cell))) WHERE local_rank < {LOCAL_TOP})"""
COMPARTMENT_LOCAL = f"WITH {FOUND_SQL}, {LOCAL_TOP_SQL} SELECT query_id, cell, vec_id, round(score, 6) AS score, local_rank FROM local_"


def compartment_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The union of local bests, ranked by exact score."""
    return local_ranking(Index(spark, folder))


def local_ranking(index: Index) -> DataFrame:
    return _top(index.scored(index.local_best().select("query_id", "vec_id").distinct()))


COMPARTMENT = f"WITH {FOUND_SQL}, {LOCAL_TOP_SQL} {_top_sql('(SELECT DISTINCT query_id, vec_id FROM local_)')}"


def interleaved(spark: SparkSession, folder: str) -> DataFrame:
    return compartment.interleaved(Index(spark, folder).local_best(), "query_id", "vec_id")


INTERLEAVED = f"""WITH {FOUND_SQL}, {LOCAL_TOP_SQL} SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY r, c, vec_id) - 1 AS rank FROM (
  SELECT query_id, vec_id, min((local_rank, cell))[1] AS r, min((local_rank, cell))[2] AS c FROM local_ GROUP BY 1, 2)"""


def noisy_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Compartment search with noise on stored vectors and queries, three repeats, and each one's overlap with the noiseless ten."""
    index = Index(spark, folder)
    stored = index.stored(compartment.noise_radius(1.0, 0.1, False))
    clean = local_ranking(index).select("query_id", "vec_id")
    out = None
    for repeat in range(3):
        asked = index.local_queries(compartment.noise_radius(1.0, 0.1, True), f"asked:{repeat}")
        local = compartment.search_cells(asked, stored, "query_id", "vec_id", LOCAL_TOP)
        best = _top(index.scored(local.select("query_id", "vec_id").distinct()))
        kept = best.join(clean, ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"))
        row = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned")).join(kept, "query_id", "left").withColumn("repeat_no", F.lit(repeat))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("kept", F.coalesce("kept", F.lit(0)))


def trained_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes and tightness of the trained cells."""
    index = TrainedIndex(spark, folder)
    own = vector_index.nearest_cells(index.rows, "vec_id", index.centroids, 1)
    return own.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("score"), 6).alias("mean_cosine"))


def trained_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best of the trained index' probed cells by exact score."""
    index = TrainedIndex(spark, folder)
    return _top(index.scored(index.found.select("query_id", "vec_id").distinct()))


def trained_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Per query the share of the exact ten that the trained index finds, and of all vectors that it reads."""
    index = TrainedIndex(spark, folder)
    near = materialise(index.found.select("query_id", "vec_id").distinct())
    best = exact_best(index).join(near.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    hits = best.groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))
    read = near.groupBy("query_id").agg((F.count(F.lit(1)) / F.lit(index.rows.count())).alias("share_read"))
    return hits.join(read, "query_id")


def cell_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Per build of the index files: its cells and the mean length of their centroids, repeats folded."""
    cells = table(spark, folder, "ivf_cells").select("build_id", "label", doubles(F.col("centroid")).alias("x"), "offset_from", "offset_to")
    one = cells.groupBy("build_id", "label").agg(F.min("x").alias("x"), F.max(F.col("offset_to") - F.col("offset_from")).alias("size"))
    return one.groupBy("build_id").agg(F.count(F.lit(1)).alias("cells"), F.count("x").alias("with_centroid"), F.sum(F.coalesce("size", F.lit(0))).alias("entries"), F.max("size").alias("largest"))


CENTROID_FILES = """SELECT build_id, count(*) AS cells, count(x) AS with_centroid, CAST(sum(coalesce(size, 0)) AS BIGINT) AS entries, max(size) AS largest FROM (
  SELECT build_id, label, min(centroid) AS x, max(offset_to - offset_from) AS size FROM ivf_cells GROUP BY 1, 2) GROUP BY 1"""


def neighbourhood_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How many of a query's exact ten nearest others the keyed coordinates of its own cell give away."""
    index = Index(spark, folder)
    rows = index.rows
    near = vector_index.exact_top(index.asked, rows, "query_id", "vec_id", TOP + 1).filter("query_id <> vec_id")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("r") <= TOP).select("query_id", "vec_id")
    own = vector_index.nearest_cells(rows, "vec_id", index.centroids, 1).select("vec_id", "cell")
    stored = materialise(compartment.local_vectors(index.rotated.join(own, "vec_id"), "vec_id", index.keys))
    asked = stored.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "cell", "y")
    local = compartment.search_cells(asked, stored, "query_id", "vec_id", TOP + 1).filter("query_id <> vec_id")
    local = local.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("local_rank"))).filter(F.col("r") <= TOP).select("query_id", "vec_id")
    same = near.join(own, "vec_id").join(asked.select("query_id", F.col("cell").alias("own")), "query_id").filter("cell = own").select("query_id", "vec_id")
    share = lambda hits, name: near.join(hits.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / TOP, 6).alias(name))
    return share(local, "recall").join(share(same, "same_cell"), "query_id")


NEIGHBOURHOOD = f"""WITH {CENTROIDS_SQL}, asked_ AS (SELECT vec_id, x FROM residual_ WHERE vec_id % 100 = 0),
assigned_ AS (SELECT * FROM {_NEAR.format(source='residual_')} WHERE rank < 1), probes_ AS (SELECT a.vec_id AS query_id, cell FROM asked_ a JOIN assigned_ USING (vec_id)),
{LOCAL_SQL}, near_ AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (
  SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.x, b.x), 9) AS score FROM asked_ a JOIN residual_ b ON a.vec_id <> b.vec_id)) WHERE r <= {TOP}),
loc_ AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (
  SELECT query_id, vec_id, round(2 * list_dot_product(a.y, s.y) - list_dot_product(s.y, s.y), 9) AS score FROM asks_ a JOIN stored_ s USING (cell) WHERE query_id <> vec_id)) WHERE r <= {TOP})
SELECT n.query_id, round(sum(CASE WHEN l.vec_id IS NULL THEN 0 ELSE 1 END) / {TOP}.0::DOUBLE, 6) AS recall, round(sum(CASE WHEN o.cell = p.cell THEN 1 ELSE 0 END) / {TOP}.0::DOUBLE, 6) AS same_cell
FROM near_ n LEFT JOIN loc_ l ON l.query_id = n.query_id AND l.vec_id = n.vec_id JOIN assigned_ o ON o.vec_id = n.vec_id JOIN assigned_ p ON p.vec_id = n.query_id GROUP BY 1"""


def probe_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the exact ten, and what is read, for 1 to 16 probed cells."""
    index = Index(spark, folder)
    most = vector_index.nearest_cells(index.asked, "query_id", index.centroids, CELLS)
    levels = spark.createDataFrame([(n,) for n in (1, 2, 4, 8, 16)], "probes bigint")
    probes = most.join(F.broadcast(levels), F.col("rank") < F.col("probes"))  # five rows
    seen = probes.select("query_id", "probes", "cell").join(index.assigned.select("cell", "vec_id"), "cell")
    reads = seen.groupBy("probes").agg(F.count(F.lit(1)).alias("entries_read"))
    best = exact_best(index).select("query_id", "vec_id")
    hits = best.join(seen.select("query_id", "vec_id", "probes").distinct(), ["query_id", "vec_id"]).groupBy("probes").agg(F.count(F.lit(1)).alias("hits"))
    return levels.join(reads, "probes", "left").join(hits, "probes", "left").na.fill(0)


PROBE_SWEEP = f"""WITH {ASSIGNED_SQL}, asked_ AS (SELECT vec_id, x FROM residual_ WHERE vec_id % 100 = 0),
best_ AS ({_top_sql('(SELECT a.vec_id AS query_id, b.vec_id FROM asked_ a CROSS JOIN residual_ b)')}),
most_ AS (SELECT vec_id AS query_id, cell, rank FROM {_NEAR.format(source='asked_')}),
seen_ AS (SELECT query_id, probes, vec_id FROM most_ JOIN (VALUES (1), (2), (4), (8), (16)) v(probes) ON rank < probes JOIN assigned_ USING (cell))
SELECT CAST(p AS BIGINT) AS probes, (SELECT count(*) FROM seen_ s WHERE s.probes = p) AS entries_read,
  (SELECT count(*) FROM best_ b WHERE EXISTS (SELECT 1 FROM seen_ s WHERE s.probes = p AND s.query_id = b.query_id AND s.vec_id = b.vec_id)) AS hits
FROM (VALUES (1), (2), (4), (8), (16)) v(p)"""


def coverage_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Per number of probed cells how much of the exact hundred and of the exact ten is read; the least with 0.95 of both is chosen.

    Without such a number the largest is chosen. `p05` is the twentieth of the queries with the least of the hundred.
    """
    index = Index(spark, folder)
    most = vector_index.nearest_cells(index.asked, "query_id", index.centroids, CELLS)
    placed = most.select("query_id", "cell", F.col("rank").alias("cell_rank"))
    first = vector_index.per_cell(placed, index.assigned.select("cell", "vec_id"), "vec_id").groupBy("query_id", "vec_id").agg(F.min("cell_rank").alias("seen_at"))
    best = vector_index.exact_top(index.asked, index.rows, "query_id", "vec_id", 100).select("query_id", "vec_id", "rank").join(first, ["query_id", "vec_id"])
    levels = F.explode(F.array(*map(F.lit, (1, 2, 4, 8, 16)))).alias("probes")
    each = materialise(best.select("query_id", "rank", "seen_at", levels))
    seen = (F.col("seen_at") < F.col("probes")).cast("double")
    per = each.groupBy("query_id", "probes").agg(F.avg(seen).alias("hundred"), F.avg(F.when(F.col("rank") < TOP, seen)).alias("ten"))
    means = per.groupBy("probes").agg(F.round(F.avg("hundred"), 6).alias("of_hundred"), F.round(F.percentile("hundred", F.lit(0.05)), 6).alias("p05"), F.round(F.avg("ten"), 6).alias("of_ten"))
    good = (F.col("of_hundred") >= 0.95) & (F.col("of_ten") >= 0.95)
    order = Window.orderBy(F.when(good, F.col("probes")).otherwise(1_000_000 - F.col("probes")))  # five rows
    return means.withColumn("chosen", F.row_number().over(order) == 1)


COVERAGE = f"""WITH {ASSIGNED_SQL}, asked_ AS (SELECT vec_id, x FROM residual_ WHERE vec_id % 100 = 0),
most_ AS (SELECT vec_id AS query_id, cell, rank FROM {_NEAR.format(source='asked_')}),
first_ AS (SELECT query_id, vec_id, min(m.rank) AS seen_at FROM most_ m JOIN assigned_ USING (cell) GROUP BY ALL),
best_ AS (SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.x, b.x), 9) AS score FROM asked_ a CROSS JOIN residual_ b)) WHERE rank < 100),
per_ AS (SELECT query_id, probes, avg((seen_at < probes)::INT) AS h, avg(CASE WHEN rank < {TOP} THEN (seen_at < probes)::INT END) AS t
  FROM best_ JOIN first_ USING (query_id, vec_id) CROSS JOIN (VALUES (1), (2), (4), (8), (16)) v(probes) GROUP BY 1, 2),
means_ AS (SELECT probes, round(avg(h), 6) AS of_hundred, round(quantile_cont(h, 0.05), 6) AS p05, round(avg(t), 6) AS of_ten FROM per_ GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY CASE WHEN of_hundred >= 0.95 AND of_ten >= 0.95 THEN probes ELSE 1000000 - probes END) = 1 AS chosen FROM means_"""


def global_rerank(spark: SparkSession, folder: str, beta: float = 0.1) -> DataFrame:
    """Search on vectors under one global key with noise: the nearest CANDIDATES of the probed cells, then the ten best by exact score."""
    index = Index(spark, folder)
    noisy = lambda rows, item, of_query: rows.select(item, F.zip_with("x", compartment.ball_noise(item, F.size("x"), compartment.noise_radius(1.0, beta, of_query), f"global:{of_query}"), lambda v, e: v + e).alias("x"))
    stored = materialise(noisy(index.rotated, "vec_id", False))
    asked = materialise(noisy(index.rotated.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id"), "query_id", True))
    pairs = index.found.select("query_id", "vec_id").distinct().join(stored, "vec_id").join(asked.withColumnRenamed("x", "q"), "query_id")
    near = pairs.select("query_id", "vec_id", F.round(2 * dot(F.col("q"), F.col("x")) - dot(F.col("x"), F.col("x")), 9).alias("score"))
    return _top(index.scored(lexical.top_k(near, ["query_id"], CANDIDATES, "vec_id").select("query_id", "vec_id")))


def depth_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """The sweep of the local depth: per depth the candidates that reach the exact rerank and the share of the exact ten among them."""
    index = Index(spark, folder)
    local = materialise(index.local_best().select("query_id", "vec_id", "local_rank"))
    depths = F.explode(F.array(*map(F.lit, DEPTHS))).alias("depth")
    kept = local.groupBy("query_id", "vec_id").agg(F.min("local_rank").alias("at")).select("query_id", "vec_id", "at", depths).filter(F.col("at") < F.col("depth"))
    kept = kept.join(exact_best(index).select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    per = kept.groupBy("query_id", "depth").agg(F.count(F.lit(1)).alias("candidates"), (F.coalesce(F.sum("hit"), F.lit(0)) / TOP).alias("recall"))
    return per.groupBy("depth").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("candidates"), 6).alias("mean_candidates"), F.max("candidates").alias("most_candidates"),
        F.round(F.avg("recall"), 6).alias("recall"), F.round(F.min("recall"), 6).alias("least_recall"))


DEPTH_SWEEP = f"""WITH {FOUND_SQL}, {LOCAL_TOP_SQL}, best_ AS ({_top_sql('(SELECT a.vec_id AS query_id, b.vec_id FROM asked_ a CROSS JOIN residual_ b)')}),
at_ AS (SELECT query_id, vec_id, min(local_rank) AS least_rank FROM local_ GROUP BY 1, 2),
per_ AS (SELECT query_id, depth, count(*) AS n, count(b.score) / {TOP}.0::DOUBLE AS r FROM at_ JOIN (VALUES {', '.join(f'({d})' for d in DEPTHS)}) v(depth) ON least_rank < depth
  LEFT JOIN best_ b USING (query_id, vec_id) GROUP BY 1, 2)
SELECT depth, count(*) AS queries, round(avg(n), 6) AS mean_candidates, max(n) AS most_candidates, round(avg(r), 6) AS recall, round(min(r), 6) AS least_recall FROM per_ GROUP BY 1"""


def projected_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Search over orthogonal projections per cell: how many of the exact ten are among the local bests of the probed cells."""
    index = Index(spark, folder)
    stored = compartment.projected(index.rows.join(index.assigned.select("vec_id", "cell"), "vec_id"), "vec_id", index.centroids, WIDTH, CHOSEN, KEY)
    asked = compartment.projected(index.asked.join(index.probes.select("query_id", "cell"), "query_id"), "query_id", index.centroids, WIDTH, CHOSEN, KEY)
    local = compartment.search_cells(asked, stored, "query_id", "vec_id", LOCAL_TOP).select("query_id", "vec_id").distinct().withColumn("hit", F.lit(1))
    best = exact_best(index).join(local, ["query_id", "vec_id"], "left")
    return best.groupBy("query_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count(F.lit(1)).alias("wanted"))


QUERIES = {
    "b2_unit_vectors": unit_long, "d6_mean_vector": mean_long, "i1_residuals": residual_long, "b12_hadamard": hadamard_long, "b13_b14_rotation": rotated_long,
    "b20_augmented": augmented_long, "i3_lloyd_step": lloyd_long, "i2_trained_cells": trained_cells, "i2_i8_trained_search": trained_search, "i2_i5_trained_recall": trained_recall, "i4_c5_assignments": assigned_rows, "d7_offsets": offsets,
    "i5_d8_d9_probe_trace": probe_trace, "i8_ivf_exact": ivf_exact, "i9_c4_exact_top10": exact, "i5_ivf_recall": ivf_recall, "b18_cell_keys": keys_of_cells,
    "i11_local_vectors": local_long, "e2_compartment_local": compartment_local, "i12_i7_compartment_ranking": compartment_ranking, "e4_k8_interleaved": interleaved,
    "b15_b16_i6_noisy_repeats": noisy_repeats, "a7_index_files": cell_centroids, "k6_neighbourhood_recall": neighbourhood_recall,
    "j17_probe_sweep": probe_sweep, "f11_coverage_choice": coverage_choice, "i12_i13_depth_sweep": depth_sweep, "i6_i7_global_rerank": global_rerank, "b19_i10_projected_search": projected_ranking,
}
SQL = {
    "b2_unit_vectors": UNIT_LONG, "d6_mean_vector": MEAN_LONG, "i1_residuals": RESIDUAL_LONG, "b12_hadamard": HADAMARD_LONG, "b13_b14_rotation": ROTATED_LONG,
    "b20_augmented": AUGMENTED_LONG, "i3_lloyd_step": LLOYD_LONG, "i4_c5_assignments": ASSIGNED, "d7_offsets": OFFSETS, "i5_d8_d9_probe_trace": TRACE,
    "i8_ivf_exact": IVF_EXACT, "i9_c4_exact_top10": EXACT, "i5_ivf_recall": RECALL, "b18_cell_keys": CELL_KEYS, "i11_local_vectors": LOCAL_LONG,
    "e2_compartment_local": COMPARTMENT_LOCAL, "i12_i7_compartment_ranking": COMPARTMENT, "e4_k8_interleaved": INTERLEAVED, "a7_index_files": CENTROID_FILES,
    "k6_neighbourhood_recall": NEIGHBOURHOOD, "j17_probe_sweep": PROBE_SWEEP, "f11_coverage_choice": COVERAGE, "i12_i13_depth_sweep": DEPTH_SWEEP,
}
