import json

import pytest
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import functions as F

from larkspan.operators.learning import fit_ranker
from larkspan.sources import readers, writers
from larkspan.streaming import postings


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "qrels").mkdir()
    records = [{"_id": "a", "title": "T", "text": "x y"}, {"_id": "b", "text": None}, {"_id": "c", "title": "Z", "text": "y y"}]
    (tmp_path / "corpus.jsonl").write_text("\n".join(map(json.dumps, records)))
    (tmp_path / "queries.jsonl").write_text("\n".join(map(json.dumps, [{"_id": "q1", "text": "x"}, {"_id": "q2", "text": "y"}])))
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\ta\t2\nq1\tb\t0\nq1\ta\t2\n")
    (tmp_path / "ids.txt").write_text("a\nb\nc\n")
    return tmp_path


def test_collection(spark, folder):
    records, queries, judged = readers.collection(spark, str(folder), "test")
    assert sorted(map(tuple, records.collect())) == [("a", "T", "x y"), ("b", "", ""), ("c", "Z", "y y")]
    assert [r["query_id"] for r in queries.collect()] == ["q1"]
    assert sorted(map(tuple, judged.collect())) == [("q1", "a", 2), ("q1", "b", 0)]
    assert [r["doc_id"] for r in readers.relevant_items(judged).collect()] == ["a"]
    ids = readers.manifest(spark, str(folder / "ids.txt"))
    assert sorted(map(tuple, ids.collect())) == [(0, "a"), (1, "b"), (2, "c")]
    assert {r["_id"]: r["doc_idx"] for r in readers.numbered(records, ids).collect()} == {"a": 0, "b": 1, "c": 2}
    kept = readers.subset(readers.numbered(records, ids), spark.createDataFrame([("c",)], "_id string"), 2, "_id", "doc_idx")
    assert {r["_id"] for r in kept.collect()} == {"a", "c"}
    with pytest.raises(ValueError):
        readers.subset(records, records, 1, "_id", "_id")
    assert readers.misaligned(records, records, ["_id"]).count() == 0
    assert readers.misaligned(records, records.filter("_id <> 'a'"), ["_id"]).collect()[0]["side"] == "left"


def test_broken_lines_fail_and_are_told(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"_id": "a", "title": "x"}\n{"_id": "b", "tit\n{"_id": "c"}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.records(spark, str(path)).collect()
    told = readers.broken_lines(spark, str(path), readers.RECORD).collect()
    assert [r["line"] for r in told] == ['{"_id": "b", "tit'] and told[0]["file"].endswith("r.jsonl")


def test_manifest_of_many_parts(spark, tmp_path):
    """Lines keep the order of the file, and files that of their names, however the reader cuts them."""
    (tmp_path / "a.txt").write_text("".join(f"line {i} of the first file\n" for i in range(5000)))
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(100)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = sorted(map(tuple, readers.manifest(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate([f"line {i} of the first file" for i in range(5000)] + [f"b{i}" for i in range(100)]))


def test_subset_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(readers, "ROWS_PER_BUCKET", 100)
    rows = spark.range(1000).select(F.col("id").alias("item"), (F.lit(5000) - F.col("id") * 2).cast("int").alias("no"), F.lit(1).alias("_range"))
    rows = rows.unionAll(spark.createDataFrame([(2000, None, 1)], "item bigint, no int, _range int"))
    kept = readers.subset(rows.drop("_range"), spark.createDataFrame([(3,), (2000,)], "item bigint"), 402, "item", "no")
    assert {r["item"] for r in kept.collect()} == {3, 2000} | set(range(600, 1000))


def test_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.parts(spark, path) == ([], f"{path}/part-00000001")
    spark.range(3).write.parquet(writers.parts(spark, path)[1])
    (tmp_path / "t/part-00000007").mkdir()
    assert writers.parts(spark, path) == ([f"{path}/part-00000001"], f"{path}/part-00000008")


def test_varint(spark):
    from larkspan.plans.stores import varint

    numbers = [0, 1, 127, 128, 500, 16383, 16384, 2097151, 2097152, 2**28 - 1]
    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", readers.leading_varint(varint(F.col("n"))).alias("v")).collect()
    assert all(r["n"] == r["v"] for r in rows)
    for blob, value in ((b"\x05", 5), (b"\x81\x00", 128), (b"\x83\x74\xff", 500), (b"", None)):
        assert spark.range(1).select(readers.leading_varint(F.lit(bytearray(blob))).alias("v")).first()["v"] == value


def test_writers(spark, tmp_path):
    rows = spark.range(5).withColumn("cell", F.col("id") % 2)
    writers.report(rows.limit(1), str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()[0])["cell"] == 0
    back = writers.stored(rows, str(tmp_path / "t"), ["cell"])
    assert back.filter("cell = 1").count() == 2 and (tmp_path / "t/cell=1").exists()
    made = []
    build = lambda: made.append(1) or rows
    for _ in range(2):
        assert writers.resumable(spark, str(tmp_path / "s"), {"r": 16}, build).count() == 5
    assert len(made) == 1
    writers.resumable(spark, str(tmp_path / "s"), {"r": 32}, build)
    assert len(made) == 2
    train = spark.createDataFrame([(float(i % 2), float(i % 2), 1.0) for i in range(100)], "label double, f double, weight double")
    model = fit_ranker(train, ["f"], rounds=2)
    writers.save_model(model, str(tmp_path / "m"))
    assert writers.load_model(GBTClassificationModel, str(tmp_path / "m")).getNumTrees == 2


def test_stream(spark, folder, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "1.json").write_text((folder / "corpus.jsonl").read_text())
    for extra in (None, {"_id": "d", "title": "", "text": "x"}):
        if extra:
            (source / "2.json").write_text(json.dumps(extra))
        stream = postings.record_stream(spark, str(source), readers.RECORD)
        postings.append_postings(stream, out, str(tmp_path / "check")).awaitTermination()
    got = sorted((r["doc_id"], r["term"], r["tf"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", "t", 1), ("a", "x", 1), ("a", "y", 1), ("c", "y", 2), ("c", "z", 1), ("d", "x", 1)]


def test_frequencies_by_window(spark, tmp_path):
    """Counts per hour and key; a row that comes later than the watermark allows is left out."""
    source = tmp_path / "in"
    source.mkdir()
    day = "2026-01-01T"
    deliveries = [[("a", "00:10"), ("a", "00:50"), ("b", "00:20")], [("a", "05:00")], [("b", "00:30"), ("a", "04:59"), ("b", "05:10")]]
    for i, rows in enumerate(deliveries):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"key": k, "at": f"{day}{t}:00Z"}) for k, t in rows))
        stream = spark.readStream.schema("key string, at timestamp").option("maxFilesPerTrigger", 1).json(str(source))
        counts = postings.frequencies_by_window(stream, "at", "1 hour", "2 hours", "key").selectExpr("hour(window.start) AS h", "key", "n")
        out = counts.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        out.trigger(availableNow=True).start().awaitTermination()
    (source / "9.json").write_text(json.dumps({"key": "z", "at": "2026-01-03T00:00:00Z"}))  # moves the watermark on
    out.trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [(0, "a", 2), (0, "b", 1), (4, "a", 1), (5, "a", 1), (5, "b", 1)]
