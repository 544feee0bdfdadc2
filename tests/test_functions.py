import hashlib
import hmac
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.functions import keyed
from larkspan.functions.text import clean_key, token_count, tokens
from larkspan.functions.vector import hadamard


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("key", "message", "digest"),
    [  # RFC 4231, cases 1, 2 and 6
        (b"\x0b" * 20, b"Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
        (b"Jefe", b"what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
        (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
    ],
)
def test_hmac(spark, key, message, digest):
    assert one(spark, keyed.hmac_hex(F.lit(bytearray(message)), key)) == digest


def test_keyed_features(spark):
    label = keyed.keyed_term(F.lit("apple"), b"k")
    expected = hmac.new(b"k", b"apple", hashlib.sha256).hexdigest()[:32]
    assert one(spark, label) == expected
    digest = hmac.new(b"f", expected.encode(), hashlib.sha256).digest()
    assert one(spark, keyed.hash_coordinate(label, b"f", 1000)) == int.from_bytes(digest[:8], "big") % 1000
    assert one(spark, keyed.hash_sign(label, b"f")) == (1 if digest[8] & 1 else -1)
    cell = hmac.new(b"k", b"tag" + (300).to_bytes(4, "big"), hashlib.sha256).hexdigest()[:32]
    assert one(spark, keyed.cell_label(F.lit(300), b"k", b"tag")) == cell
    assert one(spark, keyed.in_half(F.lit("q1"), "outer")) == bool(hashlib.sha256(b"outer:q1").digest()[0] & 1)


def test_tokens(spark):
    assert one(spark, tokens(F.lit("Éa STRASSEß 1"))) == ["a", "strasse", "1"]
    assert one(spark, tokens(F.lit(""))) == [] and one(spark, tokens(F.lit(None).cast("string"))) == []
    long = "Word-1 " * 50_000
    assert one(spark, token_count(F.lit(long))) == 100_000
    assert one(spark, clean_key(F.lit("\t Wiki \n"))) == "wiki"


def test_hadamard(spark):
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(8)] for i in range(8)]) / math.sqrt(8)
    got = one(spark, hadamard(F.array(*[F.lit(float(i)) for i in range(1, 9)]), 8))
    assert np.allclose(got, h @ np.arange(1, 9))
    with pytest.raises(ValueError):
        hadamard(F.col("x"), 6)


def test_uniform_and_normal(spark):
    rows = spark.range(4000).select(keyed.hash_uniform(F.lit("s"), F.col("id")).alias("u"), keyed.hash_normal(F.lit("s"), F.col("id")).alias("z")).toPandas()
    assert abs(rows["u"].mean() - 0.5) < 0.03 and abs(rows["z"].mean()) < 0.06 and abs(rows["z"].std() - 1) < 0.06
