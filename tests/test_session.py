"""The scratch space: where it lies, and that nothing stays there."""

import os
import subprocess
import sys

import pytest

from larkspan import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import os, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import functions as F
from larkspan.session import discard, local_session, materialise
spark = local_session("2", 2, spark__checkpoint__dir="file://" + sys.argv[2])
kept, gone = materialise(spark.range(10)), materialise(spark.range(5))
discard(gone)
try:
    materialise(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")))
except Exception:
    pass
print(kept.count(), sum(n.startswith("larkspan-") for n in os.listdir(sys.argv[2])) >= 1)
"""


def test_scratch_tables_go_with_the_driver(tmp_path):
    run = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, str(tmp_path)], capture_output=True, text=True, timeout=300)
    assert run.stdout.split() == ["10", "True"], run.stderr[-2000:]
    assert [n for n in os.listdir(tmp_path) if n.startswith("larkspan-")] == []


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Elsewhere)
    assert session.scratch_root(spark) == session.scratch_root(spark)
