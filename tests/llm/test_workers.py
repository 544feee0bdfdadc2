"""Every query runs where the workers lack the package: only its functions and plain data travel."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from larkspan.llm import queries
from larkspan.session import local_session
spark = local_session("8", 4)
def lacks(rows):
    import importlib.util
    yield from (importlib.util.find_spec("larkspan") is None for _ in rows)
assert spark.sparkContext.parallelize([1], 1).mapPartitions(lacks).collect() == [True]
for name, query in queries.QUERIES.items():
    df = query(spark, sys.argv[2])
    df.write.format("noop").mode("overwrite").save()
    print("ran", name, flush=True)
"""


def test_workers_without_the_package(tmp_path):
    from larkspan.llm import queries

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, FOLDER], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1800)
    assert run.returncode == 0, run.stderr[-3000:]
    assert {line.split()[1] for line in run.stdout.splitlines() if line.startswith("ran ")} == set(queries.QUERIES)
