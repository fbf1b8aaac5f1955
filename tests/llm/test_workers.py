"""Workers need no copy of the package: functions travel by value, broadcasts hold plain data."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {root!r})  # the driver alone
from tidemark.session import build_session
from tidemark.llm import queries
spark = build_session("workers", 4, 4)


def look(_):
    try:
        import tidemark
    except ModuleNotFoundError:
        yield "none"


assert spark.sparkContext.parallelize([0], 1).mapPartitions(look).collect() == ["none"]
for name, run in queries.QUERIES.items():
    if name != "pipeline":
        print(name.split("_")[0], run(spark, {sf!r}).count(), flush=True)
"""


def test_queries_where_workers_lack_the_package(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert [line.split()[0] for line in run.stdout.splitlines()] == [f"op{n}" for n in range(1, 14)], run.stderr[-3000:]
