"""Every registered query runs and equals its oracle SQL in DuckDB."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import check
from workload import registry

registry.load_all()


LARGER = "/root/testdata/sf0.01"


def connect(sf):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    if name not in registry.ORACLES:
        assert df.columns and df.count() >= 0
        return
    found = check.compare(df, con.sql(registry.ORACLES[name]))
    if found == "EMPTY":  # an empty result proves nothing: compare on more rows
        found = check.compare(registry.QUERIES[name](spark, LARGER), connect(LARGER).sql(registry.ORACLES[name]))
    assert found is None


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_package(tmp_path):
    """The other queries are there where that package and its pipeline are not."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("tidemark", "workload", "__spark_entry__.py"):
        source, target = os.path.join(root, name), str(tmp_path / name)
        if os.path.isdir(source):
            shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, target)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.stdout.split() == [str(len(registry.QUERIES)), "False"], run.stderr


def test_every_survey_row_has_a_query():
    covered = {n for ops in registry.OPERATORS.values() for n in ops}
    assert not set(range(1, 257)) - covered


def test_the_whole_suite_collects_in_one_command():
    """Modules of both test folders load in one run, with and without the training package's tests."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for extra in ([], ["--ignore=tests/llm"]):
        run = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", *extra], cwd=root,
                             capture_output=True, text=True, timeout=300)
        assert run.returncode == 0 and "error" not in run.stdout.splitlines()[-1], run.stdout[-2000:]
