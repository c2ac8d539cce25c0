"""Every registered query against its DuckDB oracle, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from tests import oracle
from varve.plans import registry

# Results that are empty on the smallest tables, by the data.
EMPTY = {"tpch_q07", "tpch_q11", "tpch_q22"}


@pytest.fixture(scope="module")
def con(tiny):
    return oracle.connect(tiny)


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["nation", "order_year", "orders", "quantity", "net_revenue"]
    assert df.count() > 100


def test_entry_without_the_optional_package(tmp_path):
    """The entry imports from a tree that lacks the package and its tests."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(driver.__file__))
    shutil.copytree(root, tmp_path / "tree", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    run = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"],
        cwd=tmp_path / "tree", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True,
    )
    assert run.stdout.split() == [str(len(registry.QUERIES)), "False"], run.stderr


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(registry.QUERIES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, tiny, con, name):
    df = driver.queries()[name](spark, tiny)
    sql = driver.oracle_sql().get(name)
    rows = df.count() if sql is None else oracle.assert_same(df, con, sql)
    assert rows > 0 or name in EMPTY
