"""Every registered query against its SQL on the smallest tables."""

import pathlib

import pytest

from check_oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables")

import __spark_entry__ as entry  # noqa: E402


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, FOLDER, entry.queries(), entry.oracle_sql())
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
