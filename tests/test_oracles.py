"""Every registered query with SQL equals DuckDB on the smallest tables; the others give rows."""

import os

import pytest

import __spark_entry__ as entry
import check
from pagelore.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
LIBRARY = catalogue.queries()
NAMES = list(LIBRARY) if os.environ.get("FULL_ORACLES") else [n for n in LIBRARY if n.split("_")[1] in ("01", "06", "10", "12")]


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    ok, got, want = check.compare(spark, duck, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert ok is not False, (got[0], want[0], set(got[1]) ^ set(want[1]))
    if ok is None:
        assert got[1]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
