"""Every registered query against its SQL on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from daygrain.testbed.oracle import ORACLE
from daygrain.testbed.queries import QUERIES
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 30
    for r in rows:
        assert 0 <= r.participation_rate <= 1
        # the three metrics belong together up to the rounding of the registered query
        assert r.weighted_minutes == pytest.approx(r.participation_rate * r.minutes_per_participant, abs=1e-4)


def test_entry_without_an_optional_dependency():
    """With a module missing that only the optional package needs, all other queries are there."""
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    assert out.split() == [str(len(QUERIES)), str(len(ORACLE))]
