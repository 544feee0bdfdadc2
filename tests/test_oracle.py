"""Every core query with an SQL twin gives the same rows at the smallest scale."""

import os

import oracle
import pytest

from larkspan.plans.registry import collected

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = collected()


@pytest.fixture(scope="module")
def duck():
    return oracle.connection(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    assert oracle.compare(QUERIES[name](spark, FOLDER), duck, SQL[name]) == ""


def test_all_others_are_checked_by_value():
    import test_values

    assert set(QUERIES) - set(SQL) == set(test_values.CHECKED)
