"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracles

from lullmap.bindings import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return check_oracles.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    assert check_oracles.compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf) is None


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
