"""Registered queries against their SQL on the smallest tables.

Every query with SQL is compared.
``python tests/oracle.py`` compares every query at sf0.01.
"""

import os

import pytest

from pacelane import plans
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(plans.ORACLE)



@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    verdict = compare(plans.QUERIES[name](spark, FOLDER), con, plans.ORACLE[name])
    assert verdict in ("", "both empty")


def test_names_are_plain():
    assert not [n for n in plans.QUERIES if n == "pipeline" or n.startswith("op")]
