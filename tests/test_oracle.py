"""Every registered query against its SQL at the smallest scale."""

import pytest

from compare import compare, connect
from frames import SMALL
from quorumbook.catalog.oracle import ORACLE
from quorumbook.catalog.queries import REGISTRY


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    ok, text = compare(spark, con, SMALL, REGISTRY[name], ORACLE[name])
    assert ok, text


def test_every_query_is_checked_somewhere():
    assert set(ORACLE) == set(REGISTRY)
