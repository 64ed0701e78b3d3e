"""Registered queries against their SQL, and the plans that the native operators promise."""

import io
from contextlib import redirect_stdout

import pytest

from compare import compare, connect
from quorumbook.llm.queries import QUERIES
from quorumbook.llm.sql import ORACLE

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    ok, text = compare(spark, connect(SMALL), SMALL, QUERIES[name], ORACLE[name])
    assert ok, text


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op9_feistel_pseudonyms"])
def test_native_queries_run_no_python(spark, name):
    out = io.StringIO()
    with redirect_stdout(out):
        QUERIES[name](spark, SMALL).explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue() and "Pandas" not in out.getvalue()


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
