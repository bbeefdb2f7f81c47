"""Queries that SQL can express, against SQL."""

from __future__ import annotations

import pytest
from oracle import answers, connect

from sondeflow.llm.oracle import ORACLE
from sondeflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    mine, wanted = answers(QUERIES[name](spark, SF), connect(SF), ORACLE[name])
    assert mine == wanted


def test_there_is_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, len(numbers) + 1))
