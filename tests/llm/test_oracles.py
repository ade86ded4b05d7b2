"""The queries that SQL can express, on the smallest tables."""

import pytest

from compare import oracle_rows, rows_of
from depweave.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, sf_dir, duck):
    assert rows_of(QUERIES[name](spark, sf_dir)) == oracle_rows(duck, ORACLES[name])
