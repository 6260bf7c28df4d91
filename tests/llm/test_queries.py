"""The registered queries against their SQL on a whole small table."""

import pytest

from quillmap.llm.queries import ORACLES, QUERIES
from tests.oracle import of_duckdb, of_spark


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, name):
    assert of_spark(QUERIES[name](spark, small)) == of_duckdb(small, ORACLES[name])


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
