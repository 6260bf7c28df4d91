import pytest

from quillmap.plans.queries import ORACLES, QUERIES

from .oracle import of_duckdb, of_spark


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, name):
    assert of_spark(QUERIES[name](spark, small)) == of_duckdb(small, ORACLES[name])


def test_hostile_documents_never_raise(spark, small):
    rows = QUERIES["hostile_documents"](spark, small).collect()
    assert len(rows) == 200
    assert all(r["dialect"] == "mybatis" for r in rows)
    assert all(r["n_diagnostics"] > 0 for r in rows if r["doc_id"] % 2)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
