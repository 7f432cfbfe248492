"""What is registered as SQL of the training-data operators is SQL."""

from chronofold.llm import queries


def test_oracles_are_sql_of_registered_queries():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert all(isinstance(sql, str) for sql in queries.oracle_sql().values())
