"""The registered feature queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from chronofold import queries as engine

SF = "/root/testdata/sf0.001"
SQL = engine.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    got, want = engine.queries()[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = [sorted(df[columns].astype(str).replace({"<NA>": "nan", "None": "nan"}).values.tolist()) for df in (got, want)]
    assert rows[0] == rows[1]


#: The last bits of the deviation decide: taken in the order of the series by the running formula, it misses a distance that it equals.
TIES = [[-6, -6, -4, -4, -5], [-1, -2, 1, -8, 1, -8, 0, -7], [5, -4, -7, 1, 2, 4, 0, -1], [8, 6, 3, -9, 2, -3, 0, 9], [6, 0, 2, 3, 2, 7, 8]]


def test_distances_equal_to_the_deviation_match_sql(spark, tmp_path):
    """Also where Spark reads the rows in another order than that of the series."""
    name, c = "feat_ratio_beyond_r_sigma", duckdb.connect()
    c.execute("create table rows (user_id bigint, event_id bigint, value double)")
    c.executemany("insert into rows values (?, ?, ?)", [(u, i, x + 50) for u, series in enumerate(TIES) for i, x in enumerate(series)])
    c.execute("create view events as select *, 'a' as event_type, timestamp '2024-01-01' + to_seconds(event_id) as ts from rows")
    want = c.execute(SQL[name]).df().sort_values("user_id")
    for folder, order in (("up", "event_id"), ("down", "event_id DESC")):
        (tmp_path / folder).mkdir()
        c.execute(f"copy (select * from events order by user_id, {order}) to '{tmp_path}/{folder}/events.parquet'")
        got = engine.queries()[name](spark, f"{tmp_path}/{folder}").toPandas().sort_values("user_id")
        assert got.values.tolist() == want[list(got.columns)].values.tolist()
