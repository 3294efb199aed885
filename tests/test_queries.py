"""Every registered query against the SQL that states the same."""

import math

import duckdb
import pytest

from estuary.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    return repr(float(value) + 0.0) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*sorted(got.columns)).collect())
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows == sorted(tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in sorted(want.columns)]).fetchall())
    else:
        assert rows


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["book_replay", "replay_coverage"])
def test_equal_times_are_replayed_as_they_are_numbered(spark, tmp_path, name):
    con = duckdb.connect()
    con.sql(f"copy (select * replace (event_id + 100000 * k as event_id) from '{SF}/events.parquet', range(7) t(k)) to '{tmp_path}/events.parquet'")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(tuple(map(plain, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in want.select(*columns).fetchall())
