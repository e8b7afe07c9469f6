"""Named queries against DuckDB on the smallest given tables.

A few by default; PACKETLOOM_ALL=1 runs every query that has SQL.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = ("flagship_top_sources", "scalar_dga", "flow_stats", "host_windows_src", "session_combined", "rtt_handshake", "profile_new_flags", "clean_clip_outliers", "source_malformed", "source_intel", "stream_on_time")
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("PACKETLOOM_ALL") else FEW)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(row[names.index(c)] for c in columns) for row in result.fetchall()), key=str)
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(entry.queries())
