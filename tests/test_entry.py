"""The registered queries against DuckDB on the driver's smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
NAMES = ["suggest_hot_cold", "corpus_build", "ingest_counts", "skip_index", "fuzzy_infix", "ledger_windows", "promotion_plan", "lru_replay", "cache_stats", "cache_entries", "index_seek", "corpus_diff", "route_percentiles", "project_overview"]
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query", "rank", "word", "source"] and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_against_duckdb(spark, duck, name):
    got = entry.queries()[name](spark, str(SF))
    rel = duck.sql(entry.oracle_sql()[name])
    cols = sorted(rel.columns)
    assert sorted(got.columns) == cols
    plain = lambda rows: sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)
    want = rel.select(*[f'"{c}"' for c in cols]).fetchall()
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(want)
