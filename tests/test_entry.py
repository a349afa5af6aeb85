"""Driver contract and a sample of registered queries against their DuckDB twins."""
import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "pages events documents benchmark".split()
NO_ORACLE = set()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["domain", "n_links", "first_url"]
    assert df.count() > 0


def test_every_query_has_oracle_or_is_listed():
    assert set(E.queries()) - set(E.oracle_sql()) - set(E.LLM_QUERIES) == NO_ORACLE
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["link_host_counts", "dedup_verdicts", "documents", "expand_bfs",
                                  "retry_queue", "registrable_domains", "keyword_join", "harvest"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    s = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    idx = [rel.columns.index(c) for c in cols]
    d = sorted(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert s == d
