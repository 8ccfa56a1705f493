"""Registered queries against their oracle SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from foliary.plans import all_queries

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["t7_same_entity", "l4_ledger_rows", "d3_apply_decisions", "u5_compare_runs", "h2_span_issues"]


def test_every_oracle_has_a_query():
    queries, oracles = all_queries()
    assert set(oracles) <= set(queries)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    if not Path(FOLDER).exists():
        pytest.skip("no tables")
    queries, oracles = all_queries()
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    got = queries[name](spark, FOLDER).select(*names).collect()
    tidy = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert tidy(got) == tidy(cur.fetchall())
