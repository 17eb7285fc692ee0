"""Every query has a stable schema; a few run end to end against their SQL."""

import os

import pytest

import catalog

DATA = "/root/testdata/sf0.001"


def test_names_and_oracles():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 150


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", ["track_speeds", "carry_cutoff", "score_pairs", "clip_diverse_sample", "build_pool", "qc_summary"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = con.execute(catalog.ORACLE[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in cur.fetchall())
