"""Compares a registered query with its DuckDB SQL."""

import duckdb

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def differences(spark, run, sql, sf_dir=SF_DIR):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(map(plain, r))) for r in df.select(*cols).collect())
    theirs = con.sql(sql)
    assert sorted(theirs.columns) == cols
    at = [theirs.columns.index(c) for c in cols]
    other = sorted(repr(tuple(plain(r[i]) for i in at)) for r in theirs.fetchall())
    one, two = set(mine), set(other)
    return [x for x in mine if x not in two][:3], [x for x in other if x not in one][:3], len(mine), len(other)
