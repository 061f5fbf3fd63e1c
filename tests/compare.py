"""A query's rows in Spark and in DuckDB."""

import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return [_plain(x) for x in v] if isinstance(v, list | tuple) else v


def both(spark, query, sql, folder):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        path = os.path.join(folder, f) + ("/*.parquet" if os.path.isdir(os.path.join(folder, f)) else "")
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{path}')")
    df = query(spark, folder)
    names = sorted(df.columns)
    rel = con.execute(sql)
    theirs = [c[0] for c in rel.description]
    assert sorted(theirs) == names
    ours = sorted(repr([_plain(r[c]) for c in names]) for r in df.collect())
    return ours, sorted(repr([_plain(r[theirs.index(c)]) for c in names]) for r in rel.fetchall())
