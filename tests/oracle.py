"""Compares a query with its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def rounded(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(rounded, v)) if isinstance(v, list | tuple) else v


def agree(spark, query, sql, sf_dir=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = sorted((tuple(rounded(dict(zip(names, r, strict=True))[k]) for k in sorted(names)) for r in cur.fetchall()), key=str)
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(rounded(r[k]) for k in sorted(names)) for r in df.collect()), key=str)
    assert got == want
