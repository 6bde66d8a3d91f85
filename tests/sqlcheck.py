"""Compare a query's rows with those of its SQL in DuckDB on the same tables."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def connection():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def same(spark, query, sql):
    df = query(spark, SF)
    found = connection().execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    expected = sorted((tuple(r[names.index(c)] for c in order) for r in found.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=key) == expected
