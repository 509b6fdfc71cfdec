"""Runs a query's SQL in DuckDB over the same Parquet tables and compares the bags of rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def norm(rows, cols, order):
    idx = [cols.index(c) for c in order]

    def one(v):
        return (0.0 if v == 0 else v) if isinstance(v, float) else v

    return sorted((tuple(one(r[i]) for i in idx) for r in rows), key=repr)


def same(spark_df, con, sql):
    order = sorted(spark_df.columns)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == order, (sorted(cols), order)
    want = norm(cur.fetchall(), cols, order)
    got = norm([tuple(r) for r in spark_df.collect()], spark_df.columns, order)
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, [(a, b) for a, b in zip(got, want) if a != b][:5]
