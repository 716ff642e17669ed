"""A query beside its SQL, run by DuckDB over the same files."""

import glob
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def duck(sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def plain(value):
    if value is None or isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return "nan" if isinstance(value, float) and math.isnan(value) else f"{float(value):.6f}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([plain(r[i]) for i in order] for r in rows)


def same(spark, query, sql):
    df = query(spark, SF)
    ours = rows_of(df.columns, df.collect())
    theirs = rows_of(*duck(sql))
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
