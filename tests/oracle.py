"""Runs a query on Spark and its SQL on DuckDB, and compares the rows."""

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    return repr(v)


def both(spark, run, sql):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = run(spark, SF)
    names = sorted(df.columns)
    ours = sorted([_plain(r[n]) for n in names] for r in df.collect())
    found = c.execute(sql)
    theirs_names = [d[0] for d in found.description]
    assert sorted(theirs_names) == names
    theirs = sorted([_plain(r[theirs_names.index(n)]) for n in names] for r in found.fetchall())
    return ours, theirs
