"""Compare a query with its SQL on DuckDB, without regard to row order."""

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return round(float(v), 5) if isinstance(v, Decimal) else v


def same_rows(df, con, sql):
    names = sorted(df.columns)
    cursor = con.execute(sql)
    theirs = [c[0] for c in cursor.description]
    assert sorted(theirs) == names
    mine = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)
    other = sorted((tuple(_plain(r[theirs.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
    assert mine == other
