"""Compare a query with its SQL in DuckDB: same columns, same rows in any order."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    return repr(round(float(v), 5)) if isinstance(v, (float, np.floating)) else str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(_cell(v) for v in r) for r in frame[names].itertuples(index=False)), key=str)


def same(spark, query, sql, sf_dir):
    got, want = rows(query(spark, sf_dir).toPandas()), rows(connect(sf_dir).execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
