"""Runs a query and its SQL side by side and compares rows without order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def differences(spark, function, sql: str, sf_dir: str) -> list:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df = function(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(str(_plain(r[c])) for c in columns) for r in df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(_plain(r[names.index(c)])) for c in columns) for r in cursor.fetchall())
    assert len(got) == len(want)
    return [(a, b) for a, b in zip(got, want, strict=True) if a != b]
