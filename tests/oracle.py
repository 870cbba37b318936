"""Runs a query and its oracle and compares rows, columns and values, whatever their order."""

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def compare(spark, query, sql, sf_dir, con=None):
    df = query(spark, sf_dir)
    got_cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in got_cols) for r in df.collect())
    cur = (con or duck(sf_dir)).execute(sql)
    names = [x[0] for x in cur.description]
    order = [names.index(c) for c in sorted(names)]
    want = Counter(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
    assert got_cols == sorted(names), (got_cols, sorted(names))
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        raise AssertionError(f"rows {sum(got.values())} vs {sum(want.values())}; extra {extra}; missing {missing}; columns {got_cols}")
