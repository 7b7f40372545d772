"""Runs a query and its SQL on the same tables and compares rows without order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return ("", "")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, float):
        return ("n", "nan" if math.isnan(v) else f"{v:.9g}")
    if isinstance(v, int):
        return ("n", f"{v:.9g}" if abs(v) < 1e9 else str(v))
    if isinstance(v, (list, tuple)):
        return ("l", str([plain(x) for x in v]))
    return ("s", str(v))


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def same(df, sql, sf_dir):
    names, rows = oracle(sql, sf_dir)
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    order = sorted(names)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in rows)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    for a, b in zip(mine, theirs, strict=True):
        assert a == b, (order, a, b)
