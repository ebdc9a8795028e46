"""Runs a query and its SQL and compares the rows, columns in order of their names."""

import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir=SF):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def compare(df, sql, c):
    got_columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*got_columns).collect()), key=repr)
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    assert [names[k] for k in order] == got_columns, (names, got_columns)
    want = sorted((tuple(plain(r[k]) for k in order) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, (len(bad), bad[:3])
