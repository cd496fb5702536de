"""Runs a query on Spark and its SQL on DuckDB, over the same tables, and compares names and values without order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _value(x):
    if isinstance(x, float):
        return None if x != x else float(f"{x:.12g}") + 0.0  # values of one digit more than a query rounds to stay apart; the last bits of a double don't
    return int(x) if type(x).__name__ in ("Decimal", "bool") else x


def rows(found, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_value(r[k]) for k in order) for r in found), key=repr)


def compare(df, con, sql):
    got, names = df.collect(), df.columns
    cur = con.execute(sql)
    theirs = [c[0] for c in cur.description]
    assert sorted(names) == sorted(theirs), (sorted(names), sorted(theirs))
    a, b = rows(got, names), rows(cur.fetchall(), theirs)
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b):
        assert x == y, (x, y)
    return len(a)
