"""Compare a query with its SQL as the same rows in any order."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        name, path = f.removesuffix(".parquet"), f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, dict):
        return str(sorted((plain(k), plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def difference(spark, con, query, sql, sf_dir):
    """An empty string if both give the same."""
    df = query(spark, sf_dir)
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in out.fetchall())
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    if got != want:
        a, b = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return f"{order}: {len(got)} and {len(want)} rows; only Spark {a[:2]}; only SQL {b[:2]}"
    return ""
