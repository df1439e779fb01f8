"""Rows of a query and of its SQL, made comparable."""

import glob
import math

import duckdb


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "~" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def rows_of(df, columns):
    return sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(sql, sf_dir):
    c = duckdb.connect()
    for t in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {t.split('/')[-1][:-8]} AS SELECT * FROM '{t}'")
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    columns = sorted(names)
    at = [names.index(x) for x in columns]
    return columns, sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
