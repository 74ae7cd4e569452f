"""Compares a query's rows with those of its SQL."""

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def canon(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in v.items()) + "}"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(canon, v)) + "]"
    if v is None or v != v:
        return "NULL"
    return f"{v:.7g}" if isinstance(v, float) else str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(canon(r[k]) for k in names) for r in df.collect())


def sql_rows(c, sql):
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[k] for k in order], sorted(tuple(canon(r[k]) for k in order) for r in found.fetchall())
