"""Run a query and its SQL on the same tables and compare columns, types by family, and rows."""

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, datetime.datetime) and v.tzinfo is None and v.time() == datetime.time(0):
        return str(v)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in data)


def difference(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = connection(sf_dir)
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return f"rows {len(got[1])} {len(want[1])}; only ours {sorted(a)[:2]}; only SQL's {sorted(b)[:2]}"
    kinds = {c: t for c, t in df.dtypes}
    for d in cur.description:
        k, s = kinds[d[0]], str(d[1]).upper()
        if ("INT" in s) != (k in ("int", "bigint", "smallint", "tinyint")) or ("DOUBLE" in s) != (k == "double") or (s in ("BIGINT", "INTEGER") and k != {"BIGINT": "bigint", "INTEGER": "int"}[s]):
            return f"type of {d[0]}: {k} {s}"
    return ""
