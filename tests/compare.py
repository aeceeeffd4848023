"""Spark rows and DuckDB rows of one query, in a form that can be compared."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def tidy(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if isinstance(v, float):
            return None if v != v else round(v, 5) + 0.0
        return v

    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


def kinds(names, types):
    same = {"bigint": "long", "double": "double", "varchar": "string", "string": "string", "boolean": "boolean"}
    return sorted((n, same.get(str(t).lower(), str(t).lower())) for n, t in zip(names, types, strict=True))


def differences(spark, con, sf, name, query, sql):
    df = query(spark, sf)
    got = tidy([tuple(r) for r in df.collect()], df.columns)
    found = con.sql(sql)
    want = tidy(found.fetchall(), found.columns)
    if sorted(df.columns) != sorted(found.columns):
        return f"columns {sorted(df.columns)} {sorted(found.columns)}"
    if (a := kinds(df.columns, [t for _, t in df.dtypes])) != (b := kinds(found.columns, found.types)):
        return f"types {[x for x in zip(a, b) if x[0] != x[1]]}"
    if got != want:
        only = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        return f"{len(got)} and {len(want)} rows; only one side: {only}"
    return ""
