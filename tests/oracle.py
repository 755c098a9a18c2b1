"""Comparing a query with its SQL, as sets of rows."""

import glob
import math
import os

import duckdb
import numpy as np

DATA = "/root/testdata/sf0.001"


def _value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating)):
        return round(float(x), 9) + 0.0
    return x


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in table), key=repr)


def of_duckdb(sql, folder=DATA, **tables):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name, frame in tables.items():
        con.register(f"{name}_given", frame)
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {name}_given")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return sorted(names), rows(names, got.fetchall())


def of_spark(df):
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])


def agree(df, sql, folder=DATA, **tables):
    got, want = of_spark(df), of_duckdb(sql, folder, **tables)
    assert got[0] == want[0]
    assert got[1] == want[1]
