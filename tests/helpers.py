"""Comparison of a Spark result with its SQL twin."""

import glob
import os

import duckdb

BASE = "/root/testdata/sf0.001"


def database(base=BASE):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in glob.glob(base + "/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(table):
    """Rows as comparable text, columns by name."""
    d = table.to_pydict()
    names = sorted(d)

    def text(v):
        if v is None or v != v:
            return "-"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v) + 0.0:.12g}"
        return str(v)

    return names, sorted("|".join(text(d[n][i]) for n in names) for i in range(table.num_rows))
