"""Runs a query and its SQL on the same Parquet tables."""

from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or v != v:
            return ""
        if isinstance(v, float):
            return f"{v:.6g}"
        return str(bytes(v)) if isinstance(v, (bytes, bytearray)) else str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def sql(text, sf=SF):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cur = con.execute(text)
    return canon([c[0] for c in cur.description], cur.fetchall())


def spark_rows(df):
    return canon(df.columns, [tuple(r.asDict(True).values()) for r in df.collect()])
