"""Query results against the DuckDB oracle, as sorted rows."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return v


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=_key)


def oracle_rows(text, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(text)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    rows = found.fetchall()
    return columns, sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in rows), key=_key)
