"""A query's rows beside those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = c.sql(sql)
    return found.columns, found.fetchall()


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda v: (v is None, str(type(v)), -math.inf if isinstance(v, float) and math.isnan(v) else v)
    return [columns[i] for i in order], sorted([tuple(r[i] for i in order) for r in rows], key=lambda r: [repr(key(v)) for v in r])
