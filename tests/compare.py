"""Compares queries with their SQL on DuckDB: names, types and values, in any order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differences(df, con, sql: str) -> list[str]:
    con.execute(f"CREATE OR REPLACE TEMP TABLE wanted AS {sql}")
    kinds = {r[0]: r[1] for r in con.execute("DESCRIBE wanted").fetchall()}
    own = {n: KINDS.get(k, k) for n, k in df.dtypes}
    if own != kinds:
        return [f"columns {own} and {kinds}"]
    names = sorted(own)
    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))
    quoted = ", ".join(f'"{n}"' for n in names)
    a, b = order(df.select(*names).collect()), order(con.execute(f"SELECT {quoted} FROM wanted").fetchall())
    if len(a) != len(b):
        return [f"{len(a)} rows and {len(b)}"]
    return [f"{x} and {y}" for x, y in zip(a, b, strict=True) if x != y][:3]
