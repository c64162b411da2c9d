"""Compare a query's rows with those of its SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is not None, str(round(v, 3) + 0.0) if isinstance(v, float) else str(v)) for v in row)


def differences(df, con, sql: str, near: float = 0.0) -> list:
    """Rows that differ, at most five; rounded numbers must be the same ones."""
    names = sorted(df.columns)
    mine = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)
    got = con.execute(sql)
    cols = [c[0] for c in got.description]
    if sorted(cols) != names:
        return [("columns", sorted(cols), names)]
    at = [cols.index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=_key)
    if len(mine) != len(theirs):
        return [("rows", len(mine), len(theirs))]

    def same(a, b) -> bool:
        if isinstance(a, float) or isinstance(b, float):
            return a is not None and b is not None and math.isclose(float(a), float(b), rel_tol=0.0, abs_tol=near)
        return a == b

    return [(a, b) for a, b in zip(mine, theirs, strict=True) if not all(map(same, a, b))][:5]
