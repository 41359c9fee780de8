"""Compare a Spark result with what DuckDB answers."""

from __future__ import annotations

import glob
import os

import duckdb


def _plain(x) -> str:
    if x is None:
        return "null"
    return f"{x:.10g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def sorted_rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_plain(r[i]) for i in order) for r in values)


def rows(df) -> list[tuple]:
    return sorted_rows(df.columns, df.collect())


def expected(sf_dir: str, sql: str) -> list[tuple]:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    done = db.execute(sql)
    return sorted_rows([d[0] for d in done.description], done.fetchall())
