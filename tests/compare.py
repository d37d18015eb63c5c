"""Runs a Spark query and its SQL side by side."""

from __future__ import annotations

import glob
import math
import os

import duckdb

DUCK_TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "DATE": "date",
    "BOOLEAN": "boolean",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def difference(df, con, sql: str) -> str | None:
    """What differs between a DataFrame and a SQL result, None if nothing."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} != {sorted(rel.columns)}"
    kinds = dict(zip(rel.columns, [str(t) for t in rel.types], strict=True))
    spark_kinds = dict(df.dtypes)
    off = {
        n: (spark_kinds[n], kinds[n]) for n in names if DUCK_TYPES.get(kinds[n]) != spark_kinds[n]
    }
    order = [rel.columns.index(n) for n in names]
    expected = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=_key)
    got = sorted((tuple(r) for r in df.select(names).collect()), key=_key)
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}"
    if got != expected:
        bad = [(g, e) for g, e in zip(got, expected, strict=True) if g != e]
        close = all(
            a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=2e-6))
            for g, e in bad
            for a, b in zip(g, e, strict=True)
        )
        return f"{len(bad)} rows differ{' (rounding only)' if close else ''}: {names} {bad[0]}"
    return f"types {off}" if off else None
