"""Side-by-side run of a registered query and its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}") + 0.0
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=_key)


def differences(spark_df, con, sql) -> str | None:
    """None when names, kinds and values agree."""
    cur = con.execute(sql)
    want_cols, want = table_of([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = table_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first {got[:2]} / {want[:2]}"
    for a, b in zip(got, want):
        for c, x, y in zip(got_cols, a, b):
            if type(x) is not type(y) and not (x is None or y is None):
                return f"kind of {c}: {type(x).__name__} != {type(y).__name__} ({x!r} / {y!r})"
            if x != y:
                return f"{c}: {x!r} != {y!r} in {a} / {b}"
    return None
