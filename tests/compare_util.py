"""Order-insensitive comparison of a Spark result with DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import duckdb

from sluice.sources.tables import TABLES


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        if v.tzinfo is not None:
            v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return int((v - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if hasattr(v, "item"):
        return v.item()
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


# Spark type -> DuckDB type of the same values.
TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
            "timestamp_ntz": "TIMESTAMP", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def compare(sdf, con, sql):
    """Return (ok, message): same column names and types, rows and values."""
    scols = sdf.columns
    stypes = {f.name: TYPE_MAP.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(sql)
    otypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    if sorted(scols) != sorted(ocols):
        return False, f"columns differ: {sorted(scols)} vs {sorted(ocols)}"
    if stypes != otypes:
        return False, f"types differ: {sorted(set(stypes.items()) ^ set(otypes.items()))}"
    if len(srows) != len(orows):
        return False, f"row count {len(srows)} vs {len(orows)}"
    sh, sl = digest(scols, srows)
    oh, ol = digest(ocols, orows)
    if sh != oh:
        diff = sorted(set(sl) - set(ol))[:3]
        return False, f"values differ, e.g. {diff}"
    return True, f"{len(srows)} rows"
