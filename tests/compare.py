"""Run a query in Spark and its SQL in DuckDB and compare rows, columns and values."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path
from typing import Any

import duckdb


def value(v: Any) -> Any:
    """A value as both engines are compared: floats to 9 digits, lists and structs nested, NaN as null."""
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return int(v) if v.is_integer() else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    return v


def rows(data: list[dict[str, Any]]) -> Counter:
    return Counter(tuple((k, repr(value(r[k]))) for k in sorted(r)) for r in data)


def duck(sf_dir: str, sql: str) -> list[dict[str, Any]]:
    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    return [dict(zip(names, r)) for r in found.fetchall()]


def differences(ours: list[dict[str, Any]], theirs: list[dict[str, Any]]) -> str:
    a, b = rows(ours), rows(theirs)
    if a == b:
        return ""
    return f"{len(ours)} and {len(theirs)} rows; only ours: {list((a - b).items())[:2]}; only theirs: {list((b - a).items())[:2]}"
