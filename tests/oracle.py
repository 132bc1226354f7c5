"""Compare a registered query with its SQL twin on the same tables."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _rows(table, names) -> Counter:
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
    return Counter(zip(*columns)) if columns else Counter()


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences between both results, as text; empty when equal."""
    left = spark_df.toArrow() if hasattr(spark_df, "toArrow") else spark_df
    right = con.execute(sql).to_arrow_table()
    if sorted(left.column_names) != sorted(right.column_names):
        return [f"columns {sorted(left.column_names)} / {sorted(right.column_names)}"]
    names = sorted(left.column_names)
    problems = []
    for n in names:
        a, b = str(left.schema.field(n).type), str(right.schema.field(n).type)
        if a.replace("large_", "").replace("timestamp[us, tz=UTC]", "timestamp[us]") != b.replace("large_", "").replace("timestamp[us, tz=UTC]", "timestamp[us]"):
            problems.append(f"type of {n}: {a} / {b}")
    x, y = _rows(left, names), _rows(right, names)
    if x != y:
        problems.append(f"rows {sum(x.values())} / {sum(y.values())}")
        problems += [f"only query: {str(r)[:600]}" for r in list((x - y))[:2]]
        problems += [f"only sql:   {str(r)[:600]}" for r in list((y - x))[:2]]
    return problems
