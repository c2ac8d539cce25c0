"""Compare a Spark result with DuckDB on the same parquet files, as whole multisets."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

import duckdb

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for table in GIVEN:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


DUCK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def types(df) -> dict[str, str]:
    """Spark column types under their DuckDB names."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return {name: DUCK_TYPES.get(kind, kind.upper()) for name, kind in kinds.items()}


def plain(value):
    """A hashable value that does not hide a difference in type family."""
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, Decimal):
        return ("dec", str(value))
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def assert_same(df, con, sql: str) -> int:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    assert types(df) == {d[0]: str(d[1]) for d in cursor.description}
    actual = df.collect()
    left, right = bag(df.columns, actual), bag(names, expected)
    only_spark, only_sql = left - right, right - left
    assert not only_spark and not only_sql, (
        f"{sum(only_spark.values())} rows only in Spark, {sum(only_sql.values())} only in SQL; "
        f"first: {list(only_spark)[:2]} / {list(only_sql)[:2]}"
    )
    return len(actual)
