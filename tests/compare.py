"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__  # noqa: E402

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return value + 0.0
    return value


def as_rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def differences(spark, con, name: str, sf_dir: str) -> list[str]:
    """What differs between the two sides; empty if they agree or there is no SQL."""
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in SQL:
        return [] if rows else ["no rows"]
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    found = []
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(columns)}"]
    for column, kind in df.dtypes:
        if KINDS.get(kind, kind) != kinds[column]:
            found.append(f"type of {column}: {kind} vs {kinds[column]}")
    left, right = as_rows(df.columns, rows), as_rows(columns, result.fetchall())
    if left != right:
        extra, missing = left - right, right - left
        found.append(
            f"rows {len(rows)} vs {sum(right.values())}; {sum(extra.values())} extra such as "
            f"{sorted(extra, key=str)[:2]}, {sum(missing.values())} missing such as {sorted(missing, key=str)[:2]}"
        )
    return found


def main() -> int:
    from playmetrics.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    con = connect(sf_dir)
    failed = 0
    for name in chosen:
        start = time.time()
        try:
            found = differences(spark, con, name, sf_dir)
        except Exception as error:  # report every query, then go on
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(found)
        mark = "FAIL" if found else ("ok" if name in SQL else "rows")
        print(f"{mark:4} {name} {time.time() - start:.2f}s", *found, sep="\n     " if found else " ", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
