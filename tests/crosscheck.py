"""Run registered queries next to their SQL in DuckDB and compare rows, columns and values."""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            connection.execute(
                f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
            )
    return connection


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        ([plain(row[i]) for i in order] for row in rows), key=repr
    )


def compare(spark_df, connection, sql) -> tuple[bool, str]:
    columns, rows = canonical(spark_df.columns, spark_df.collect())
    relation = connection.execute(sql)
    types = {d[0]: str(d[1]) for d in relation.description}
    sql_columns, sql_rows = canonical([d[0] for d in relation.description], relation.fetchall())
    if columns != sql_columns:
        return False, f"columns {columns} != {sql_columns}"
    if len(rows) != len(sql_rows):
        return False, f"rows {len(rows)} != {len(sql_rows)}"
    kinds = dict(spark_df.dtypes)
    odd = []
    for name in columns:
        a, b = kinds[name], types[name]
        same = {
            "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
        }.get(a)
        if same is not None and same != b:
            odd.append(f"{name}: {a} vs {b}")
    wrong = [(a, b) for a, b in zip(rows, sql_rows) if repr(a) != repr(b)]
    note = f"{len(rows)} rows" + (f"; types {odd}" if odd else "")
    if wrong:
        a, b = wrong[0]
        diff = [(c, x, y) for c, x, y in zip(columns, a, b) if repr(x) != repr(y)]
        return False, f"{len(wrong)} of {len(rows)} rows differ, first: {diff[:6]}; {note}"
    return not odd, note


def main(argv) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir = argv[0]
    chosen = argv[1:]
    spark = make_session()
    connection = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = []
    for name, run in queries.items():
        if chosen and name not in chosen:
            continue
        begin = time.time()
        try:
            if name in sqls:
                good, note = compare(run(spark, sf_dir), connection, sqls[name])
            else:
                good, note = True, f"rows only: {run(spark, sf_dir).count()}"
        except Exception as error:  # report and go on with the next query
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok ' if good else 'BAD'} {name} {time.time() - begin:.1f}s {note}", flush=True)
        if not good:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
