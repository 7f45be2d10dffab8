"""Side-by-side check of the registered queries against their SQL in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(int(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, db, folder, name, run, sql):
    """Empty text when equal, else what differs."""
    got = run(spark, folder)
    left = rows_of(got.columns, [tuple(row) for row in got.collect()])
    cursor = db.execute(sql)
    columns = [d[0] for d in cursor.description]
    right = rows_of(columns, cursor.fetchall())
    if sorted(got.columns) != sorted(columns):
        return f"columns {sorted(set(got.columns) ^ set(columns))}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    names = sorted(columns)
    wrong = {}
    for a, b in zip(left, right):
        if a != b:
            for n, x, y in zip(names, a, b):
                if x != y:
                    wrong.setdefault(n, []).append((x, y, a[:3]))
    if wrong:
        return "; ".join(f"{n}: {len(v)} e.g. {v[0]}" for n, v in list(wrong.items())[:6])
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from gavelworks.session import local_session

    folder = f"/root/testdata/sf{sys.argv[1]}" if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    db, queries, sqls = duck(folder), entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        begin = time.time()
        try:
            if name in sqls:
                text = compare(spark, db, folder, name, run, sqls[name])
            else:
                text = "" if run(spark, folder).count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            text = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(text)
        mark = "FAIL" if text else ("ok  " if name in sqls else "rows")
        print(f"{mark} {time.time() - begin:6.2f}s {name} {text}", flush=True)
    print("failed:", bad)
