"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and abs(value) < 2**53 else value
    if value.__class__.__name__ == "Decimal":
        return cell(float(value))
    if isinstance(value, (int, str)):
        return value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(made, key=lambda r: tuple(str(v) for v in r))


def compare(spark, con, name, fn, sql, folder):
    """'' when both agree exactly, otherwise what differs."""
    df = fn(spark, folder)
    left_cols, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    right_cols, right = rows_of([d[0] for d in rel.description], rel.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} vs {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, e.g. {bad[:2]}"
    return "" if left else "no rows"


def main(argv):
    from rushlight.queries import load
    from rushlight.session import local_session

    folder = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    wanted = [a for a in argv if not a.startswith("/")]
    queries, sqls = load()
    spark = local_session()
    con = duck(folder)
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, name, fn, sqls[name], folder)
                note = "sql"
            else:
                n = fn(spark, folder).count()
                problem, note = ("" if n else "no rows"), f"rows-only {n}"
        except Exception as error:  # report and go on to the next query
            problem, note = f"{type(error).__name__}: {str(error)[:900]}", ""
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - began:.1f}s {note} {problem}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
