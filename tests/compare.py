"""Run registered queries against their SQL twins.

    python tests/compare.py [scale folder] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value, digits: int | None = 5):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return float(value) + 0.0 if digits is None else round(float(value), digits) + 0.0
    return str(value)


def rows_of(columns, rows, digits=None):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i], digits) for i in order) for r in rows),
                  key=lambda t: tuple((v is None, str(v)) for v in t))


def difference(left, right, tolerance: float = 0.0) -> str | None:
    """None if equal, else a short account of the first difference."""
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    bad = 0
    sample = None
    for a, b in zip(left, right):
        for x, y in zip(a, b):
            same = x == y or (isinstance(x, float) and isinstance(y, float)
                              and abs(x - y) <= tolerance)
            if not same:
                bad += 1
                sample = sample or (a, b)
                break
    return f"{bad} of {len(left)} rows differ, e.g. {sample}" if bad else None


def check(spark, con, folder: str, name: str, entry) -> tuple[str | None, int, float]:
    start = time.time()
    df = entry.queries()[name](spark, folder)
    rows = df.collect()
    spent = time.time() - start
    text = entry.oracle_sql().get(name)
    if text is None:
        return (None if rows else "no rows"), len(rows), spent
    cursor = con.execute(text)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(rows), spent
    found = cursor.fetchall()
    return difference(rows_of(df.columns, rows), rows_of(names, found)), len(rows), spent


def main() -> None:
    import __spark_entry__ as entry
    from paneltide.session import build_session
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("PANELTIDE_SPREAD"):  # the plans for groups too large for one task
        spark.conf.set("paneltide.group.maxRows", "0")
        spark.conf.set("paneltide.broadcast.maxBytes", "0")
    con, failed = duck(folder), []
    for name in entry.queries():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            problem, n, spent = check(spark, con, folder, name, entry)
        except Exception as exc:
            problem, n, spent = f"{type(exc).__name__}: {str(exc)[:600]}", 0, 0.0
            if "-v" in wanted:
                traceback.print_exc()
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {kind:4s} {n:8d} {spent:6.2f}s"
              f" {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
