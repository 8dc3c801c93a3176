"""Runs registered queries beside their SQL on the same tables and compares the results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def sort_key(row):
    return [(v is None, str(type(v)), repr(v)) for v in row]


def compare(spark_df, con, sql: str) -> str | None:
    """None when both agree, else a description of the first difference."""
    names = sorted(spark_df.columns)
    mine = [tuple(plain(r[n]) for n in names) for r in spark_df.collect()]
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != names:
        return f"columns {names} != {sorted(columns)}"
    index = [columns.index(n) for n in names]
    theirs = [tuple(plain(r[i]) for i in index) for r in cur.fetchall()]
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    mine.sort(key=sort_key)
    theirs.sort(key=sort_key)
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, columns {names}: {bad[0][0]} != {bad[0][1]}"
    for column, values in enumerate(zip(*mine)) if mine else ():
        a = {kind(v) for v in values} - {"null"}
        b = {kind(r[column]) for r in theirs} - {"null"}
        if a != b:
            return f"type of {names[column]}: {a} != {b}"
    return None


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from omicspark.session import local_session

    folder = f"/root/testdata/sf{argv[0]}" if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session(8)
    con = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in sqls:
                problem = compare(df, con, sqls[name])
                note = "ok" if problem is None else "DIFF " + problem
            else:
                note = f"rows {df.count()}"
                problem = None
        except Exception as error:  # noqa: BLE001
            problem = note = "ERROR " + str(error)[:1500]
        failed += problem is not None
        print(f"{name:36s} {time.time() - start:6.2f}s  {note[:1600]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
