"""Compares registered queries with their SQL on the same parquet tables."""

from __future__ import annotations

import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    if isinstance(value, Decimal):
        return round(float(value), 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return rows_of(names, cursor.fetchall())


def compare(spark, con, sf_dir: str, name: str, build, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    got, names = spark_rows(build(spark, sf_dir))
    took = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, {took:.1f}s (no SQL)"
    want, want_names = sql_rows(con, sql)
    if names != want_names:
        return False, f"columns {names} != {want_names}"
    if got != want:
        missing = [r for r in want if r not in set(got)][:3]
        extra = [r for r in got if r not in set(want)][:3]
        return False, f"{len(got)} rows vs {len(want)}; missing {missing}; extra {extra}"
    return True, f"{len(got)} rows, {took:.1f}s"


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from facetledger.runtime import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if argv[1:] and not any(part in name for part in argv[1:]):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, build, oracle.get(name))
        except Exception as error:  # show every failing query, not only the first
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
