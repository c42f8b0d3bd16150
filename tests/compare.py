"""Run registered queries beside their SQL on the same Parquet files and compare.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def sql_rows(folder: str, text: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect(":memory:")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    result = con.execute(text)
    return [c[0] for c in result.description], result.fetchall()


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return "null" if v is None else str(v)


def normal(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return df.columns, [tuple(r) for r in df.collect()]


def differences(spark, folder: str, name: str, limit: int = 3) -> list[str]:
    import __spark_entry__ as entry

    columns, rows = spark_rows(entry.queries()[name](spark, folder))
    text = entry.oracle_sql().get(name)
    if text is None:
        return [] if rows else ["no rows"]
    sql_columns, expected = sql_rows(folder, text)
    if sorted(columns) != sorted(sql_columns):
        return [f"columns {sorted(columns)} != {sorted(sql_columns)}"]
    ours, theirs = normal(columns, rows), normal(sql_columns, expected)
    if ours == theirs:
        return []
    out = [f"{len(ours)} rows, SQL {len(theirs)}"]
    extra, missing = set(ours) - set(theirs), set(theirs) - set(ours)
    out += [f"only ours ({len(extra)}): {str(r)[:300]}" for r in sorted(extra)[:limit]]
    out += [f"only SQL ({len(missing)}): {str(r)[:300]}" for r in sorted(missing)[:limit]]
    return out


def main() -> None:
    import __spark_entry__ as entry
    from telemap import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(entry.queries())
    spark = session(
        "compare",
        "local[8]",
        **{
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": "8",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="telemap-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        start = time.time()
        try:
            diff = differences(spark, folder, name)
        except Exception as err:  # noqa: BLE001 - report and go on
            diff = [f"{type(err).__name__}: {str(err)[:1500]}"]
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'ok ' if not diff else 'BAD'} {name} [{kind}] {time.time() - start:.1f}s", flush=True)
        for line in diff:
            print("     ", line, flush=True)
        bad += bool(diff)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
