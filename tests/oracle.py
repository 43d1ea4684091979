"""Run registered queries next to their SQL and compare rows strictly.

    python tests/oracle.py [--sf 0.01] [name-part ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

FAMILY = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "double": "float", "float": "float", "string": "text", "boolean": "bool",
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "HUGEINT": "huge", "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "text", "BOOLEAN": "bool",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return repr(value)


def compare(df, con, sql: str) -> str:
    """Empty text when both sides agree, else a short account of the difference."""
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    if sorted(columns) != names:
        return f"columns {names} != {sorted(columns)}"
    position = [columns.index(n) for n in names]
    theirs = sorted(tuple(plain(r[p]) for p in position) for r in result.fetchall())
    types = dict(df.dtypes)
    odd = [(n, types[n], kinds[n]) for n in names if FAMILY.get(types[n], types[n]) != FAMILY.get(kinds[n], types[n])]
    if odd:
        return f"types {odd}"
    if mine != theirs:
        left, right = set(mine), set(theirs)
        a = [r for r in mine if r not in right][:3]
        b = [r for r in theirs if r not in left][:3]
        return f"rows {len(mine)} vs {len(theirs)}; {names}; only mine {a}; only oracle {b}"
    return "" if mine else "both empty"


def main(arguments: list[str]) -> int:
    from pacelane.session import build_session
    import __spark_entry__ as entry

    scale = "0.01"
    if "--sf" in arguments:
        at = arguments.index("--sf")
        scale = arguments[at + 1]
        del arguments[at : at + 2]
    folder = f"/root/testdata/sf{scale}"
    spark = build_session(master="local[8]", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracle, bad = entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if arguments and not any(part in name for part in arguments):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            if name in oracle:
                verdict = compare(df, con, oracle[name])
            else:
                verdict = "" if df.count() >= 0 else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict = f"{type(error).__name__}: {str(error)[:900]}"
        bad += bool(verdict)
        print(f"{'ok  ' if not verdict else 'FAIL'} {name} {time.time() - start:.1f}s {'' if name in oracle else '(no sql)'} {verdict[:1500]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
