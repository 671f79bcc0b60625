"""Compare registered queries with their checking SQL: ``python -m claridoc.plans.check [sf] [name part]``."""

from __future__ import annotations

import sys
import time

import duckdb

from claridoc.plans import catalog
from claridoc.sources.fixtures import TABLES

KINDS = {"int": "int", "big": "int", "hug": "int", "dou": "float", "flo": "float", "str": "text", "boo": "bool", "tim": "time", "dec": "dec", "uin": "int"}


def checker(folder: str):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def _kind(dtype: str) -> str:
    return KINDS.get(dtype.lower()[:3], dtype)


def _canonical(pdf):
    rows = pdf[sorted(pdf.columns)].itertuples(index=False, name=None)
    clean = [tuple(None if v is None or v != v else (str(v)) for v in r) for r in rows]
    return sorted(clean, key=repr)


def compare(spark, db, folder: str, name: str) -> str:
    """Empty when the query equals its check, else what differs."""
    frame = catalog.queries()[name](spark, folder)
    got = frame.toArrow()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return "" if got.num_rows >= 0 else "no rows"
    want = db.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} against {sorted(want.column_names)}"
    for c in got.column_names:
        a, b = _kind(str(got.schema.field(c).type)), _kind(str(want.schema.field(c).type))
        if a != b and str(want.schema.field(c).type) != "null":
            return f"type of {c}: {got.schema.field(c).type} against {want.schema.field(c).type}"
    if got.num_rows != want.num_rows:
        return f"{got.num_rows} rows against {want.num_rows}"
    a, b = _canonical(got.to_pandas(integer_object_nulls=True)), _canonical(want.to_pandas(integer_object_nulls=True))
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} rows differ, first:\n  {wrong[0][0]}\n  {wrong[0][1]}" if wrong else ""


def main() -> None:
    from claridoc.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    part = sys.argv[2] if len(sys.argv) > 2 else ""
    folder = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    db = checker(folder)
    bad = 0
    for name in catalog.queries():
        if not any(name.startswith(p) for p in part.split(",")):
            continue
        start = time.time()
        try:
            diff = compare(spark, db, folder, name)
        except Exception as e:  # report and go on
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(diff)
        mark = "DIFF" if diff else ("rows" if name not in catalog.oracle_sql() else "ok")
        print(f"{mark:4} {name} {time.time() - start:.1f}s {diff}", flush=True)
    print(f"{bad} of {len(catalog.queries())} differ")


if __name__ == "__main__":
    main()
