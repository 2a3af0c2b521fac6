"""Compare registered queries with their SQL counterparts: python tests/check_oracles.py DIR [names]."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    db = duckdb.connect()
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        if os.path.exists(path):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return db


def _normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)

    def cell(value):
        if value is None or value is pd.NA or (isinstance(value, float) and value != value):
            return "~"
        if isinstance(value, bool) or type(value).__name__ == "bool_":
            return str(bool(value))
        if isinstance(value, (int, float)) or hasattr(value, "dtype"):
            return f"{round(float(value), 4):.4f}".replace("-0.0000", "0.0000")
        return str(value)

    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    """Empty text when both frames hold the same rows under the same names."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    left, right = _normal(spark_frame), _normal(sql_frame)
    if left == right:
        return ""
    in_left, in_right = set(left), set(right)
    extra = [row for row in left if row not in in_right][:2]
    missing = [row for row in right if row not in in_left][:2]
    return f"rows {len(left)} / {len(right)}; only Spark {extra}; only SQL {missing}"


def main(folder: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from fareloom.session import build_session

    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    db, oracles, failed = connect(folder), oracle_sql(), 0
    for name, build in queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            result = build(spark, folder).toPandas()
            took = time.time() - began
            note = compare(result, db.sql(oracles[name]).df()) if name in oracles else "(rows only)"
            note = note or "same"
        except Exception as error:  # report and go on with the next query
            took, result, note = time.time() - began, [], f"{type(error).__name__}: {str(error)[:600]}"
        failed += note not in ("same", "(rows only)")
        print(f"{name:28s} {len(result):7d} rows {took:6.2f} s  {note}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
