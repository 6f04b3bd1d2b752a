"""Compare queries with their SQL twins: python tests/check_queries.py [folder] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    rows = sorted(frame.itertuples(index=False, name=None), key=repr)
    return pd.DataFrame(rows, columns=frame.columns, dtype=object)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} != {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    a, b = plain(spark_rows), plain(sql_rows)
    for left, right in zip(a.itertuples(index=False, name=None), b.itertuples(index=False, name=None), strict=True):
        if left != right:
            for c, x, y in zip(a.columns, left, right, strict=True):
                if x != y:
                    return f"{c}: {str(x)[:300]!r} != {str(y)[:300]!r} in {str(left)[:200]}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tests.session import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, sql = session(8), connect(folder), oracle_sql()
    bad = 0
    for name, run in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            t = time.time()
            got = run(spark, folder).toPandas()
            took = time.time() - t
            t = time.time()
            note = "rows only" if name not in sql else difference(got, con.execute(sql[name]).df())
            print(f"{name:28s} {len(got):7d} rows {took:6.2f}s sql {time.time() - t:6.2f}s {note or 'ok'}", flush=True)
            bad += note not in (None, "rows only")
        except Exception as e:
            bad += 1
            print(f"{name:28s} ERROR {type(e).__name__}: {str(e)[:600]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
