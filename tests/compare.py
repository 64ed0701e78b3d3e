"""Compare registered queries with their SQL on DuckDB.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, Decimal):
        return float(v) if v % 1 else int(v)
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 6)
    return v


def multiset(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, run, sql: str) -> tuple[bool, str]:
    start = time.time()
    df = run(spark, folder)
    ours = multiset(df.columns, df.collect())
    spent = time.time() - start
    start = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = multiset(names, result.fetchall())
    text = f"{spent:6.2f}s spark {time.time() - start:6.2f}s sql rows {sum(ours[1].values())}"
    if ours == theirs:
        return True, text
    if ours[0] != theirs[0]:
        return False, f"{text}\n  columns {ours[0]} vs {theirs[0]}"
    extra, missing = ours[1] - theirs[1], theirs[1] - ours[1]
    return False, (f"{text} sql rows {sum(theirs[1].values())}\n  {ours[0]}\n  only spark {sum(extra.values())}: "
                   f"{list(extra)[:3]}\n  only sql {sum(missing.values())}: {list(missing)[:3]}")


def main() -> None:
    import __spark_entry__ as entry
    from quorumbook.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = []
    for name in names:
        try:
            if name not in oracle:
                start = time.time()
                n = len(queries[name](spark, folder).collect())
                print(f"----  {name:34s} {time.time() - start:6.2f}s rows {n}", flush=True)
                continue
            ok, text = compare(spark, con, folder, queries[name], oracle[name])
        except Exception as e:  # keep going: the list of failures is the result
            ok, text = False, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'}  {name:34s} {text}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
