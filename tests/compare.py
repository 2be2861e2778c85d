"""Run registered queries beside their reference SQL; also a command line tool.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def open_tables(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "NaN" if v != v else f"{v:.6f}"
        if isinstance(v, pd.Timestamp):
            v = v.to_pydatetime()
        return type(v).__name__ + ":" + str(v)

    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both give the same columns and rows, else a short account."""
    got = _canonical([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(sql)
    want = _canonical(result.fetchall(), [d[0] for d in result.description])
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return None
    extra, missing = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    return (f"rows {len(got[1])} vs {len(want[1])}; "
            f"extra {sorted(extra)[:2]}; missing {sorted(missing)[:2]}")


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from postsift.session import build_session

    sf_dir, names = argv[0], argv[1:]
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        started = time.time()
        try:
            if name in oracles:
                outcome = difference(queries[name](spark, sf_dir), con, oracles[name])
            else:
                outcome = None
                print(f"{name}: {len(queries[name](spark, sf_dir).collect())} rows, no oracle")
        except Exception as error:
            outcome = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += outcome is not None
        print(f"{'FAIL' if outcome else 'ok  '} {time.time() - started:6.2f}s {name} {(outcome or '')[:1800]}",
              flush=True)
    print(f"{bad} failing of {len(names or queries)}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
