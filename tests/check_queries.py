"""Compare catalog queries with their DuckDB twins: ``python tests/check_queries.py [sf] [name ...]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_rows(sf_dir, sql):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(repr(r[i] + 0.0) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(shaped)


def compare(spark, sf_dir, name, fn, sql):
    df = fn(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows only: {len(got[1])}"
    want = canonical(*oracle_rows(sf_dir, sql))
    if got == want:
        return f"ok: {len(got[1])}"
    if got[0] != want[0]:
        return f"MISMATCH columns {got[0]} vs {want[0]}"
    left, right = set(got[1]), set(want[1])
    extra = sorted(left - right)[:3]
    missing = sorted(right - left)[:3]
    return f"MISMATCH rows {len(got[1])} vs {len(want[1])}; spark only {extra}; oracle only {missing}"


def main():
    import __spark_entry__ as e

    from themeloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    sqls = e.oracle_sql()
    names = sys.argv[2:] or list(e.queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            result = compare(spark, f"/root/testdata/sf{sf}", name, e.queries()[name], sqls.get(name))
        except Exception as err:
            traceback.print_exc(limit=-3) if len(names) < 4 else None
            result = "ERROR " + str(err)[:1500]
        bad += not result.startswith(("ok", "rows"))
        print(f"{name:28s} {time.time() - start:6.1f}s {result[:1800]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
