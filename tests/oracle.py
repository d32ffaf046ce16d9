"""Run registered queries next to their SQL on the same tables and compare."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, str(type(v).__name__), v if v is not None else 0) for v in row)


def compare(df, con, sql: str) -> str:
    """Empty string when names, types, rows and values agree."""
    got = df.toPandas()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = dict(zip(names, [str(d[1]) for d in result.description]))
    want = result.fetchall()
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} != {sorted(names)}"
    cols = sorted(names)
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    expect = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
              "int": "INTEGER"}
    for c in cols:
        if expect.get(spark_types[c], spark_types[c]) != types[c]:
            return f"type of {c}: {spark_types[c]} vs {types[c]}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    rows = [tuple(None if v is None or v != v else v for v in r)
            for r in got[cols].astype(object).itertuples(index=False)]
    at = [names.index(c) for c in cols]
    target = [tuple(r[k] for k in at) for r in want]
    rows.sort(key=_key)
    target.sort(key=_key)
    for a, b in zip(rows, target):
        if a != b:
            return f"first difference {dict(zip(cols, a))} vs {dict(zip(cols, b))}"
    return ""


def main(argv):
    from cladeloom.session import local_session
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if argv and not any(a in name for a in argv):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                problem = compare(fn(spark, sf_dir), con, sqls[name])
            else:
                rows = fn(spark, sf_dir).toPandas()
                problem = "" if len(rows) else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(problem)
        print(f"{'ok ' if not problem else 'BAD'} {name} {time.time() - t0:.1f}s "
              f"{'' if name in sqls else '(rows only) '}{problem}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
