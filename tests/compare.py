"""Run registered queries next to their SQL in DuckDB and compare the values."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0) > 0:
            return tuple(cell(x) for x in v)
        if isinstance(v, dict):
            return tuple((k, cell(x)) for k, x in sorted(v.items()))
        if v is None or v is pd.NaT or (not isinstance(v, (str, bytes)) and pd.isna(v)):
            return None
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).tz_localize(None).isoformat() if getattr(v, "tzinfo", None) else pd.Timestamp(v).isoformat()
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype") or type(v).__name__ == "Decimal":
            return float(v)
        return str(v)

    rows = [tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def compare(spark, con, name, build, sql, sf_dir):
    start = time.time()
    got = build(spark, sf_dir).toPandas()
    secs = time.time() - start
    if sql is None:
        return "rows-only" if len(got) else "EMPTY", secs, len(got), ""
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return "COLUMNS", secs, len(got), f"{sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = canon(got), canon(want)
    if len(a) != len(b):
        return "ROWS", secs, len(a), f"{len(a)} vs {len(b)}; e.g. {a[:2]} vs {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return "VALUES", secs, len(a), f"{len(bad)} differ on {sorted(got.columns)}; e.g. {bad[0]}"
    return ("ok" if a else "EMPTY"), secs, len(a), ""


def main(argv):
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.log.level", "ERROR").getOrCreate())
    con = connect(sf_dir)
    qs, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in qs:
        if argv and not any(name.startswith(a) for a in argv):
            continue
        try:
            status, secs, n, note = compare(spark, con, name, qs[name], oracle.get(name), sf_dir)
        except Exception as exc:  # report and go on
            status, secs, n, note = "ERROR", 0.0, 0, f"{type(exc).__name__}: {str(exc)[:600]}"
        if status not in ("ok", "rows-only"):
            bad += 1
        print(f"{status:10s} {secs:6.2f}s {n:7d} {name} {note[:900]}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
