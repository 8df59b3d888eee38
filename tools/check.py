"""Run catalog queries against their SQL: python tools/check.py SF_DIR [name ...]"""

from __future__ import annotations

import gc
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from wattline.plans.catalog import QUERIES  # noqa: E402
from wattline.plans.oracles import ORACLES  # noqa: E402


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in data)


def main():
    sf, wanted = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    bad = []
    for name in wanted:
        t = time.time()
        try:
            df = QUERIES[name](spark, sf)
            got = rows(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - t
            del df
            if name not in ORACLES:
                print(f"{name:28s} rows only  {len(got[1])} rows {took:.1f}s", flush=True)
                continue
            t2 = time.time()
            cur = con.execute(ORACLES[name])
            want = rows([d[0] for d in cur.description], cur.fetchall())
            ok = got == want
            print(f"{name:28s} {'ok' if ok else 'DIFF'} {len(got[1])} vs {len(want[1])} rows {took:.1f}s sql {time.time()-t2:.1f}s", flush=True)
            if not ok:
                bad.append(name)
                if got[0] != want[0]:
                    print("  columns", got[0], want[0])
                else:
                    print("  cols ", got[0])
                    n = 0
                    a, b = set(got[1]), set(want[1])
                    print("  only spark", len(a - b), "only sql", len(b - a))
                    for x, y in list(zip(sorted(a - b), sorted(b - a)))[:3]:
                        print("   S", x)
                        print("   Q", y)
            if len(wanted) > 20 and wanted.index(name) % 10 == 0:
                rt = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
                spark.sparkContext._jvm.System.gc()
                before = (rt.totalMemory() - rt.freeMemory()) / 1e9
                gc.collect()
                spark.sparkContext._jvm.System.gc()
                print(f"  heap {before:.2f} -> {(rt.totalMemory() - rt.freeMemory()) / 1e9:.2f} GB", flush=True)
        except Exception:
            bad.append(name)
            print(f"{name:28s} ERROR", flush=True)
            print(traceback.format_exc()[-1500:])
    print("bad:", bad)


main()
