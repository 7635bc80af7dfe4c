"""Compare registered queries with their DuckDB counterparts: python tests/oracle.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else "0.0" if v == 0 else repr(v)
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(cell(x) for x in v) + "]"
        if type(v).__name__ == "Decimal":
            return repr(float(v))
        return str(v)

    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema}


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = canonical(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ, first: {got[0]}\n   {bad[0][0]}\n   {bad[0][1]}"
    kinds = {"double": ("DOUBLE",), "bigint": ("BIGINT",), "int": ("INTEGER",), "string": ("VARCHAR",), "boolean": ("BOOLEAN",)}
    off = [(c, t, str(d)) for (c, t), d in zip(types(df).items(), [dict(zip(rel.columns, rel.types))[c] for c in df.columns])
           if t in kinds and str(d) not in kinds[t]]
    return f"ok {len(got[1])} rows" + (f"  types: {off}" if off else "")


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf, prefixes = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), tuple(sys.argv[2:])
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.log.level", "ERROR").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    sf_dir = f"/root/testdata/sf{sf}"
    con, sqls, failed = duck(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            result = compare(spark, con, name, fn, sqls[name], sf_dir) if name in sqls else f"ok (no sql) {fn(spark, sf_dir).count()} rows"
        except Exception as e:  # report and go on
            result = f"ERROR {type(e).__name__} {str(e)[:1500]}"
        failed += not result.startswith("ok")
        print(f"{time.time() - start:6.2f} {name}: {result}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
