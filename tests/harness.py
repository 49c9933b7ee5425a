"""Compare registered queries with their SQL on DuckDB: row counts, columns and an order-free comparison of values."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("trajspark-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
             .config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("n", v + 0.0)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("n", float(v)) if abs(v) < 2**53 else ("n", v)
    if v is None:
        return ("~",)
    return ("s", str(v))


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    cur = con.execute(sql)
    want_cols, want = canonical([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    out = []
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        want_set, got_set = set(want), set(got)
        a, b = [r for r in got if r not in want_set], [r for r in want if r not in got_set]
        out.append(f"{len(a)} rows only here, {len(b)} only in SQL; columns {got_cols}")
        out += [f"  here {r}" for r in a[:3]] + [f"  sql  {r}" for r in b[:3]]
    types = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    duck_types = {d[0]: str(d[1]) for d in con.execute("DESCRIBE " + sql).fetchall()} if not out else {}
    for c, t in df.dtypes:
        if duck_types and duck_types[c] != types.get(t, t):
            out.append(f"type of {c}: {t} != {duck_types[c]}")
    return out


def main(names: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.01"
    if names and names[0].startswith("/"):
        sf, names = names[0], names[1:]
    spark, con = session(), duck(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = queries[name](spark, sf)
            problems = compare(df, con, oracle[name]) if name in oracle else []
            note = "" if name in oracle else f"rows {df.count()}"
        except Exception as e:
            problems, note = [f"{type(e).__name__}: {str(e)[:700]}"], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
        for p in problems:
            print("     ", p[:900], flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
