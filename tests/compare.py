"""Runs a registered query on Spark and its SQL twin on DuckDB and compares the two."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def _key(row):
    return tuple((v is None, f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=_key)


def differences(spark_df, con, sql: str, limit: int = 5):
    """(problems, rows, types): problems is empty when both sides agree."""
    rel = con.sql(sql)
    oc, orows = _rows(rel.columns, rel.fetchall())
    otypes = dict(zip(rel.columns, map(str, rel.types)))
    srows = [tuple(r) for r in spark_df.collect()]
    sc, srows = _rows(spark_df.columns, srows)
    stypes = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    problems = []
    if oc != sc:
        return [f"columns spark={sc} oracle={oc}"], len(srows), None
    if len(srows) != len(orows):
        problems.append(f"rows spark={len(srows)} oracle={len(orows)}")
        ss, os_ = set(srows), set(orows)
        problems += [f"only spark {r}" for r in list(ss - os_)[:limit]] + [f"only oracle {r}" for r in list(os_ - ss)[:limit]]
        return problems, len(srows), None
    for a, b in zip(srows, orows):
        if a != b:
            close = all(x == y or (isinstance(x, float) and isinstance(y, float)
                                   and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b))
            problems.append(("ULP " if close else "DIFF ") + f"{[(c, x, y) for c, x, y in zip(sc, a, b) if x != y]} in {a}")
            if len(problems) >= limit:
                break
    odd = {c: (stypes[c], otypes[c]) for c in sc if not _same_type(stypes[c], otypes[c])}
    return problems, len(srows), odd


def _same_type(s: str, d: str) -> bool:
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "date": "DATE"}
    return pairs.get(s, s).upper() == d.upper()


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from pyspark.sql import SparkSession
    import __spark_entry__ as entry

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle, bad = entry.queries(), entry.oracle_sql(), 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracle:
                problems, n, odd = differences(fn(spark, folder), duck(folder), oracle[name])
            else:
                problems, n, odd = [], fn(spark, folder).count(), "no oracle"
        except Exception as e:  # report and go on to the next query
            problems, n, odd = [f"ERROR {type(e).__name__}: {str(e)[:700]}"], -1, None
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '}{name:34s} rows={n:<8d} {time.time()-t:5.1f}s {odd or ''}", flush=True)
        for p in problems:
            print("      ", p[:900], flush=True)
    print("failing:", bad)
