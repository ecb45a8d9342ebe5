"""Run registered queries next to their DuckDB oracles and compare whole results."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as tuples of plain values, columns by name, rows sorted."""
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return round(v, 9) + 0.0
        if isinstance(v, bool):
            return v
        return v

    columns = sorted(frame.columns)
    rows = [tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v).__name__ in ("int", "float", "bool")), str(v)) for v in r))


def compare(spark_frame: pd.DataFrame, oracle_frame: pd.DataFrame) -> str | None:
    """None when equal, else a short account of the difference."""
    if sorted(spark_frame.columns) != sorted(oracle_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(oracle_frame.columns)}"
    a, b = canonical(spark_frame), canonical(oracle_frame)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return None if not wrong else f"{len(wrong)} rows differ, first {wrong[0]}"


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from sightline.catalog import oracles, queries
    from sightline.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                   "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf), oracles()
    bad = []
    for name, query in queries().items():
        if names and name not in names and not any(n.endswith("*") and name.startswith(n[:-1]) for n in names):
            continue
        start = time.perf_counter()
        try:
            got = query(spark, sf).toPandas()
        except Exception as exc:  # report and go on with the next query
            print(f"{name:32s} FAILED {str(exc)[:1500]}", flush=True)
            bad.append(name)
            continue
        took = time.perf_counter() - start
        if name in sql:
            start = time.perf_counter()
            try:
                want = con.sql(sql[name]).df()
                fault = compare(got, want)
            except Exception as exc:
                fault = f"oracle error {str(exc)[:800]}"
            verdict = fault or "equal"
            duck = time.perf_counter() - start
        else:
            verdict, duck, fault = "rows only", 0.0, None
        bad += [name] if fault else []
        print(f"{name:32s} {len(got):7d} rows {took:6.2f}s duck {duck:5.2f}s  {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
