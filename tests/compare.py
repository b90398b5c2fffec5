"""Compare registered queries with their SQL on a data folder: python tests/compare.py FOLDER [NAME...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "container_spec domain_event earlier_key known_mimetype mix_target output_record sample_input sample_input_raw"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def normal(pdf: pd.DataFrame) -> list[tuple]:
    def cell(x: object) -> str:
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return "~"
        if isinstance(x, float):
            return f"{x:.9g}"
        if hasattr(x, "__len__") and not isinstance(x, (str, bytes, bytearray)):
            return str(list(x))
        return str(bytes(x) if isinstance(x, bytearray) else x)

    cols = sorted(pdf.columns)
    return sorted(tuple(cell(x) for x in row) for row in pdf[cols].astype(object).itertuples(index=False))


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if the rows are equal."""
    a, b = df.toPandas(), con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    x, y = normal(a), normal(b)
    if x == y:
        return ""
    return f"{len(x)} and {len(y)} rows; only here {sorted(set(x) - set(y))[:3]}; only SQL {sorted(set(y) - set(x))[:3]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]
    con, sql = connect(folder), e.oracle_sql()
    bad = 0
    for name, f in e.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        t = time.time()
        try:
            if name in sql:
                said = differences(f(spark, folder), con, sql[name]) or "equal"
            else:
                said = f"{f(spark, folder).count()} rows (no SQL)"
        except Exception as x:  # noqa: BLE001
            said = f"ERROR {str(x)[:1500]}"
        bad += not (said == "equal" or said.endswith("(no SQL)"))
        print(f"{name}: {time.time() - t:.1f} s, {said}", flush=True)
    print(f"{bad} differ")
