"""Run named queries on Spark and their SQL twins on DuckDB and compare the rows.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _key(value) -> str:
    if value is None or (isinstance(value, float) and value != value) or value is pd.NaT or value is pd.NA:
        return "null"
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return f"{type(value).__name__}:{value}" if not isinstance(value, int) else str(value)


def canonical(rows, columns) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def differences(spark_df, cursor, limit: int = 3) -> list[str]:
    """Empty if columns, types, row count and all values agree."""
    out = []
    theirs_columns = [d[0] for d in cursor.description]
    theirs_types = {d[0]: str(d[1]).upper() for d in cursor.description}
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for column, kind in spark_df.dtypes:
        if column in theirs_types and names.get(kind, kind) != theirs_types[column]:
            out.append(f"type of {column}: {kind} against {theirs_types[column]}")
    if sorted(spark_df.columns) != sorted(theirs_columns):
        return out + [f"columns {sorted(spark_df.columns)} against {sorted(theirs_columns)}"]
    ours = canonical([tuple(r) for r in spark_df.collect()], spark_df.columns)
    theirs = canonical(cursor.fetchall(), theirs_columns)
    if len(ours) != len(theirs):
        out.append(f"{len(ours)} rows against {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ over {sorted(theirs_columns)}")
        out += [f"  {a}\n  {b}" for a, b in bad[:limit]]
    return out


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from flowspark.session import get_spark

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = get_spark("compare", "local[8]", **{"spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    wrong = 0
    twins = oracle_sql()
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in twins:
                problems = differences(df, duck(sf_dir).execute(twins[name]))
                verdict = "ok" if not problems else "WRONG"
            else:
                problems, verdict = [], f"ran, {len(df.collect())} rows, no twin"
        except Exception as error:
            problems, verdict = [str(error)[:1500]], "ERROR"
        wrong += bool(problems)
        print(f"{name:28s} {time.time() - start:6.2f}s  {verdict}", flush=True)
        for p in problems:
            print("   ", p)
    print("wrong:", wrong)
    return wrong


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
