"""Runs registered queries beside their SQL twins: python tests/parity.py SF_DIR [NAME...]."""

import glob
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd


def rows(df: pd.DataFrame) -> list[str]:
    def text(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
            return "-"
        if isinstance(x, float):
            return f"{x + 0.0:.9g}"
        if isinstance(x, pd.Timestamp) or hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        return str(x)

    cols = sorted(df.columns)
    return sorted("|".join(map(text, r)) for r in df[cols].astype(object).itertuples(index=False, name=None))


def connect(sf_dir: str):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p}'")
    return c


def compare(spark, c, sf_dir, name, run, sql):
    """Empty if equal, else what differs."""
    got = run(spark, sf_dir).toPandas()
    if sql is None:
        return "" if len(got) else "no rows"
    want = c.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    return "" if a == b else f"{len(a)} and {len(b)} rows; {[x for x in zip(a, b) if x[0] != x[1]][:2]}"


if __name__ == "__main__":
    from arenaflow.session import local_session

    import __spark_entry__ as e

    sf, names = sys.argv[1], sys.argv[2:]
    spark, c, sql = local_session(8, local_dir=tempfile.mkdtemp(prefix="spark-", dir="/tmp")), connect(sf), e.oracle_sql()
    for name, run in e.queries().items():
        if not names or any(name.startswith(n) for n in names):
            at = time.time()
            try:
                said = compare(spark, c, sf, name, run, sql.get(name))
            except Exception as x:
                said = f"failed: {str(x)[:600]}"
            print(f"{name}: {said or 'equal' + ' (rows only)' * (name not in sql)} {time.time() - at:.1f} s", flush=True)
