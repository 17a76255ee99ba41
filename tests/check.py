"""Run registered queries next to their SQL twins and compare every value.

    python tests/check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, ".")
sys.path.insert(0, "/root/repo")

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(values: pd.Series) -> str:
    seen = values.dropna()
    if seen.empty:
        return "null"
    if pd.api.types.is_datetime64_any_dtype(values):
        return "time"
    one = seen.iloc[0]
    if isinstance(one, bool) or str(values.dtype) in ("bool", "boolean"):
        return "bool"
    if pd.api.types.is_integer_dtype(values):
        return "int"
    return type(one).__name__


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = _kind(df[c])
        if kind in ("float", "float64"):
            df[c] = df[c].map(lambda v: None if pd.isna(v) else repr(float(v) + 0.0))
        elif kind in ("int", "int64", "int32"):
            df[c] = df[c].map(lambda v: None if pd.isna(v) else str(int(v)))
        elif kind == "time":
            df[c] = df[c].map(lambda v: None if pd.isna(v) else str(pd.Timestamp(v)))
        else:
            df[c] = df[c].map(
                lambda v: None if v is None or v is pd.NaT or v != v else str(v)
            )
        df[c] = df[c].astype(object).where(df[c].notna(), "<null>")
    return df.sort_values(list(df.columns), ignore_index=True)


def compare(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    """Empty when equal, else what differs."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} <> {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} <> {len(sql_rows)}"
    kinds = [
        f"{c}: {_kind(spark_rows[c])} <> {_kind(sql_rows[c])}" for c in spark_rows.columns
        if _kind(spark_rows[c]).rstrip("0123456789") != _kind(sql_rows[c]).rstrip("0123456789")
        and {_kind(spark_rows[c]), _kind(sql_rows[c])} != {"int", "float"}
    ]
    a, b = canonical(spark_rows), canonical(sql_rows)
    bad = [c for c in a.columns if not a[c].equals(b[c])]
    if bad:
        i = next(i for i in range(len(a)) if any(a[c].iat[i] != b[c].iat[i] for c in bad))
        return (
            f"values differ in {bad}; kinds {kinds}; first "
            f"{a.loc[i].to_dict()} <> {b.loc[i].to_dict()}"
        )
    return f"kinds {kinds}" if kinds else ""


def main(argv: list[str]) -> int:
    import __spark_entry__ as e
    from tapeline.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(e.queries())
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        started = time.time()
        try:
            got = e.queries()[name](spark, sf_dir).toPandas()
            took = time.time() - started
            if name in e.oracle_sql():
                want = con.execute(e.oracle_sql()[name]).to_arrow_table().to_pandas()
                verdict = compare(got, want)
            else:
                verdict = ""
            sql_took = time.time() - started - took
        except Exception as exc:  # keep going, report at the end
            verdict, took, sql_took, got = f"{type(exc).__name__}: {str(exc)[:1500]}", 0, 0, []
        failed += bool(verdict)
        print(
            f"{'FAIL' if verdict else 'ok  '} {name:28s} rows={len(got):8d} "
            f"{took:6.2f}s sql={sql_took:5.2f}s {verdict}", flush=True,
        )
    print(f"{failed} failed of {len(names)}")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
