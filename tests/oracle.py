"""Runs registered queries beside their SQL twins: python tests/oracle.py [folder] [name...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value) if value is not None and not isinstance(value, (int, bool)) else value


def differences(df, result):
    """What differs between a DataFrame and a DuckDB relation, as text; None if nothing does."""
    names = sorted(df.columns)
    other = sorted(result.columns)
    if names != other:
        return f"columns {names} and {other}"
    key = lambda r: tuple((isinstance(x, float), "" if isinstance(x, float) else str(x)) for x in r) + tuple(f"{x:.4g}" for x in r if isinstance(x, float))
    a = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    at = [result.columns.index(c) for c in names]
    b = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=key)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; {a[:2]} {b[:2]}"
    for x, y in zip(a, b):
        if any(not (p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-7, abs_tol=2e-6)) for p, q in zip(x, y)):
            return f"{names}\n  {x}\n  {y}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    db, oracles = database(folder), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:] or not sys.argv[2:] and (name.startswith("op") or name == "pipeline"):
            continue
        began = time.time()
        try:
            df = query(spark, folder)
            what = differences(df, db.sql(oracles[name])) if name in oracles else f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            what = f"{type(e).__name__}: {str(e)[:600]}"
        bad += name in oracles and what is not None
        print(f"{time.time() - began:5.1f} {name}: {what or 'same'}", flush=True)
    print(bad, "differ")
