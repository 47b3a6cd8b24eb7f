"""A query's rows against its SQL in DuckDB, on the same tables."""

import datetime
import decimal
import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in rows))


def compare(spark, f, sql, sf_dir):
    """(names, rows) of both, rows as sorted texts."""
    df = f(spark, str(sf_dir))
    con = connect(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return (sorted(df.columns), rows_of(df.columns, df.collect())), (sorted(names), rows_of(names, cur.fetchall()))
