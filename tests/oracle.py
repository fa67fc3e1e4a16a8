"""Run a query and its SQL twin over the same tables and compare all rows."""

from decimal import Decimal

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    """Rows in one order, each value as its text; numbers with fractions as floats, whatever their type."""
    return sorted(tuple(str(float(x)) if isinstance(x, (float, Decimal)) else str(x) for x in r) for r in rows)


def same_rows(spark, query, sql, sf=SF):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = query(spark, sf)
    names = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert plain(map(tuple, df.select(*names).collect())) == plain(want)
