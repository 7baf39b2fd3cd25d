"""A query's rows beside those of its SQL in DuckDB."""

import os
from collections import Counter

import duckdb

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def both(made, sql, sf_dir=None, **tables):
    """Counters of rows, columns by name; tables: name -> pandas or Arrow table in place of the files of sf_dir."""
    con = duckdb.connect()
    for t in TABLES:
        if t in tables:
            con.register(t, tables[t])
        elif sf_dir:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet{'/*' if os.path.isdir(f'{sf_dir}/{t}.parquet') else ''}'")
    found = con.sql(sql)
    order = sorted(made.columns)
    assert sorted(found.columns) == order
    want = Counter(tuple(r) for r in found.select(*order).fetchall())
    return Counter(tuple(r[c] for c in order) for r in made.collect()), want
