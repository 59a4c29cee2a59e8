"""Rows of a query and of its SQL, to be held against each other."""

from pathlib import Path

import duckdb

TABLES = "documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if path.is_file() else path / '*.parquet'}'")
    cursor = con.execute(f"SELECT * FROM ({sql})")
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(r[k] for k in order) for r in cursor.fetchall()), key=repr)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
