"""Rows of a query and of its SQL, in one comparable form."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(x):
        return "NULL" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)

    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


def sql_rows(sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = c.sql(sql)
    return normal(got.fetchall(), got.columns)


def spark_rows(df):
    return normal([tuple(r) for r in df.collect()], df.columns)
