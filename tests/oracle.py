"""Runs a query and its SQL, and compares rows without regard to order."""

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda x: "nan" if isinstance(x, float) and x != x else repr(x.item() if isinstance(x, np.generic) else x)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False, name=None))


def compare(spark, query, sql, sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(sql).to_arrow_table()
    got = query(spark, sf).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got.to_pandas(date_as_object=True)) == rows(want.to_pandas(date_as_object=True))
