"""Spark rows against DuckDB rows of one query, order aside."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False, name=None):
        row = []
        for v in r:
            if isinstance(v, float):
                v = None if v != v else round(v, 6) + 0.0
            if hasattr(v, "tolist"):
                v = v.tolist()
            row.append(repr(v))
        out.append(tuple(row))
    return sorted(out)


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def same(spark, sf, query, sql):
    got = query(spark, sf).toPandas()
    want = connect(sf).execute(sql).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
