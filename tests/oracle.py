"""Runs a query in Spark and its SQL in DuckDB and compares rows regardless of order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, cols):
    return sorted(map(repr, zip(*[cols[n] for n in names], strict=True)))


def check(spark, con, query, sql, sf_dir):
    got = query(spark, sf_dir).toArrow()
    want = con.sql(sql).to_arrow_table()
    names = sorted(want.column_names)
    assert names == sorted(got.column_names)
    assert [str(got.schema.field(n).type) for n in names] == [str(want.schema.field(n).type) for n in names]
    assert rows(names, {n: got[n].to_pylist() for n in names}) == rows(names, {n: want[n].to_pylist() for n in names})
