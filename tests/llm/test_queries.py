"""Queries of the training-data problems with SQL give the rows that DuckDB gives; the others run over whole tables."""

import glob
import os

import duckdb
import pytest

from lipigraph.llm import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    if name in queries.ORACLE:
        con = duckdb.connect()
        for p in glob.glob(f"{DIR}/*.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        want = con.sql(queries.ORACLE[name])
        assert sorted(want.columns) == columns and got == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())
    elif name.endswith("_found"):
        assert len(set(got)) == len(got)


def test_the_key_of_pseudonyms(spark):
    first = queries.secret(spark)
    assert first == queries.secret(spark) and len(first) == 32
    spark.conf.set("spark.lipigraph.pii.key", "a secret")
    try:
        own = queries.secret(spark)
        assert own == queries.secret(spark) != first
    finally:
        spark.conf.unset("spark.lipigraph.pii.key")
