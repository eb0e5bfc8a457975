"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import glob
import os

import duckdb
import pytest

from lipigraph.plans import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    df = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    if name in catalogue.ORACLE:
        want = sql.sql(catalogue.ORACLE[name])
        assert sorted(want.columns) == columns
        assert got == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_risk_follows_the_target_language(spark, tmp_path):
    entity = "array<struct<kind:string,text:string,start:int,end:int>>"
    hit = "array<struct<source_term:string,target_term:string,term_type:string>>"
    spark.createDataFrame([("a", "ne"), ("b", "en"), ("c", None)], "id string, target_lang string").write.parquet(f"{tmp_path}/document_summary.parquet")
    segments = [(x, x, "The fee is NPR 500", [], []) for x in "abcd"]
    spark.createDataFrame(segments, f"id string, document_id string, source_text string, protected_entities {entity}, glossary_hits {hit}").write.parquet(f"{tmp_path}/segments.parquet")
    spark.createDataFrame([(x, "शुल्क NPR 500 हो") for x in "abcd"], "segment_id string, candidate_text string").write.parquet(f"{tmp_path}/translations.parquet")
    scores = {r.id: r.risk_score for r in catalogue.risk_scored(spark, str(tmp_path)).collect()}
    got = {}
    for r in catalogue.risk_reasons(spark, str(tmp_path)).orderBy("place").collect():
        got.setdefault(r.id, []).append(r.code)
    assert {x for x, codes in got.items() if "currency_unlocalized" in codes} == {"a"}
    assert set(got) == set(scores) == set("abcd") and all(scores[x] == len(codes) for x, codes in got.items())
