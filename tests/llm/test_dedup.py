import random

import pyarrow as pa
from pyspark.sql import functions as F

from lipigraph.llm import dedup

COLUMNS = "id string, source_lang string, target_lang string, domain string, subdomain string, source_text string, target_text string, key int, first string"


def rows(texts, lang="en"):
    return [(f"r{i:04d}", lang, "ne", "d", None, s, t, i, "x") for i, (s, t) in enumerate(texts)]


def copies(spark, data):
    return {tuple(r) for r in dedup.copies(spark.createDataFrame(data, COLUMNS)).collect()}


def test_layout_alone_is_forgiven(spark):
    data = rows([
        ("Fee: NPR 7,450; Payer: desk", "क"), ("PAYER: desk |  fee: NPR 7,450", "क।"), ("Payer: desk\nFee: NPR 7,450", "क"), ("Fee: desk; Payer: NPR 7,450", "क"),
        ("See the file.", "ख"), (' "see   THE\tfile" ', "ख !"), ("See the file 2", "ख"), ("Sее the file.", "ख"), ("See the files.", "ख"),
    ])
    assert copies(spark, data) == {("r0000", "r0001"), ("r0000", "r0002"), ("r0004", "r0005")}


def test_nulls_empties_repeats_and_scope(spark):
    data = rows([(None, "a"), (None, "a"), ("", "a"), ("", "a"), ("same", None), ("same", None)])
    data += [("r0100", None, "ne", "d", None, "same", "t", 0, "x"), ("r0101", "en", "ne", "d", None, "same", "t", 0, "x"), (None, "en", "ne", "d", None, "same", "t", 0, "x")]
    data += [data[0]]
    assert copies(spark, data) == {("r0000", "r0001"), ("r0002", "r0003"), ("r0004", "r0005")}
    counted = {r.keep_id: r.n_copies for r in dedup.representatives(spark.createDataFrame(data, COLUMNS)).collect()}
    assert counted["r0000"] == 3 and counted["r0101"] == 1 and None not in counted
    assert copies(spark, []) == set()


def test_hot_group_over_many_partitions(spark):
    rng = random.Random(3)
    data = rows([("hot text", "t") if rng.random() < 0.4 else (f"text {rng.randrange(200)}", "t") for _ in range(3000)])
    df = spark.createDataFrame(data, COLUMNS).repartition(7)
    got = {tuple(r) for r in dedup.copies(df).collect()}
    groups = {}
    for r in data:
        groups.setdefault(r[5], []).append(r[0])
    assert got == {(min(v), i) for v in groups.values() for i in v if i != min(v)}


def test_scan_across_batches():
    keys = ["a", "a", "b", "b", "b", "c", "d", "d"]
    for cut in ([1, 2, 8], [2, 5, 8], [3, 4, 6, 8], [8]):
        batches, at = [], 0
        for c in cut:
            batches.append(pa.RecordBatch.from_pydict({"id": [str(i) for i in range(at, c)], "key": keys[at:c]}))
            at = c
        out = [r for b in dedup.Scan(0, True)(iter(batches)) for r in b.to_pylist()]
        assert [(r["first"], r["n"], r["key"]) for r in out if r["n"]] == [("0", 2, "a"), ("2", 3, None), ("5", 1, None), ("6", 2, "d")]
        assert [(r["first"], r["id"]) for r in out if not r["n"]] == [("0", "1"), ("2", "3"), ("2", "4"), ("6", "7")]


def test_one_run_over_a_whole_partition_and_none():
    rows = lambda batches: [r for b in dedup.Scan(1, True)(iter(batches)) for r in b.to_pylist()]
    one = pa.RecordBatch.from_pydict({"id": ["a", "a", "b"], "key": ["k"] * 3})
    assert [(r["id"], r["n"], r["key"]) for r in rows([one, one])] == [("b", None, None), ("a", None, None), ("b", None, None), (None, 6, "k")]
    assert rows([]) == []


def test_punctuation_inside_words_and_long_labels(spark):
    label = "a label of more than forty characters that goes on and on"
    data = rows([("Send an e-mail, NPR 7,450", "t"), ("send an email NPR 7450", "t"), ("Send an e mail NPR 7450", "t"), (f"{label}: 1; b: 2", "t"), (f"b: 2 | {label}: 1", "t"), ("one,two + $3", "t"), ("one, two 3", "t"), ("onetwo 3", "t")])
    assert copies(spark, data) == {("r0000", "r0001"), ("r0003", "r0004"), ("r0005", "r0006")}


def test_long_text(spark):
    long = "word " * 60_000
    assert copies(spark, rows([(long, "t"), (long.upper(), "t"), (long + "x", "t")])) == {("r0000", "r0001")}
    assert dedup.keyed(spark.createDataFrame(rows([(long, "t")]), COLUMNS)).select(F.length("key")).first()[0] > 250_000
