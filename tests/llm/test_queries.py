"""The registered queries equal their SQL; licences; the pipeline against its parts by brute force."""

import os

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import licenses, registry

from .test_quality_rules import features
from .test_simhash import brute, plain


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = con.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, found.select(*columns).fetchall()))


def test_licences(spark, odd):
    mit = licenses.KNOWN["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ;")), (3, mit + " and more"), (4, licenses.KNOWN["0BSD"].replace("authorize", "authorise")), (5, None), (6, ""), (7, "LICENCED under CC-BY NC 4.0!"), (7, "licensed under cc by nc 4.0")]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: "0BSD", 5: None, 6: None, 7: "CC-BY-NC-4.0-notice"}
    assert licenses.scanned(odd).count() == odd.count() and licenses.scanned(odd.limit(0)).count() == 0
    own = spark.createDataFrame([("b", "Some Text"), ("a", "some text!"), ("c", "")], "license_id string, text string")
    assert [r["license_id"] for r in licenses.scanned(spark.createDataFrame([(1, "SOME, text")], "doc_id long, text string"), own).collect()] == ["a"]


def test_pipeline_stages(spark, docs, sf):
    """Each stage on what the one before kept."""
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    found = stage["quality_rules"](spark, docs, sf)
    assert found.columns == docs.columns
    first = {r["doc_id"]: r["text"] for r in found.collect()}
    for r in docs.collect():
        w, *_, again, _ = features(r["text"])
        assert r["doc_id"] not in first or (w >= 50 and 2 * again <= w)
    second = stage["language_id"](spark, found, sf)
    assert second.columns == docs.columns and len(ids(second)) >= 0.97 * len(first)
    last = {}
    for r in second.collect():
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    third = stage["exact_dedup"](spark, second, sf)
    assert third.columns == docs.columns and ids(third) == sorted(last.values())
    fourth = stage["simhash_near_dedup"](spark, third, sf)
    assert fourth.columns == docs.columns and ids(fourth) == sorted(set(brute({i: plain(t) for t, i in last.items()}).values()))
    packed = stage["packing"](spark, fourth, sf)
    assert sorted({r["doc_id"] for r in packed.collect()}) == ids(fourth)


def test_pipeline_takes_odd_and_empty_tables(spark, odd, sf):
    for df in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf)
            assert name == "packing" or out.columns == odd.columns
            out.count()


def test_pipeline_runs(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "exact_dedup", "simhash_near_dedup", "packing"]
