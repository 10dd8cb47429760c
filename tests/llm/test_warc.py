"""Records and archives round-trip; look-ups find every capture of a URL."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import warc as W
from millrace.llm.common import fresh_path


def key(x):
    return -1 if x is None else x


def brute(rows, least=W.LEAST):
    """rows [(id, html)] -> sorted (id, bytes, sha1) and, of unique ids, (type, refers to)."""
    best = {}
    for i, h in rows:
        if len((h or "").encode()) >= least:
            best[h] = max(best.get(h, -1), key(i))
    return sorted((key(i), len(b := (h or "").encode()), hashlib.sha1(b).hexdigest()) for i, h in rows), {i: ("revisit", best[h]) if best.get(h, key(i)) != key(i) else ("response", None) for i, h in rows}


def test_record():
    for payload in (b"", "é\r\n\r\nx".encode(), b"a" * 5000):
        got = W.parse(W.record(7, "http://e.example/ü\r\nX: y", payload, None))
        assert got["payload"] == payload and W.described(got) == ("7", len(payload), hashlib.sha1(payload).hexdigest(), "response", None)
        got = W.described(W.parse(W.record(7, None, payload, 9, revisit=True)))
        assert got == ("7", len(payload), hashlib.sha1(payload).hexdigest(), "revisit", "9")


@pytest.mark.parametrize("url,want", [("http://a.b.example:80/x?q=1#f", "example,b,a)/x?q=1"), ("https://A.example", "example,a)/"), (None, ""), ("nonsense", "nonsense"), ("http://[bad/", "http://[bad/"), ("https://e.example:8443/", "example,e:8443)/")])
def test_key(url, want):
    assert W.reversed_host_key(url) == want


def test_round_trip_and_look_up(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    twice = pages.union(pages.select((F.col("page_id") + 100_000).alias("page_id"), "url", "html"))
    folder = fresh_path(spark, "warc-test")
    index = W.build_index(W.write_archives(twice, folder), block=16)
    rows = twice.collect()
    want, kinds = brute([(r["page_id"], r["html"]) for r in rows])
    assert index.agg(F.sum("lines"), F.count("*")).first()[0] == len(rows) and index.count() > 5
    keys = W.url_keys(twice)
    got = W.read_archives(W.find(index, keys.select("key").distinct().withColumn("url", F.lit("u"))), folder).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == want
    assert {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got} == kinds and len(got) == len(rows)
    urls = twice.select("url").distinct().union(spark.createDataFrame([("http://nowhere.example/x",), (None,)], "url string"))
    found = W.look_up(index, folder, urls).collect()
    captured = {}
    for r in rows:
        captured.setdefault(W.reversed_host_key(r["url"]), []).append(r)
    expected = sorted((u["url"], str(r["page_id"])) for u in twice.select("url").distinct().collect() for r in captured[W.reversed_host_key(u["url"])])
    assert sorted((r["url"], r["page_id"]) for r in found) == expected
    html = {str(r["page_id"]): r["html"] for r in rows}
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") and (r["payload"] is None or bytes(r["payload"]).decode() == html[r["page_id"]]) for r in found)


def test_record_ids_are_unique(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    twice = pages.union(pages).union(pages.select((F.col("page_id") + 100_000).alias("page_id"), "url", "html"))
    folder = fresh_path(spark, "warc-ids")
    entries = W.find(W.build_index(W.write_archives(twice, folder)), W.url_keys(twice).select("key").distinct().withColumn("url", F.lit("u")))
    got = W.read_records(entries, folder, lambda _, r: (r["headers"]["WARC-Record-ID"], r["headers"].get("WARC-Refers-To"), r["headers"]["WARC-Type"]), "i string, refers string, kind string").collect()
    ids = {r["i"] for r in got}
    assert len(ids) == len(got) == twice.count()
    kinds = {r["i"]: r["kind"] for r in got}
    assert all(kinds[r["refers"]] == "response" for r in got if r["kind"] == "revisit") and sum(r["kind"] == "revisit" for r in got) > pages.count()


def test_absent_and_hot_keys(spark):
    """One key over many blocks; many keys that aren't there."""
    rows = [(k, "http://hot.example/", f"<p>{k}") for k in range(300)] + [(1000 + k, f"http://a{k}.example/", "x") for k in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = fresh_path(spark, "warc-hot")
    index = W.build_index(W.write_archives(pages, folder), block=16)
    urls = spark.range(3000).select(F.format_string("http://b%s.example/", "id").alias("url")).union(spark.createDataFrame([("http://hot.example",), ("http://a7.example/",)], "url string"))
    got = sorted((r["url"], int(r["page_id"])) for r in W.look_up(index, folder, urls).collect())
    assert got == [("http://a7.example/", 1007)] + [("http://hot.example", k) for k in range(300)]


def test_urls_with_any_character(spark):
    """NUL, line ends, tabs, escapes and non-URLs: archives round-trip, and look-ups give each URL its own captures, over many blocks."""
    urls = ["http://e.example/\0x", "a\0b", "\0", *(f"a\n{k}" for k in range(9)), "a b", "a c", "a\tb", "a\nb", "a%0Ab", "a%0A", "%0A", "a\x7f", "é\u2028ü", "::", "http://e.example/a\nb", "http://e.example/ab", " http://e.example/ab", "a" * 5000]
    rows = [(k, u, f"<p>{k}") for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r["page_id"] for r in W.round_trip(pages).collect()) == list(range(len(urls)))
    folder = fresh_path(spark, "warc-urls")
    index = W.build_index(W.write_archives(pages, folder), block=4)
    got = sorted((r["url"], int(r["page_id"])) for r in W.look_up(index, folder, pages).collect())
    assert len({W.reversed_host_key(u) for u in urls}) == len(urls) - 1 and W.reversed_host_key("a%0A") != W.reversed_host_key("a\n0")
    assert got == sorted((u, k) for u in urls for k, v in enumerate(urls) if W.reversed_host_key(u) == W.reversed_host_key(v))


def test_many_rows_with_the_largest_id(spark):
    """Rows that repeat the largest id of a payload: one is the response, the others revisit it."""
    rows = [(9, f"http://a.example/{k % 3}" if k % 2 else None, "x" * 2000) for k in range(400)] + [(1, "u", "x" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = W.round_trip(pages).collect()
    assert len(got) == 401 and sum(r["record_type"] == "response" for r in got) == 1 and {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {9}


def test_odd_rows(spark):
    big = "<p>" + "é" * 60_000
    rows = [(None, None, None), (1, None, ""), (2, "http://a.example/\t\n", "x"), (3, "http://a.example/", big), (3, "http://a.example/", big), (4, "", big), (None, "http://b.example", big), (5, "::", "<|>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("id", "order", "payload", "uid", "content", "salt", "best", "large")})
    got = W.round_trip(pages).collect()
    assert sorted((key(r[0]), r[1], r[2]) for r in got) == brute([(r[0], r[2]) for r in rows])[0]
    assert sorted((key(r["page_id"]), r["refers_to"]) for r in got if r["record_type"] == "revisit") == [(-1, 4), (3, 4), (3, 4)]
    assert W.round_trip(pages.limit(0)).count() == 0
