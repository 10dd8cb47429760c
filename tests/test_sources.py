import pytest
from pyspark.sql import functions as F

from millrace.sources import records as R
from millrace.streaming import ledger


def test_journal_drops_only_a_cut_tail(spark, tmp_path):
    path = tmp_path / "j.jsonl"
    path.write_text('{"i": 1}\n{"i": 2}\n{"i": 3')
    assert sorted(r["i"] for r in R.read_journal(spark, str(path), "i int").collect()) == [1, 2]
    path.write_text('{"i": 1}\n{"i": \n{"i": 3}\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        R.read_journal(spark, str(path), "i int").collect()


def test_journal_keeps_whole_lines_only(spark, tmp_path):
    """A last line without its end goes, valid or not; a broken line that has one is an error, the last one too."""
    path, read = tmp_path / "j.jsonl", lambda: sorted(r["i"] for r in R.read_journal(spark, str(path), "i int").collect())
    for text, want in (('{"i": 1}\n{"i": 2}', [1]), ('{"i": 1}\r\n{"i": 2}\r\n', [1, 2]), ('{"i": 1}\n\n{"i": 2}\n\n', [1, 2]), ("", []), ('{"i": 7}', []), ('{"i": 1, "t": "é"}\n', [1])):
        path.write_bytes(text.encode())
        assert read() == want, text
    path.write_text('{"i": 1}\n{"i": \n')
    with pytest.raises(Exception, match="malformed"):
        read()


def test_records_strict_and_tolerant(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"i": 1}\nbroken\n')
    rows = R.read_records(spark, str(path), "i int", strict=False).collect()
    assert [r["i"] for r in rows] == [1, None] and rows[1]["_corrupt"] == "broken"
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        R.read_records(spark, str(path), "i int").collect()


def test_write_once(spark, tmp_path):
    R.write_once(spark.range(3), str(tmp_path / "x"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        R.write_once(spark.range(3), str(tmp_path / "x"))


def test_stream_equals_table(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type", "value")
    table.write.parquet(str(tmp_path / "in"))
    stream = ledger.usage(ledger.tail(spark, str(tmp_path / "in"), table.schema), "event_type", "ts", "value")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("usage_test").start()
    q.processAllAvailable()
    q.stop()
    got = {(r[0], r[1], r[2]) for r in spark.sql("select window_start, event_type, requests from usage_test").collect()}
    want = {(r[0], r[1], r[2]) for r in ledger.usage(table, "event_type", "ts", "value").select("window_start", "event_type", "requests").collect()}
    assert got == want


def test_frozen_tables_journals_and_sinks(spark, tmp_path):
    import json

    import pytest

    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    R.freeze(df, f"{tmp_path}/frozen", ["i", "t"])
    assert R.load_frozen(spark, f"{tmp_path}/frozen").count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        R.freeze(df, f"{tmp_path}/frozen", ["i", "t"])
    df.union(df).write.mode("overwrite").parquet(f"{tmp_path}/frozen/rows")
    with pytest.raises(ValueError):
        R.load_frozen(spark, f"{tmp_path}/frozen")
    R.write_json_lines(df, f"{tmp_path}/lines")
    lines = [x["value"] for x in spark.read.text(f"{tmp_path}/lines").collect()]
    assert sorted(lines) == ['{"i":1,"t":"a"}', '{"i":2,"t":null}'] and all(list(json.loads(x)) == ["i", "t"] for x in lines)
    R.write_json_parquet(df.limit(0), f"{tmp_path}/packed.parquet")
    assert R.read_records(spark, f"{tmp_path}/packed.parquet", "i int, t string").count() == 0
    R.write_form(df, f"{tmp_path}/form", ["t", "i"])
    assert R.read_table(spark, f"{tmp_path}/form", "t string, i int").count() == 2
    checked = R.read_table_checked(spark, f"{tmp_path}/form", ["t", "i"], {"has_text": R.F.col("t").isNotNull(), "small": R.F.col("i").cast("int") < 2}, ",")
    assert sorted(tuple(r["violations"]) for r in checked.collect()) == [(), ("has_text", "small")]
    with pytest.raises(ValueError):
        R.read_table_checked(spark, f"{tmp_path}/form", ["i", "t"], {}, ",")
    assert [r["i"] for r in R.append_journal(df.where("i = 1"), df, "i").collect()] == [2]
    with pytest.raises(ValueError):
        R.append_journal(spark.createDataFrame([(9,)], "i int"), df, "i")


def test_shards_must_be_contiguous(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1, [1.0, 2.0])], "i int, v array<float>")
    for k in (0, 1, 3):
        df.write.parquet(f"{tmp_path}/e/shard-{k}")
    with pytest.raises(ValueError, match="missing"):
        R.embeddings(spark, f"{tmp_path}/e/*", "v")
