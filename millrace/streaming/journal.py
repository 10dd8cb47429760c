"""A journal that a stream writes exactly once over restarts, and the check that what it holds is the beginning of its cohort.

A journal is a folder of Parquet tables, one a batch, `batch=<id>`, and the identity of the run that writes it. The stream numbers its
batches in its checkpoint; a batch that was killed before the stream noted it is made again under the same number and replaces what
it had written. Another identity than the journal's is refused; the old one can be moved aside first."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def identity_of(fields: Mapping[str, object]) -> str:
    return json.dumps(dict(fields), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def claimed(spark: SparkSession, path: str, fields: Mapping[str, object], archive: str | None = None) -> None:
    """Makes the journal at `path` that of a run with this identity. A journal of another one is an error, or with `archive` is moved there."""
    at, store = _store(spark, path)
    wanted = identity_of(fields)
    if store.exists(at):
        row = spark.read.text(f"{path}/_identity").first()
        if row and row["value"] == wanted:
            return
        if archive is None:
            raise ValueError(f"{path} is the journal of another run: {row and row['value']}")
        if not store.rename(at, spark._jvm.org.apache.hadoop.fs.Path(archive)):
            raise ValueError(f"{path} can't be moved to {archive}")
    spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_identity")


def journal_writer(stream: DataFrame, path: str, build: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataStreamWriter:
    """A stream's writer into a claimed journal: each batch, as `build` makes it, is one table. Its checkpoint stands beside the journal;
    start it again with the same path to go on."""

    def one(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{path.rstrip('/')}.checkpoint")


def journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The journal's rows, with `batch`; empty before the first batch."""
    at, store = _store(spark, path)
    if not store.exists(at) or not any(f.getPath().getName().startswith("batch=") for f in store.listStatus(at)):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").option("basePath", path).parquet(f"{path}/batch=*")


def resumed(cohort: DataFrame, done: DataFrame, id_col: str, place: str) -> DataFrame:
    """cohort(id, place from 0, ...), done: the rows of a journal with both -> the cohort's rows that are still to do. A journal whose rows
    aren't the cohort's first, each once, is an error that names the first fault: repeated, strange, moved or gap."""
    known = cohort.select(F.col(id_col).alias("__id"), F.col(place).alias("__place"))
    rows = done.select(F.col(id_col).alias("__done"), F.col(place).alias("__at"))
    met = rows.join(known, F.col("__done").eqNullSafe(F.col("__id")), "left")
    fault = F.when(F.col("__place").isNull(), "strange").when(F.col("__place") != F.col("__at"), "moved")
    bad = met.withColumn("fault", fault).where("fault is not null").select("__done", "fault").limit(1).collect()
    many = rows.groupBy("__done").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("__at").alias("last")).first()
    if many or bad or size["n"] and size["last"] != size["n"] - 1:
        what, where = ("repeated", many[0]["__done"]) if many else (bad[0]["fault"], bad[0]["__done"]) if bad else ("gap", size["last"])
        raise ValueError(f"the journal is no beginning of the cohort: {what} at {where}")
    return cohort.where(F.col(place) >= size["n"])
