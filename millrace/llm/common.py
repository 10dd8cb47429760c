"""What several operators share: the shared folder, written tables, and look-ups that a hot key cannot clog."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts into which a look-up deals the rows of one key.
SALTS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one machine gets a fresh local one, a cluster an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written once in the shared folder: lineage ends there and lost executors don't take it along."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def salt_of(*cols: Column) -> Column:
    """The part, 0 to SALTS - 1, into which a row goes, whatever its key."""
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def keyed_summary(rows: DataFrame, keys: Sequence[str], salt: str, partial: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """One row for each (key, salt) that occurs, with the aggregates of the whole key.

    partial: name -> aggregate over rows; final: name -> aggregate over the partial names. Both steps combine before they
    shuffle, and the second sees at most SALTS rows of a key, so that no key fills a task. Joining rows with the result on
    keys and salt spreads a hot key over SALTS parts. Null keys don't join; encode them before."""
    parts = rows.groupBy(*keys, salt).agg(*(c.alias(n) for n, c in partial.items()))
    whole = parts.groupBy(*keys).agg(*(c.alias(n) for n, c in final.items()), F.collect_list(salt).alias("__salts"))
    return whole.select(*keys, *final, F.explode("__salts").alias(salt))


def row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart: a digest of id and text; null and empty differ."""
    part = lambda c: F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit(""))
    return F.unhex(F.sha2(F.concat_ws("/", part(id_col), part(text_col)), 256))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose row_key is in kept(__key), one of each key, with all their columns, whatever these are called."""
    rows = docs.select(row_key(id_col, text_col).alias("__key"), F.struct("*").alias("__row"))
    return rows.join(kept.select("__key"), "__key", "left_semi").dropDuplicates(["__key"]).select("__row.*")
