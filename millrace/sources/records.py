"""Readers and writers of record files: JSON lines, JSON in Parquet, delimited tables, journals and embedding shards."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines or Parquet by extension. Strict: a malformed line fails the job; else it comes with nulls and `_corrupt`."""
    if path.rstrip("/").endswith(".parquet"):
        found = spark.read.parquet(path)
        if found.columns == ["record_json"]:
            return found.select(F.from_json("record_json", schema).alias("r")).select("r.*")
        return found
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A delimited file with a header; the schema's names must be the header's."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("enforceSchema", False).csv(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, offset, raw, record, valid) of each line of JSON line files: record is null where the line isn't valid, raw its first
    2,000 characters; blank lines are left out. offset: an order of lines within a file, by where its split begins and the place there."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("offset"), "value").where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = lines.withColumn("r", parsed).withColumn("valid", F.col("r").isNotNull() & F.col("r._corrupt").isNull() & F.trim("value").startswith("{"))
    return out.select("file", "offset", F.left("value", F.lit(2000)).alias("raw"), F.when(F.col("valid"), F.col("r").dropFields("_corrupt")).alias("record"), "valid")


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The complete lines of a journal: a last line that a crash cut, one without its line end, is left out; any other broken line is an
    error, the last one too.

    Lines are read in splits of the files, so that a journal may be of any length. Where a file's lines, each with its end, have one byte
    more than the file, the last one has no end."""
    lines = read_lines(spark, path, schema)
    last = lines.groupBy("file").agg(F.max("offset").alias("__last"))
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), (F.octet_length("value") + 1).alias("n"))
    cut = raw.groupBy("file").agg((F.sum("n") == F.max("size") + 1).alias("__cut"))
    kept = lines.join(last.join(cut, "file"), "file").where(~F.col("__cut") | (F.col("offset") != F.col("__last")))
    return kept.select(F.when(F.col("valid"), F.col("record")).otherwise(F.raise_error(F.concat(F.lit("malformed line in "), F.col("file")))).alias("r")).select("r.*")


def read_table_checked(spark: SparkSession, path: str, columns: list[str], tests: dict[str, Column], sep: str = "\t") -> DataFrame:
    """A delimited file with its header's columns as strings and `violations`, the sorted names of the tests that a row fails. Other
    columns in the header are an error."""
    found = spark.read.option("header", True).option("sep", sep).csv(path)
    if found.columns != columns:
        raise ValueError(f"the header is {found.columns}, not {columns}")
    return found.withColumn("violations", F.array_sort(F.array_compact(F.array(*(F.when(~F.coalesce(t, F.lit(False)), n) for n, t in tests.items())))))


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; null fields show. Refuses to overwrite."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_json_parquet(df: DataFrame, path: str) -> None:
    """One column record_json in zstd Parquet, with sorted keys; an empty table gives a readable one. Refuses to overwrite."""
    out = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("record_json"))
    out.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_form(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header, of these columns in this order. Refuses to overwrite."""
    df.select(*columns).write.mode("errorifexists").option("header", True).csv(path)


def packets(items: DataFrame, text_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary(passage_id, text), items with passage_id in place of the text): each different text once; ids are digests, so that
    they are the same in any partitioning."""
    keyed = items.withColumn("passage_id", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return keyed.select("passage_id", F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).dropDuplicates(["passage_id"]), keyed.drop(text_col)


def unpacked(dictionary: DataFrame, items: DataFrame, text_col: str) -> DataFrame:
    """packets() undone; an item whose passage is missing is an error."""
    known = dictionary.select("passage_id", F.col(text_col).alias("__t"))
    return items.join(known, "passage_id", "left").withColumn(text_col, F.when(F.col("__t").isNotNull(), F.col("__t")).otherwise(F.raise_error(F.lit("a passage is missing")))).drop("__t", "passage_id")


def freeze(df: DataFrame, path: str, columns: list[str]) -> dict:
    """Writes df once, and beside it a manifest (rows, digest of the rows as a set); returns it."""
    from ..operators.records import records_digest

    write_once(df.select(*columns), f"{path}/rows")
    row = records_digest(df, columns).first()
    manifest = df.sparkSession.createDataFrame([(row["n"], row["digest"], ",".join(columns))], "n long, digest string, columns string")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return {"n": row["n"], "digest": row["digest"]}


def load_frozen(spark: SparkSession, path: str) -> DataFrame:
    """A frozen table; rows that don't give the manifest's count and digest are an error."""
    from ..operators.records import records_digest

    want = spark.read.json(f"{path}/manifest").first()
    found = spark.read.parquet(f"{path}/rows")
    row = records_digest(found, want["columns"].split(",")).first()
    if (row["n"], row["digest"]) != (want["n"], want["digest"]):
        raise ValueError(f"{path} isn't what was frozen: {row['n']} rows against {want['n']}")
    return found


def append_journal(done: DataFrame, work: DataFrame, key: str) -> DataFrame:
    """The rows of work that a journal doesn't hold yet; a journal with keys that aren't in work is an error of its own run."""
    strange = done.select(key).join(work.select(key), key, "left_anti").select(F.col(key).cast("string").alias("__s")).limit(1)
    if row := strange.first():
        raise ValueError(f"the journal holds {row['__s']}, which is no part of this work")
    return work.join(done.select(key), key, "left_anti")


def write_once(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Refuses to overwrite; Spark's committer publishes the files as a whole."""
    df.write.mode("errorifexists").format(kind).save(path)


def embeddings(spark: SparkSession, path: str, vector_col: str) -> tuple[DataFrame, dict[str, int]]:
    """A folder of embedding shards shard-0, shard-1, ... with their row count and dimension. Unequal dimensions are an error, and
    so are numbers that are missing between the first and the last shard."""
    found = spark.read.parquet(path)
    names = sorted({int(m) for f in found.inputFiles() for m in re.findall(r"shard-(\d+)", f)})
    if names and names != list(range(names[-1] + 1)):
        raise ValueError(f"shards are missing: {sorted({*range(names[-1] + 1)} - {*names})}")
    row = found.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vector_col)).alias("lo"), F.max(F.size(vector_col)).alias("hi")).first()
    if row["lo"] != row["hi"]:
        raise ValueError(f"vectors have {row['lo']} to {row['hi']} dimensions")
    return found, {"rows": row["n"], "dimensions": row["lo"]}
