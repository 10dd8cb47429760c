"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own under spark.checkpoint.dir; where that is unset, one machine gets a fresh folder, a cluster an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/millrace/{context.applicationId}/{name}-{uuid.uuid4().hex}"


def cleared(spark: SparkSession) -> None:
    """Removes the tables that this application's operators have written so far. Results that aren't read yet can't be read after it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "t")).getParent()
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a table written once: lineage ends there."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """rows with their places from 0 in the given order; what it can't tell apart is in any order. A range shuffle: no task sees more than
    its part, and the driver a number for each part."""
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    spread = rows.sparkSession.createDataFrame(starts or [(0, 0)], "__part long, __before long")
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(spread), "__part").withColumn(name, F.col("__before") + local).drop("__at", "__part", "__before")


def ranked_within(rows: DataFrame, by: Sequence[str], *order: Column | str, name: str = "place") -> DataFrame:
    """rows with their places from 0 in the order within their group, and `group_size`. All rows are ranked at once, and a group's places
    begin where its first row stands, so that no group is one task's. Null is a group as any other."""
    found = ranked(rows, *by, *order, name=name)
    if not by:
        return found.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("group_size"))))
    groups = found.groupBy(*(F.col(b).alias(f"__by_{k}") for k, b in enumerate(by))).agg(F.min(name).alias("__first"), F.count(F.lit(1)).alias("group_size"))
    same = F.lit(True)
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by_{k}"))
    return found.join(groups, same).withColumn(name, F.col(name) - F.col("__first")).drop("__first", *(f"__by_{k}" for k in range(len(by))))
