"""What grows with the input doesn't go through the driver."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import dedup, reports, splits
from millrace.plans import everything as catalog


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_components_are_not_broadcast(spark):
    rows = spark.createDataFrame([(i, [f"d{i // 3}", f"d{i % 7}"]) for i in range(60)], "example_id long, ids array<string>")
    records = rows.select("example_id", F.transform("ids", lambda i: F.struct(i.alias("doc_id"))).alias("positives"))
    found = splits.record_components(records)
    assert "BroadcastHashJoin" not in plan(found) and found.select("component").distinct().count() == 1
    edges = spark.range(30_000).select((2 * F.col("id")).alias("a"), (2 * F.col("id") + 1).alias("b"))
    assert dedup.components(edges).groupBy("root").count().agg(F.min("count"), F.max("count"), F.count("root")).first()[:] == (2, 2, 30_000)
    parts = splits.balanced_components(records, {"train": 0.8, "test": 0.2})
    assert "BroadcastHashJoin" not in plan(parts)


def test_margin_scales_rank_counts(spark):
    rng = random.Random(5)
    values = {g: [rng.choice([1.5, 2.0, rng.random() * 9]) for _ in range(n)] for g, n in (("a", 1), ("b", 4), ("c", 101), (None, 30))}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("d", None), ("e", 2.0), ("e", 2.0), ("c", None)], "g string, v double")
    got = {r["g"]: r["scale"] for r in reports.margin_scales(rows, "g", "v").collect()}
    want = {g: np.quantile(vs, 0.75) - np.quantile(vs, 0.25) for g, vs in values.items()}
    assert got.keys() == {*want, "d", "e"} and got["a"] is None and got["d"] is None and got["e"] is None
    assert all(math.isclose(got[g], want[g]) for g in ("b", "c", None))


def test_query_labels_read_a_text_once(spark):
    spark_plan = catalog.queries()["query_labels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert spark_plan.count("regexp_extract_all") == 1
