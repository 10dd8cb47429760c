"""Splits that leak nothing, overlap between data sets, and clusters within small groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import dedup
from .assignment import balanced_splits
from .tables import written


def record_components(records: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """records(example_id, positives of doc_id) -> (example_id, component): records that share a positive, directly or over
    others, are one component, named by its least node. canonical(doc_id, canonical): documents that count as one."""
    links = records.select("example_id", F.explode("positives.doc_id").alias("doc_id"))
    if canonical is not None:
        links = links.join(canonical, "doc_id", "left").select("example_id", F.coalesce("canonical", "doc_id").alias("doc_id"))
    edges = links.select(F.concat(F.lit("q:"), F.col("example_id").cast("string")).alias("a"), F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("b"))
    roots = dedup.components(edges).withColumnRenamed("node", "__node")
    own = records.select("example_id", F.concat(F.lit("q:"), F.col("example_id").cast("string")).alias("__node"))
    return own.join(roots.hint("merge"), "__node", "left").select("example_id", F.coalesce("root", "__node").alias("component"))


def drop_crossing_negatives(records: DataFrame, splits: DataFrame, least: int = 10) -> DataFrame:
    """records(example_id, positives, hard_negatives), splits(example_id, split) -> records with split, hard_negatives without
    documents that are a positive of another split, in order, `removed`, and `below`: fewer than `least` are left."""
    placed = written(records.join(splits, "example_id"), "placed")
    homes = placed.select("split", F.explode("positives.doc_id").alias("doc_id")).groupBy("doc_id").agg(F.min("split").alias("least"), F.max("split").alias("most"))
    each = placed.select("example_id", "split", F.posexplode("hard_negatives.doc_id").alias("at", "doc_id")).join(homes, "doc_id")
    crossing = each.where((F.col("least") != F.col("split")) | (F.col("most") != F.col("split"))).groupBy("example_id").agg(F.collect_set("at").alias("__ats"))
    out = placed.join(crossing, "example_id", "left")
    left = F.when(F.col("__ats").isNull(), F.col("hard_negatives")).otherwise(F.filter("hard_negatives", lambda d, i: ~F.array_contains(F.col("__ats"), i)))
    out = out.select(*(c for c in placed.columns if c != "hard_negatives"), left.alias("hard_negatives"), F.coalesce(F.size("__ats"), F.lit(0)).cast("long").alias("removed"))
    return out.withColumn("below", F.size("hard_negatives") < least)


def split_manifest(rows: DataFrame, id_col: str, split: str) -> DataFrame:
    """(split, n, share, digest of its ids whatever their order)."""
    each = rows.select(split, F.sha2(F.col(id_col).cast("string"), 256).alias("h")).withColumn("b", F.substring("h", 1, 3))
    parts = each.groupBy(split, "b").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("d"))
    out = parts.groupBy(split).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))
    return out.select(split, "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"), "digest")  # one row for each split


def exact_overlap(a: DataFrame, b: DataFrame, key: Column) -> DataFrame:
    """One row (left, right, shared): distinct keys of each side and of both."""
    keys = lambda df, n: df.select(F.sha2(key, 256).alias("k")).where("k is not null").distinct().withColumn(n, F.lit(1))
    both = keys(a, "l").join(keys(b, "r"), "k", "full")
    return both.agg(F.count("l").alias("left"), F.count("r").alias("right"), F.coalesce(F.sum((F.col("l") + F.col("r") == 2).cast("long")), F.lit(0)).alias("shared"))


def presence(rows: DataFrame, reference: DataFrame, id_col: str, ref_col: str, least: float) -> DataFrame:
    """One row (rows, present, share): how many rows have a near duplicate in the reference; arrays of distinct shingles."""
    hit = dedup.shingle_overlap(rows, reference, id_col, ref_col, least).select(id_col).distinct().agg(F.count(F.lit(1)).alias("present"))
    return rows.agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(hit)).select("rows", "present", F.try_divide("present", "rows").alias("share"))


def cluster_report(clusters: DataFrame, id_col: str, text_col: str, top: int = 50, members: int = 5, chars: int = 300) -> DataFrame:
    """clusters(canonical, id_col, text_col) -> (rank, canonical, size, previews): the `top` largest, ties by id, each with the first
    characters of its first members. Members are ranked within a cluster's parts first, so that a large one is no task's."""
    sizes = clusters.groupBy("canonical").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "canonical").limit(top)
    mine = clusters.join(F.broadcast(sizes), "canonical").withColumn("__part", F.pmod(F.xxhash64(id_col), F.lit(64)))
    few = mine.withColumn("__i", F.row_number().over(Window.partitionBy("canonical", "__part").orderBy(id_col))).where(F.col("__i") <= members)
    first = few.withColumn("__i", F.row_number().over(Window.partitionBy("canonical").orderBy(id_col))).where(F.col("__i") <= members)
    shown = first.groupBy("canonical", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", F.left(F.col(text_col), F.lit(chars)).alias("t")))), lambda x: x["t"]).alias("previews"))
    return shown.select(F.row_number().over(Window.orderBy(F.desc("size"), "canonical")).cast("long").alias("rank"), "canonical", "size", "previews")  # `top` rows


def cluster_sizes(clusters: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """wanted(id_col) with the size of their clusters; clusters(id_col, canonical)."""
    mine = clusters.join(wanted.select(id_col).distinct(), id_col, "left_semi")
    sizes = clusters.join(mine.select("canonical").distinct(), "canonical", "left_semi").groupBy("canonical").agg(F.count(F.lit(1)).alias("size"))
    return mine.join(sizes, "canonical").select(id_col, "canonical", "size")


def first_of_key(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key by order, as min_by: no key's rows are sorted."""
    kept = rows.select(key.alias("__k"), F.struct("*").alias("__r")).groupBy("__k").agg(F.min_by("__r", F.col(f"__r.{order}")).alias("__r"))
    return kept.select("__r.*")


def scoring_pairs(rows: DataFrame, query: str, passage: str, width: int = 32) -> tuple[DataFrame, DataFrame]:
    """The distinct pairs with a pair_id and a length bucket (words of both, in steps of width), and rows with their pair_id: what is
    scored once, and how scores come back."""
    pair = F.sha2(F.concat_ws("\0", F.col(query), F.col(passage)), 256)
    keyed = rows.withColumn("pair_id", pair)
    n = F.size(T.words(F.col(query))) + F.size(T.words(F.col(passage)))
    return keyed.select("pair_id", query, passage).dropDuplicates(["pair_id"]).withColumn("bucket", F.floor(n / width)), keyed


def group_clusters(rows: DataFrame, group: str, position: str, text_col: str, least: float = 0.9) -> DataFrame:
    """rows with `cluster`, the least position that a row reaches in its group over equal texts or terms that are alike.

    Pairs are made within groups of a few candidates for one prompt."""
    t = rows.select(F.col(group).alias("g"), F.col(position).alias("i"), T.normal_form(F.col(text_col)).alias("f"), F.array_distinct(T.content(T.tokens(F.col(text_col)))).alias("t"))
    listed = t.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "f", "t"))).alias("m"))
    alike = lambda a, b: (a["f"] == b["f"]) | (T.jaccard(a["t"], b["t"], 1.0) >= least)
    found = listed.select("g", F.transform("m", lambda a: a["i"]).alias("i"), F.transform("m", lambda a: F.transform(F.filter("m", lambda b: alike(a, b)), lambda b: b["i"])).alias("links"))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, ids, links in zip(pdf["g"], pdf["i"], pdf["links"]):
                root = {i: i for i in ids}
                for _ in ids:  # a path has at most as many links as the group members
                    root = {i: min(root[j] for j in mine) for i, mine in zip(ids, links)}
                out += [(g, i, root[i]) for i in ids]
            yield pd.DataFrame(out, columns=["__g", "__i", "cluster"])

    types = {c: rows.schema[c].dataType.simpleString() for c in (group, position)}
    roots = found.mapInPandas(close, f"__g {types[group]}, __i {types[position]}, cluster {types[position]}")
    return rows.join(roots, rows[group].eqNullSafe(roots["__g"]) & rows[position].eqNullSafe(roots["__i"]), "left").drop("__g", "__i")


def semantic_clusters(rows: DataFrame, group: str, vector_col: str, least: float = 0.85) -> DataFrame:
    """(group, n, clusters, mean_cosine): how many clusters a group's vectors form by cosine at `least` or more, over chains of
    links. Groups of a few candidates; vectors that are null, zero or of another length than the group's first are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = [np.asarray(x, np.float64) for x in pdf["v"] if x is not None and len(x)]
        v = [x / n for x in v if len(x) == len(v[0]) and (n := np.linalg.norm(x)) > 0]
        if not v:
            return pd.DataFrame({group: [pdf["g"].iloc[0]], "n": [0], "clusters": [0], "mean_cosine": [None]})
        cosine = np.stack(v) @ np.stack(v).T
        reach = cosine >= least
        for _ in range(max(1, len(v).bit_length())):
            reach = (reach.astype(np.int64) @ reach.astype(np.int64)) > 0
        above = cosine[np.triu_indices(len(v), 1)]
        return pd.DataFrame({group: [pdf["g"].iloc[0]], "n": [len(v)], "clusters": [len({tuple(r) for r in reach.tolist()})], "mean_cosine": [float(above.mean()) if len(above) else None]})

    t = rows.schema[group].dataType.simpleString()
    return rows.select(F.col(group).alias("g"), F.col(vector_col).alias("v")).groupBy("g").applyInPandas(run, f"{group} {t}, n long, clusters long, mean_cosine double")


def leakage(train: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key, shared): for each key column how many of its values stand on both sides; no leak is a row with 0."""
    out = None
    for k in keys:
        both = train.select(k).distinct().join(other.select(k).distinct(), k, "left_semi").agg(F.count(F.lit(1)).alias("shared")).select(F.lit(k).alias("key"), "shared")
        out = both if out is None else out.unionByName(both)
    return out


def balanced_components(records: DataFrame, shares: dict[str, float], canonical: DataFrame | None = None, domain: str | None = None, seed: int = 42) -> DataFrame:
    """records -> (example_id, component, split): whole components go where the pressure of all records and of each domain is least."""
    placed = written(record_components(records, canonical), "record-components")
    kinds = records.select("example_id", (F.col(domain) if domain else F.lit("all")).alias("__domain"))
    splits = balanced_splits(placed.join(kinds.hint("merge"), "example_id"), "component", "__domain", shares, seed)
    return placed.join(splits.select("component", "split").hint("merge"), "component").select("example_id", "component", "split")
