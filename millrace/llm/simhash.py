"""SimHash near-deduplication through a segment-popcount embedding.

Fingerprints of 64 bits link at MOST or fewer differing bits. Copies share a fingerprint, so links are sought among distinct
fingerprints. A fingerprint maps to the bit counts of its 32 segments of two bits, a point whose Manhattan distance to
another is at most their Hamming distance. The 32 axes form B groups. Of two points at distance MOST or less at least
B - MOST groups are at distance 0, so the points share a grid cell: the counts on one choice of B - MOST groups.
Each point stands in every choice's cell, rows that meet in a cell are compared by Manhattan distance, then by differing bits.

Within a cell not all pairs are made. First each row is compared with a few hubs: the cell's least and most frequent
fingerprint and its neighbours in two orders; verified links form components. Then only cells that still hold several
components are looked at again: rows outside the cell's largest component are compared with the cell's rows of other
components. Every pair that links thus either is in one component by verified links already or is compared, so that the
components are exact.

Nulls: a null or wordless text has fingerprint zero, linked like any other; a null id orders below any other. Repeated rows
share a fingerprint. Extra columns don't matter."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_rows, keyed_summary, row_key, salt_of, written

#: Differing bits that still link.
MOST = 4
#: Groups of axes, and up to how many fingerprints: as cells have about 48 (1 - MOST / groups) bits. More groups make smaller cells
#: and more rows a fingerprint, C(groups, MOST): 70, 210, 495, 1820. The components are exact whatever the number.
BLOCKS = ((8, 1 << 24), (10, 1 << 28), (12, 1 << 32), (16, 1 << 62))
SEED = 42
_LOW = 0x5555555555555555


def fingerprint(text: str, width: int = 4, seed: int = SEED) -> int:
    """Of a whole text, unsigned."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    ones, digest, n = np.zeros(64, np.int64), xxhash.xxh64_intdigest, len(words) - width + 1
    for k in range(0, n, 32_768):
        last = min(n, k + 32_768)
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(begins[k:last].tolist(), ends[k + width - 1 : last + width - 1].tolist())], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, width: int = 4) -> DataFrame:
    """rows(__id, __key, __text) -> (__id, __key, fp): the fingerprint of each row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py() or "", width) for t in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found.view(np.int64))], ["__id", "__key", "fp"])

    id_type = rows.schema["__id"].dataType.simpleString()
    return rows.select("__id", "__key", "__text").mapInArrow(run, f"__id {id_type}, __key binary, fp long")


def embedding(fp: Column) -> Column:
    """The bit counts of the 32 segments, two bits each, in one long."""
    high, low = F.shiftrightunsigned(fp, 1), F.lit(_LOW)
    return F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseXOR(high).bitwiseAND(low))


def manhattan(a: Column, b: Column) -> Column:
    """Of two embeddings. Counts are 0, 1 or 2: they differ by 2 where they are 0 and 2, by 1 where their low bits differ."""
    low, other = F.lit(_LOW), a.bitwiseXOR(b)
    return F.bit_count(other.bitwiseAND(low)) + 2 * F.bit_count(F.shiftrightunsigned(other, 1).bitwiseAND(low).bitwiseAND(F.bitwise_not(other)))


def linked(a: str, b: str, most: int) -> Column:
    """The lower bound first, then the differing bits."""
    return (manhattan(embedding(F.col(a)), embedding(F.col(b))) <= most) & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most)


def masks(blocks: int, most: int = MOST) -> list[int]:
    """For each choice of groups the bits of its axes, as signed longs."""
    group = [sum(3 << (2 * axis) for axis in range(32) if axis * blocks // 32 == g) for g in range(blocks)]
    found = [sum(chosen) for chosen in itertools.combinations(group, blocks - most)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links_by_hubs(cells: DataFrame, most: int) -> DataFrame:
    """Verified links (a, b) of each cell row with the cell's hubs and its neighbours in two orders."""
    cell = Window.partitionBy("choice", "cell")
    by_value, turned = cell.orderBy("fp"), cell.orderBy(F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32)))
    near = cells.withColumns({"first": F.min("fp").over(cell), "hub": F.max_by("fp", F.struct("n", "fp")).over(cell), "before": F.lag("fp").over(by_value), "aside": F.lag("fp").over(turned)})
    pairs = near.select(F.col("fp").alias("a"), F.explode(F.array("first", "hub", "before", "aside")).alias("b"))
    return pairs.where((F.col("a") != F.col("b")) & linked("a", "b", most)).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root) for all nodes of edges; root is the least node that node reaches.

    Each round hooks every node to its least neighbour, jumps pointers, and contracts what is joined, so that edges shrink at
    least by half as nodes do; each round is written, so that lineage ends there."""
    live = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = written(nodes.select("node", F.col("node").alias("root")), "roots")
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("parent"))
        for _ in range(2):
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("__top"))
            parents = parents.join(up, "parent", "left").select("node", F.coalesce("__top", "parent").alias("parent"))
        parents = written(parents, "parents")
        roots = written(roots.join(parents.select(F.col("node").alias("root"), "parent"), "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "roots")
        of = lambda c: parents.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_to"))
        moved = live.join(of("a"), "a").join(of("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        live = written(moved.where("a <> b").distinct(), "edges")
    return roots


def fingerprint_components(counted: DataFrame, most: int = MOST, blocks: int | None = None) -> DataFrame:
    """counted(fp, n), fp distinct -> (fp, root) of the fingerprints that link with another. blocks: by their number if not given."""
    blocks = blocks or next(b for n in [counted.count()] for b, up_to in BLOCKS if n <= up_to)
    choice = F.explode(F.array(*(F.struct(F.lit(k).cast("short").alias("choice"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(masks(blocks, most)))))
    placed = counted.withColumn("e", embedding(F.col("fp"))).select("fp", "n", choice.alias("p")).select("p.choice", "p.cell", "fp", "n")
    cell = Window.partitionBy("choice", "cell")
    shared = written(placed.withColumn("__size", F.count(F.lit(1)).over(cell)).where("__size > 1").drop("__size"), "cells")
    first = written(links_by_hubs(shared, most), "links")
    roots = connected_components(first)
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    known = roots.join(sizes, "root").select(F.col("node").alias("fp"), "root", "size")
    within = shared.join(known, "fp", "left").select("choice", "cell", "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))
    main = F.max(F.struct("size", "root")).over(cell)["root"]
    mixed = written(within.withColumns({"main": main, "low": F.min("root").over(cell), "high": F.max("root").over(cell)}).where("low <> high").select("choice", "cell", "fp", "root", (F.col("root") != F.col("main")).alias("minor")), "mixed-cells")
    left = mixed.where("minor").select("choice", "cell", F.col("fp").alias("a"), F.col("root").alias("ra"))
    right = mixed.select("choice", "cell", F.col("fp").alias("b"), F.col("root").alias("rb"))
    meets = (left["choice"] == right["choice"]) & (left["cell"] == right["cell"]) & (F.col("ra") != F.col("rb"))
    rest = left.join(right, meets & linked("a", "b", most)).select("a", "b").distinct()
    return connected_components(first.union(rest)).withColumnRenamed("node", "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, most: int = MOST, blocks: int | None = None) -> DataFrame:
    """One row per row of docs: (id_col, fingerprint, component_id, kept). One row of each component is kept: of those with
    the smallest id, the first."""
    rows = docs.select(F.col(id_col).alias("__id"), F.lit(None).cast("binary").alias("__key"), F.col(text_col).alias("__text"))
    return _groups(rows, width, most, blocks).select(F.col("__id").alias(id_col), "fingerprint", "component_id", "kept")


def keep_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, most: int = MOST, blocks: int | None = None) -> DataFrame:
    """The row of each component that is kept, with all its columns."""
    rows = docs.select(F.col(id_col).alias("__id"), row_key(id_col, text_col).alias("__key"), F.col(text_col).alias("__text"))
    return keep_rows(docs, _groups(rows, width, most, blocks).where("kept"), id_col, text_col)


def _groups(texts: DataFrame, width: int, most: int, blocks: int | None) -> DataFrame:
    """texts(__id, __key, __text) -> (__id, __key, fingerprint, component_id, kept)"""
    found = fingerprints(texts, width).withColumn("__uid", F.monotonically_increasing_id())
    rows = written(found.withColumn("__salt", salt_of(F.col("__uid"))), "fingerprints")
    best = F.struct("__id", "__uid")
    places = written(keyed_summary(rows, ["fp"], "__salt", {"best": F.min(best), "n": F.count(F.lit(1))}, {"best": F.min("best"), "n": F.sum("n")}), "places")
    counted = written(places.groupBy("fp").agg(F.first("best").alias("best"), F.first("n").alias("n")), "distinct-fingerprints")
    roots = fingerprint_components(counted.select("fp", "n"), most, blocks)
    rooted = counted.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "best")
    linked = written(rooted, "rooted")
    parts = linked.withColumn("__part", salt_of(F.col("fp")))
    least = keyed_summary(parts, ["root"], "__part", {"__best": F.min("best")}, {"__best": F.min("__best")})
    whole = parts.select("fp", "root", "__part").join(least, ["root", "__part"]).select("fp", "__best")
    spread = places.select("fp", "__salt").join(whole, "fp")
    return rows.join(spread, ["fp", "__salt"]).select(
        "__id", "__key",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("__best.__id").alias("component_id"),
        (F.col("__uid") == F.col("__best.__uid")).alias("kept"),
    )
