"""Near-duplicate vectors by sorted projection passes.

Vectors that are equal within a label are one candidate with a count. A candidate gets a sketch of 256 random hashes, the signs of
its projections. Each pass concatenates 64 of them, another choice each, and orders the candidates of a label by that. Ordered
rows are cut into windows of WINDOW rows that overlap by half; within one, sketches that differ in so few bits as a link's could are looked
at by their vectors, and pairs with cosine >= `least` link. A window's links join its rows to trees, whose edges are all that
it gives. Trees of all passes give components.

Links are then counted exactly within components, whatever their size: two vectors that link stand in one component if any
chain of links found joins them. A component is cut into blocks; block pairs are compared by matrix products and give a sum a
row, not pairs. In a component of more than one block, vectors within half the angle of a link of the component's mean link with
each other without a comparison, so that only blocks with others are compared. What can be missed is a link between two
components that no window held; the number of passes follows the size of the largest label, so that a pair that only just
links meets in some window with a chance of at least RECALL.

Null labels, and vectors that are null, zero, or hold null or non-finite components link with nothing, as do vectors of
different lengths. Repeated rows are two vectors, linked if they may link at all; a null id is above all others. An empty table
gives an empty result. Extra columns don't matter."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_summary, salt_of, written
from .simhash import connected_components
from .vector_codes import finite

#: Rows of a window, hashes of a sketch and of a pass, and the chance with which a pair at the threshold meets in a window.
WINDOW, HASHES, IN_PASS, RECALL = 512, 256, 64, 0.9999
#: Standard deviations that a link's sketches may differ beyond the mean.
SLACK = 6
#: Rows of a block in which links are counted.
BLOCK = 4096
#: Angles are told from a bound only beyond this much.
ANGLE_SLACK = 1e-6


def passes(largest: int, least: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """How many passes bring two vectors at the threshold into one window, in a label of `largest` different vectors: they do in
    one pass if they agree in the first bits, as many as cut the label into half windows."""
    agree = 1 - math.acos(least) / math.pi
    bits = max(1.0, math.log2(max(1, largest) / (window / 2)))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits)))


def most_different(least: float) -> int:
    """In how many hashes the sketches of a link may differ."""
    p = math.acos(least) / math.pi
    return math.ceil(HASHES * p + SLACK * math.sqrt(HASHES * p * (1 - p)))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def units(column: pa.Array) -> np.ndarray:
    """Rows of length one. Scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = _matrix(column, len(column))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sketched(candidates: DataFrame, n_passes: int, seed: int) -> DataFrame:
    """candidates(id, lab, v) -> (pass, lab, at, id, sketch): `at` orders the pass. lab holds the vectors' length too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        order = [np.random.default_rng((seed, k)).permutation(HASHES)[:IN_PASS] for k in range(n_passes)]
        for b in batches:
            lengths = b.column(2).value_lengths().to_numpy()
            for width in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == width))
                if width not in planes:
                    planes[width] = np.random.default_rng((seed, n_passes, width)).normal(size=(width, HASHES))
                bits = units(part.column(2)) @ planes[width] > 0
                sketches = pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())
                for k, chosen in enumerate(order):
                    at = np.ascontiguousarray(np.packbits(bits[:, chosen], axis=1)).view(">u8")[:, 0] ^ np.uint64(1 << 63)  # signed longs in the order of the bits
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), part.column(1), pa.array(at.astype(np.uint64).view(np.int64)), part.column(0), sketches], ["pass", "lab", "at", "id", "sketch"])

    return candidates.select("id", "lab", "v").mapInArrow(run, "pass int, lab string, at long, id long, sketch binary")


def windows(rows: DataFrame, most: int) -> DataFrame:
    """rows(pass, lab, at, id, sketch), in order within their partitions -> (win, id) of the rows with a sketch like theirs in their
    window. Each window goes half a window on; rows that both were in the one before are not compared again."""
    step = WINDOW // 2

    def close(window: pa.Table, old: int) -> np.ndarray:
        words = np.frombuffer(b"".join(window["sketch"].to_pylist()), np.uint64).reshape(-1, HASHES // 64)
        kind = np.unique([f"{p}/{lab}" for p, lab in zip(window["pass"].to_pylist(), window["lab"].to_pylist())], return_inverse=True)[1]
        apart = sum(np.bitwise_count(words[:, None, k] ^ words[None, old:, k]).astype(np.int16) for k in range(words.shape[1]))
        like = (apart <= most) & (kind[:, None] == kind[None, old:])
        like[np.arange(old, len(words)), np.arange(len(words) - old)] = False
        found = like.any(axis=1)
        found[old:] |= like.any(axis=0)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, old = TaskContext.get().partitionId() << 33, None, 0
        for b in (*batches, None):
            if b is not None:
                fresh = pa.Table.from_batches([b])
                held = fresh if held is None else pa.concat_tables([held, fresh])
            while held is not None and held.num_rows > old and (b is None or held.num_rows >= WINDOW):
                window = held.slice(0, WINDOW)
                ids = window["id"].combine_chunks().filter(pa.array(close(window, old)))
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number)), ids], ["win", "id"])
                number += 1
                held, old = held.slice(step), min(step, max(0, held.num_rows - step))

    return rows.mapInArrow(run, "win long, id long")


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a matrix of links the least row that it reaches."""
    root, before = np.arange(len(linked)), None
    while before is None or (before != root).any():
        before = root
        root = np.where(linked, root[None, :], len(root)).min(axis=1)
        root = root[root]
    return root


def window_edges(members: DataFrame, least: float) -> DataFrame:
    """members(win, id, lab, v) -> (a, b): trees of the links in each window."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        labs, ids, out = t["lab"].to_pylist(), t["id"].to_numpy(), []
        kind = np.unique(labs, return_inverse=True)[1]
        for k in range(kind.max() + 1):
            at = np.flatnonzero(kind == k)
            u = units(t["v"].combine_chunks().take(pa.array(at)))
            found = forest((u @ u.T >= least) | np.eye(len(u), dtype=bool))
            own = ids[at]
            out.append((own[found][found != np.arange(len(u))], own[found != np.arange(len(u))]))
        return pa.table({"a": np.concatenate([a for a, _ in out]), "b": np.concatenate([b for _, b in out])})

    return members.groupBy("win").applyInArrow(run, "a long, b long")


def centred(members: DataFrame) -> DataFrame:
    """members(root, v) of large components -> (root, centre): the sum of their unit vectors. Each batch gives one row a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots, at = np.unique(b.column(0).to_numpy(), return_inverse=True)
            for k, r in enumerate(roots.tolist()):
                total = units(b.column(1).filter(pa.array(at == k))).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), r)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["root", "place", "value"])

    sums = members.select("root", "v").mapInArrow(run, "root long, place int, value double").groupBy("root", "place").agg(F.sum("value").alias("value"))
    return sums.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("centre"))


def cores(members: DataFrame, least: float) -> DataFrame:
    """members(..., v, centre) with `core`: whether the angle to the centre is surely at most half of a link's."""
    half = math.acos(least) / 2 - ANGLE_SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, c = b.column(b.schema.get_field_index("v")), _matrix(b.column(b.schema.get_field_index("centre")), b.num_rows)
                norm = np.sqrt((c * c).sum(axis=1))
                cosine = np.where(norm > 0, (units(v) * c).sum(axis=1) / np.maximum(norm, 1e-300), -1)
                keep = [k for k, name in enumerate(b.schema.names) if name != "centre"]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(cosine >= math.cos(half))], [*(b.schema.names[k] for k in keep), "core"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema if f.name != "centre")
    return members.mapInArrow(run, f"{names}, core boolean")


def counted_links(placed: DataFrame, least: float) -> DataFrame:
    """placed(unit, root, side, id, n, v) -> (id, links): for each row the counts of the rows that link with it. A unit whose rows have
    side 2 compares them with each other, itself left out; in others, rows of side 0 are compared with those of side 1."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side, ids, n = t["side"].to_numpy(), t["id"].to_numpy(), t["n"].to_numpy().astype(float)
        root, links = np.unique(t["root"].to_numpy(), return_inverse=True)[1], np.zeros(t.num_rows, np.int64)
        widths = t["v"].combine_chunks().value_lengths().to_numpy()
        for width in np.unique(widths).tolist():  # a component has one length, a unit of small ones may have several
            of = np.flatnonzero(widths == width)
            u = units(t["v"].combine_chunks().take(pa.array(of)))
            two = side[of[0]] != 2
            rows, columns = (np.flatnonzero(side[of] == 0), np.flatnonzero(side[of] == 1)) if two else (np.arange(len(of)),) * 2
            for at in np.array_split(rows, len(rows) * len(columns) // (1 << 21) + 1):
                linked = (u[at] @ u[columns].T >= least) & (root[of[at], None] == root[None, of[columns]])
                if not two:
                    linked &= at[:, None] != columns[None, :]
                seen = linked.astype(float)
                links[of[at]] += (seen @ n[of[columns]]).astype(np.int64)
                if two:
                    links[of[columns]] += (n[of[at]] @ seen).astype(np.int64)
        return pa.table({"id": ids, "links": links})

    return placed.groupBy("unit").applyInArrow(run, "id long, links long")


def links_within(members: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """members(id, root, n, v) -> (id, links): how many vectors outside the own copies each links with in its component."""
    sized = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    small_rows = sized.where(F.col("size") <= block).agg(F.sum("size")).first()[0] or 0
    known = written(members.join(sized, "root"), "members")
    small = known.where(F.col("size") <= block).select(F.pmod(F.xxhash64("root"), F.lit(small_rows // 1024 + 1)).cast("string").alias("unit"), "root", F.lit(2).alias("side"), "id", "n", "v")
    large = known.where(F.col("size") > block)
    if large.isEmpty():
        return counted_links(small, least)
    core = written(cores(large.join(centred(large), "root"), least), "cores")
    count_of = F.count(F.lit(1))
    totals = core.groupBy("root").agg(F.count_if("core").alias("in_core"), count_of.alias("all"), F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("weight"))
    pieces = lambda c: F.ceil(c / F.lit(block)).cast("int")
    inner, outer = pieces(F.col("in_core")), pieces(F.col("all") - F.col("in_core"))
    place = F.xxhash64("id", F.lit(7))
    own = F.when(F.col("core"), F.pmod(place, F.greatest(inner, F.lit(1)))).otherwise(inner + F.pmod(place, F.greatest(outer, F.lit(1)))).cast("int")
    dealt = core.join(totals, "root").withColumns({"own": own, "inner": inner, "outer": outer})
    # a block of the core meets the blocks outside it, one outside meets all
    others = F.when(F.col("core"), F.when(F.col("outer") > 0, F.sequence(F.col("inner"), F.col("inner") + F.col("outer") - 1))).otherwise(F.sequence(F.lit(0), F.col("inner") + F.col("outer") - 1))
    met = dealt.where(~F.col("core") | (F.col("outer") > 0)).withColumn("other", F.explode(others))
    unit = F.concat_ws("/", "root", F.least("own", "other"), F.greatest("own", "other"))
    pairs = met.select(unit.alias("unit"), "root", F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"), "id", "n", "v")
    certain = dealt.where("core").select("id", (F.col("weight") - F.col("n")).alias("links"))
    return counted_links(small.unionByName(pairs), least).union(certain).groupBy("id").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: (id_col, n_links, component_id, kept)."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("lab"), F.col(vector_col).alias("v"))
    may = finite(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("lab").isNotNull()
    lab = F.concat_ws("/", F.size("v"), "lab")
    salted = written(rows.select("vec_id", F.when(may, lab).alias("lab"), F.when(may, F.transform("v", lambda x: x + F.lit(0.0).cast(rows.schema["v"].dataType.elementType))).alias("v"), salt_of(F.col("vec_id")).alias("salt")), "vectors")
    places = written(keyed_summary(salted.where("lab IS NOT NULL"), ["lab", "v"], "salt", {"least": F.min("vec_id"), "n": F.count(F.lit(1))}, {"least": F.min("least"), "n": F.sum("n")}), "copies")
    candidates = written(places.groupBy("lab", "v").agg(F.min("least").alias("least"), F.min("n").alias("n")).withColumn("id", F.monotonically_increasing_id()), "candidates")
    largest = candidates.groupBy("lab").count().agg(F.max("count")).first()[0] or 0
    n_passes = passes(largest, least)
    # partitions of many windows: what stands on both sides of a partition's end meets in other passes only
    parts = n_passes * candidates.count() // (64 * WINDOW) + 1
    ordered = sketched(candidates, n_passes, seed).repartitionByRange(parts, "pass", "lab", "at", "id").sortWithinPartitions("pass", "lab", "at", "id")
    like = written(windows(ordered, most_different(least)), "windows")
    members = like.join(candidates.select("id", "lab", "v"), "id").select("win", "id", "lab", "v")
    roots = connected_components(written(window_edges(members, least), "window-edges")).select(F.col("node").alias("id"), "root")
    inside = written(roots.join(candidates, "id").select("id", "root", "n", "v", "least"), "inside")
    links = links_within(inside.select("id", "root", "n", "v"), least, block)
    joined = inside.withColumn("salt", salt_of(F.col("id")))
    smallest = keyed_summary(joined, ["root"], "salt", {"component": F.min("least")}, {"component": F.min("component")})
    rooted = joined.select("id", "root", "salt").join(smallest, ["root", "salt"]).select("id", "component")
    found = candidates.join(links, "id", "left").join(rooted, "id", "left").select("lab", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    spread = places.select("lab", "v", "salt").join(written(found, "found"), ["lab", "v"])
    out = salted.join(spread, ["lab", "v", "salt"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
