"""Choices that cover the values of several axes: samples of a table, and plans of requests for each passage."""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: What rare values of the pooled axis count as.
POOLED = "__small__"
#: Parts into which the rows of one combination are dealt when its first ones are sought.
SALTS = 64


def _first_of_cells(rows: DataFrame, n: int) -> DataFrame:
    """rows(cell, key...) -> the n first of each cell by key: within salted parts first, so that no cell is sorted in one task."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    few = salted.withColumn("__i", F.row_number().over(Window.partitionBy("cell", "__salt").orderBy("key"))).where(F.col("__i") <= n)
    return few.withColumn("__i", F.row_number().over(Window.partitionBy("cell").orderBy("key"))).where(F.col("__i") <= n).drop("__i", "__salt")


def covered_sample(rows: DataFrame, id_col: str, axes: Sequence[str], size: int, seed: int, order: Column | None = None, pool: str | None = None, least: int = 1) -> DataFrame:
    """The `size` rows, with `position`, that a greedy choice takes: each time a row with the greatest sum over axes of 1 / (1 + how many
    chosen rows have its value), ties by a digest of seed and `order` (the id if not given), then by id. Values of the axis `pool` that
    fewer than `least` rows have count as one. Null is a value. More rows than there are is an error.

    A row's gain depends on its combination of values alone, and gains only fall. So the driver keeps the combinations in a heap by
    the last known gain, looks at the first one again, and takes it if that is still the first; of rows it sees the first few of a
    combination in the order of digests, and asks for more of those that run out."""
    value = {a: F.coalesce(F.concat(F.lit("="), F.col(a).cast("string")), F.lit("")) for a in axes}
    base = rows
    if pool:
        common = rows.groupBy(value[pool].alias("__value")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
        base = base.withColumn("__value", value[pool]).join(common, "__value", "left")
        value[pool] = F.when(F.col("__n").isNotNull(), F.col("__value")).otherwise(POOLED)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), (order if order is not None else F.col(id_col)).cast("string")), 256)
    keyed = written(base.select(F.array(*value.values()).alias("cell"), F.struct(digest.alias("h"), F.col(id_col).cast("string").alias("i"), F.col(id_col).alias("id")).alias("key")), "cells")
    found = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a combination
    left = {tuple(r["cell"]): r["n"] for r in found}
    if size > sum(left.values()):
        raise ValueError(f"{size} rows are asked for, there are {sum(left.values())}")
    ahead = 1 + 2 * size // max(1, len(left))
    queue: dict[tuple, list] = defaultdict(list)
    for r in _first_of_cells(keyed, ahead).collect():
        queue[tuple(r["cell"])].append((r["key"]["h"], r["key"]["i"], r["key"]["id"]))
    for cell in queue:
        queue[cell].sort(key=lambda k: k[:2], reverse=True)
    counts, taken = Counter(), []
    gain = lambda cell: sum(1.0 / (1 + counts[k, v]) for k, v in enumerate(cell))
    heap = [(-gain(cell), *keys[-1][:2], cell) for cell, keys in queue.items()]
    heapq.heapify(heap)
    while len(taken) < size:
        known, h, i, cell = heapq.heappop(heap)
        now = -gain(cell)
        if now != known:
            heapq.heappush(heap, (now, h, i, cell))
            continue
        taken.append(queue[cell].pop()[2])
        left[cell] -= 1
        for k, v in enumerate(cell):
            counts[k, v] += 1
        if not left[cell]:
            continue
        if not queue[cell]:
            _refill(keyed, queue, left, cell, (h, i), 2 * ahead)
        heapq.heappush(heap, (-gain(cell), *queue[cell][-1][:2], cell))
    chosen = rows.sparkSession.createDataFrame([(i, k + 1) for k, i in enumerate(taken)], f"__id {rows.schema[id_col].dataType.simpleString()}, position long")
    return rows.join(F.broadcast(chosen), F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id")  # `size` rows


def _refill(keyed: DataFrame, queue: dict, left: dict, cell: tuple, after: tuple[str, str], n: int) -> None:
    later = keyed.where((F.col("cell") == F.array(*map(F.lit, cell))) & (F.struct("key.h", "key.i") > F.struct(F.lit(after[0]).alias("h"), F.lit(after[1]).alias("i"))))
    queue[cell] = sorted(((r["key"]["h"], r["key"]["i"], r["key"]["id"]) for r in _first_of_cells(later, n).collect()), key=lambda k: k[:2], reverse=True)


#: The places that a focus can be asked for.
FOCUS_BUCKETS = ("beginning", "middle", "end")


def focus_controls(mode: str, sentences: int) -> list[str]:
    """The focus values of a mode for a passage of so many sentences: `mode:place`."""
    if mode == "none":
        return ["none:None"]
    if mode == "bucket":
        return [f"bucket:{b}" for b in FOCUS_BUCKETS]
    return [f"{mode}:{i}" for i in sorted({0, sentences // 2, sentences - 1})] if sentences else []


def choice_tie(axes: Sequence[str], passage: str, seed: int) -> str:
    return hashlib.sha256(json.dumps({"axes": list(axes), "passage_id": passage, "plan_seed": seed}, sort_keys=True).encode()).hexdigest()


def choice_ties(values: Sequence[Sequence[str]], passage: str, seed: int) -> list[bytes]:
    """choice_tie's digests, as bytes, of all combinations of the axes' values, the last axis fastest."""
    end = f'], "passage_id": {json.dumps(passage)}, "plan_seed": {json.dumps(seed)}}}'
    return [hashlib.sha256(f'{{"axes": [{", ".join(c)}{end}'.encode()).digest() for c in itertools.product(*([json.dumps(x) for x in v] for v in values))]


@functools.lru_cache(1024)
def _bits(sizes: tuple[int, ...]) -> np.ndarray:
    """A row an axis: of each combination, the bit of its value."""
    return np.int64(1) << np.stack([x.ravel() for x in np.meshgrid(*(np.arange(k) for k in sizes), indexing="ij")])


def cover_choices(values: Sequence[Sequence[str]], n: int, ties: Sequence[bytes]) -> list[tuple[str, ...]]:
    """n of all combinations of the axes' values (a list an axis), one after another: each time one with the most values that no chosen
    one has, ties by `ties`, one a combination, the last axis fastest. Seen values are bits; in the order of ties the first best is taken."""
    sizes = tuple(map(len, values))
    order = np.array(sorted(range(len(ties)), key=ties.__getitem__))
    bits = _bits(sizes)[:, order]
    seen, taken = np.zeros((len(sizes), 1), np.int64), []
    for _ in range(n):
        new = ((bits & seen) == 0).sum(axis=0)
        new[taken] = -1
        i = int(new.argmax())
        taken.append(i)
        seen |= bits[:, i : i + 1]
    codes = np.stack(np.unravel_index(order[taken], sizes), axis=1).tolist() if n else []
    return [tuple(v[c] for v, c in zip(values, row)) for row in codes]


def request_choices(passages: DataFrame, id_col: str, intents: str, sentences: str, forms: Sequence[str], modes: Sequence[str], temperatures: Sequence[float], seeds: Sequence[int], n: int, plan_seed: int) -> DataFrame:
    """passages(id_col, intents: those that may apply, in order, sentences: how many) -> (id_col, position, form, intent, focus,
    temperature, seed): n requests a passage, chosen to cover the values of the five axes first. Passages don't need one another, so
    that nothing is shuffled. Fewer combinations than n are an error; at most 63 values an axis."""
    fixed = [tuple(format(t, ".12g") for t in temperatures), tuple(str(s) for s in seeds)]
    names = ["form", "intent", "focus", "temperature", "seed"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, may, count in zip(pdf["__i"], pdf["__may"], pdf["__n"]):
                focus = [c for mode in modes for c in focus_controls(mode, int(count or 0))]
                values = [tuple(forms), tuple(may if may is not None else ()), tuple(dict.fromkeys(focus)), *fixed]
                if np.prod([len(v) for v in values]) < n:
                    raise ValueError(f"passage {i} has fewer than {n} eligible choices")
                chosen = cover_choices(values, n, choice_ties(values, str(i), plan_seed))
                out += [(i, k + 1, *c) for k, c in enumerate(chosen)]
            yield pd.DataFrame(out, columns=[id_col, "position", *names])

    kind = passages.schema[id_col].dataType.simpleString()
    return passages.select(F.col(id_col).alias("__i"), F.col(intents).alias("__may"), F.col(sentences).alias("__n")).mapInPandas(run, f"{id_col} {kind}, position long, {', '.join(f'{c} string' for c in names)}")
