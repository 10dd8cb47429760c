"""Packing of documents into training sequences by best-fit decreasing.

A document's tokens end with the end token. A document longer than a window is first cut into full windows and a rest. Pieces
are dealt at random into shards of a bounded number of pieces; in each shard they are placed in falling order of length,
each into the open window with the least remaining capacity that still holds it, found by a segment tree over capacities. A
window that no further piece fits stays open to the end and is padded (or, if it holds a power of two, stands as it is).

Tokens are made once, where the text is read; only pieces (ids and lengths) move. Nulls: a null text is an empty document and
has only the end token, null ids are kept. Repeated rows are packed each. Extra columns don't matter."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .common import written

#: Pieces of a shard, on average; sequence ids of a shard begin at its number times 2**24.
SHARD = 50_000


class Capacities:
    """A segment tree over remaining capacities 0 to n - 1: how many open windows have each."""

    def __init__(self, n: int) -> None:
        self.n = 1 << (n - 1).bit_length()
        self.count = [0] * (2 * self.n)

    def add(self, capacity: int, by: int) -> None:
        at, count = self.n + capacity, self.count
        while at:
            count[at] += by
            at >>= 1

    def tightest(self, size: int) -> int:
        """The least capacity of an open window that is at least size, or -1."""
        at, count = self.n + size, self.count
        if count[at]:
            return size
        while at > 1:
            if not at & 1 and count[at + 1]:  # the right neighbour holds the next greater capacities
                at += 1
                while at < self.n:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.n
            at >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """For lengths in falling order: the number of each one's window, and its offset there."""
    tree, open_ = Capacities(window + 1), [[] for _ in range(window + 1)]
    place, offset, n = [], [], 0
    for size in lengths:
        capacity = tree.tightest(size)
        if capacity < 0:
            number, capacity, n = n, window, n + 1
        else:
            number = open_[capacity].pop()
            tree.add(capacity, -1)
        place.append(number)
        offset.append(window - capacity)
        if left := capacity - size:
            open_[left].append(number)
            tree.add(left, 1)
    return place, offset


def pieces(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens): each document's full windows and rest, in one pass over the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, end = codec(path, library=True), end_id.to_bytes(4, "little")
        for b in batches:
            whose, starts, lengths, crcs, totals = [], [], [], [], []
            for k, t in enumerate(b.column(1)):
                ids = c.encode_bytes(t.as_py() or "") + end
                n = len(ids) // 4
                for s in range(0, n, window):
                    whose.append(k)
                    starts.append(s)
                    lengths.append(min(window, n - s))
                    crcs.append(zlib.crc32(memoryview(ids)[4 * s : 4 * (s + window)]))
                    totals.append(n)
            columns = [b.column(0).take(pa.array(whose, pa.int64()))] + [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids_crc32", "doc_tokens"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long").withColumnRenamed("id", id_col)


def packed(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """The pieces of docs with (sequence_id, offset)."""
    cut = pieces(docs, path, window, end_id, id_col, text_col).withColumn("__uid", F.monotonically_increasing_id())
    cut = written(cut, "pieces")
    shards = max(1, -(-cut.count() // shard))
    dealt = cut.withColumn("__shard", F.pmod(F.xxhash64("__uid"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "__uid"], ascending=[False, True])
        place, offset = best_fit_decreasing(pdf["length"].tolist(), window)
        return pdf.assign(sequence_id=pd.array(place, "int64") + (int(pdf["__shard"].iloc[0]) << 24), offset=pd.array(offset, "int64")).drop(columns=["__shard", "__uid"])

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("__shard").applyInPandas(run, schema)
