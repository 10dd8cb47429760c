"""Vector codes by Lloyd's algorithm on integers, with Hamerly's bounds.

Components become integers floor(scale * x), vectors are cut into equal parts, and every part position has a codebook of a few
entries. Each round assigns every part to the nearest entry of its codebook and moves the entries to the floored means. A
part's state is its entry, an upper bound on the distance to it, and a lower bound on the distance to the second nearest. Both
are integers, rounded away from each other, and move by as much as the entries did. A part keeps its entry without a scan only
where the upper bound is strictly below the lower one, or twice it strictly below the distance from its entry to the nearest
other one: nothing else can then be as near, so that ties still go to the lower index. Else the upper bound is tightened, and
where that doesn't help, all entries are scanned.

A round is one pass over the state's table: tasks write the new state and, in a last row each, by how much the sums of the
entries change; the sums are added up by Spark and the codebooks (parts x entries x components numbers) are all that the
driver holds. A lost task is run again without being counted twice, as only what a committed task wrote is read.

Rows whose vector is null or holds null or non-finite components are dropped, as are vectors of another length than the first
kept one or of a length that isn't a multiple of the parts. Integers saturate at +-2^27, so that no sum of a row's squares
overflows; a sum over a label beyond 64 bits is null. First entries are the parts of the vectors with the smallest ids (null
ids last, ties by the vector); with fewer vectors there are fewer entries. Repeated rows each count. An empty table gives an
empty result. Extra columns don't matter."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, keyed_summary, removed, salt_of

#: Where integers saturate, and a distance beyond all others.
EDGE, FAR = 1 << 27, 1 << 31


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(EDGE - 1)), F.lit(-EDGE)).cast("int"))


def root(squares: np.ndarray) -> np.ndarray:
    """The floored square roots, exact."""
    r = np.sqrt(squares.astype(float)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def root_up(squares: np.ndarray) -> np.ndarray:
    r = root(squares)
    return r + (r * r < squares)


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    return ((x - entry) ** 2).sum(axis=-1)


class Books:
    """The codebooks (parts, entries, width), how far each entry moved at most, and how far its nearest other one is at least."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries, k = entries, entries.shape[1]
        apart = squared(entries[:, :, None], entries[:, None])
        apart[:, range(k), range(k)] = FAR * FAR
        self.gap = root(apart.min(axis=2))
        self.moved = np.zeros(entries.shape[:2], np.int64) if before is None else root_up(squared(entries, before))
        others = np.repeat(self.moved[:, None], k, axis=1)
        others[:, range(k), range(k)] = 0
        self.others_moved = others.max(axis=2)

    def assign(self, x: np.ndarray, p: int, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Moves bounds, entries and all of part p of the vectors x in place; returns how many parts were scanned in full."""
        book, gap = self.entries[p], self.gap[p]
        upper += self.moved[p][code]
        lower -= self.others_moved[p][code]
        open_ = lambda at: at[(upper[at] >= lower[at]) & (2 * upper[at] >= gap[code[at]])]
        at = open_(np.arange(len(x)))
        upper[at] = root_up(squared(x[at], book[code[at]]))
        at = open_(at)
        for part in np.array_split(at, len(at) // 4096 + 1):
            d = squared(x[part, None], book[None])
            best, i = d.argmin(axis=1), np.arange(len(part))
            code[part], upper[part] = best, root_up(d[i, best])
            d[i, best] = FAR * FAR
            lower[part] = root(d.min(axis=1))
        return len(at)


STATE = "vec_id {id}, label {label}, q array<int>, code binary, upper array<long>, lower array<long>, sums array<long>, scanned long"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel(), kind))


def _start(q: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nothing is known: bounds that no test passes."""
    return np.zeros((len(q), parts), np.int64), np.full((len(q), parts), FAR), np.full((len(q), parts), -FAR)


def _read(b: pa.RecordBatch, books: Books) -> tuple[np.ndarray, ...]:
    """(q, code, upper, lower) of a batch whose columns are those of the state, or only the first three of them."""
    parts, _, width = books.entries.shape
    q = _matrix(b.column(2), parts * width)
    if b.num_columns == 3:
        return q, *_start(q, parts)
    code = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
    return q, code, _matrix(b.column(4), parts), _matrix(b.column(5), parts)


def advanced(rows: DataFrame, books: Books) -> DataFrame:
    """The next state of rows: kept vectors (vec_id, label, q) at first, then the state before. Each task's last row has no
    vector but the change of the entries' sums and counts, (parts, entries, width + 1) in one list."""
    parts, k, width = books.entries.shape
    schema = STATE.format(id=rows.schema["vec_id"].dataType.simpleString(), label=rows.schema["label"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change, scanned, like = np.zeros((parts, k, width + 1), np.int64), 0, None
        for b in batches:
            q, code, upper, lower = _read(b, books)
            like, first, before = b, b.num_columns == 3, code.copy()
            for p in range(parts):
                x = q[:, p * width : (p + 1) * width]
                scanned += books.assign(x, p, code[:, p], upper[:, p], lower[:, p])
                at = np.arange(len(x)) if first else np.flatnonzero(code[:, p] != before[:, p])
                with_one = np.concatenate([x[at], np.ones((len(at), 1), np.int64)], axis=1)
                np.add.at(change[p], code[at, p], with_one)
                if not first:
                    np.subtract.at(change[p], before[at, p], with_one)
            n = len(q)
            codes = pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), codes, _lists(upper, pa.int64()), _lists(lower, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], names)
        if like is not None:
            empty = [pa.nulls(1, like.column(i).type) for i in range(3)]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*empty, pa.nulls(1, pa.binary()), pa.nulls(1, longs), pa.nulls(1, longs), pa.array([change.ravel().tolist()], longs), pa.array([scanned], pa.int64())], names)

    names = ["vec_id", "label", "q", "code", "upper", "lower", "sums", "scanned"]
    return rows.mapInArrow(run, schema)


def finished(rows: DataFrame, books: Books) -> DataFrame:
    """(vec_id, label, code, error) of the state's rows under the final codebooks."""
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, code, upper, lower = _read(b, books)
            error = np.zeros(len(q), np.int64)
            for p in range(parts):
                x = q[:, p * width : (p + 1) * width]
                books.assign(x, p, code[:, p], upper[:, p], lower[:, p])
                error += squared(x, books.entries[p][code[:, p]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in code.astype(np.uint8)], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("vec_id", "label")}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def train(rows: DataFrame, parts: int, entries: int, rounds: int) -> tuple[str, Books, list[int]] | None:
    """rows(vec_id, label, q) -> (the path of the last state, the final codebooks, parts scanned in each round); None without rows."""
    spark = rows.sparkSession
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).collect()
    if not first:
        return None
    start = np.array([r["q"] for r in first], np.int64)
    books = Books(start.reshape(len(first), parts, -1).transpose(1, 0, 2).copy())
    totals, path, scanned = np.zeros((*books.entries.shape[:2], books.entries.shape[2] + 1), np.int64), None, []
    for _ in range(rounds):
        state = rows if path is None else _state(rows, path)
        fresh = fresh_path(spark, "vector-state")
        advanced(state, books).write.parquet(fresh)
        notes = spark.read.schema(_schema(rows)).parquet(fresh).where("sums IS NOT NULL")
        change = notes.select(F.posexplode("sums").alias("at", "value"), "scanned").groupBy("at").agg(F.sum("value").alias("value"), F.sum("scanned").alias("scanned")).collect()
        flat = totals.reshape(-1)
        for r in change:
            flat[r["at"]] += r["value"]
        scanned.append(change[0]["scanned"] if change else 0)
        if path:
            removed(spark, path)
        path, counts = fresh, totals[:, :, -1:]
        moved = np.where(counts > 0, totals[:, :, :-1] // np.maximum(counts, 1), books.entries)
        books = Books(moved, books.entries)
    return path, books, scanned


def _schema(rows: DataFrame) -> str:
    return STATE.format(id=rows.schema["vec_id"].dataType.simpleString(), label=rows.schema["label"].dataType.simpleString())


def _state(rows: DataFrame, path: str) -> DataFrame:
    return rows.sparkSession.read.schema(_schema(rows)).parquet(path).where("code IS NOT NULL").drop("sums", "scanned")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """One row per kept vector: (vec_id, code, error, label_error, codebooks_sha256)."""
    if not 1 <= entries <= 256 or rounds < 1:
        raise ValueError("entries must be 1 to 256 and rounds at least 1")
    spark = vectors.sparkSession
    found = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(finite(F.col("v")))
    whole = found.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v").alias("n")).limit(1).collect()
    rows = whole.where(F.size("v") == (first[0]["n"] if first else 0)).select("vec_id", "label", integers(F.col("v"), scale).alias("q"))
    trained = train(rows, parts, entries, rounds) if first else None
    kinds = {n: found.schema[n].dataType.simpleString() for n in ("vec_id", "label")}
    if trained is None:
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string").withColumnRenamed("vec_id", id_col)
    path, books, _ = trained
    done = fresh_path(spark, "vector-codes")
    finished(_state(rows, path), books).write.parquet(done)
    removed(spark, path)
    out = spark.read.schema(f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long").parquet(done)
    keyed = out.select("vec_id", "code", "error", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("__label"), salt_of(F.col("vec_id"), F.col("code")).alias("__salt"))
    sums = keyed_summary(keyed, ["__label"], "__salt", {"label_error": F.try_sum("error")}, {"label_error": F.try_sum("label_error")})
    return keyed.join(sums, ["__label", "__salt"]).select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(digest(books.entries)).alias("codebooks_sha256"))
