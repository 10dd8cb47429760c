"""WARC archives of pages, with a two-level capture index.

Writing. Pages with equal payloads of at least LEAST bytes get one response, the page with the largest id; the others become
revisits of it. Each task writes gzip files, a member for each record, and reports each record's place (the capture). A file's
name is unique to the attempt that wrote it, and only captures that a successful task reported count, so that a lost executor
leaves at worst a file that nothing points to. A record's id is unique; that of a large payload's response is its page and digest,
so that revisits can name it.

Index. Captures are sorted by the reversed-host key of their URL into compressed blocks of BLOCK lines; a directory holds each
block's first and last key. A look-up finds the blocks of its keys by binary search in the directory, the lines by binary search
in the block, and then reads the records' byte ranges, in tasks of about TASK_BYTES, by file and place, neighbours in one read.

Files are written and read through pyarrow's file systems, so that the folder may be in any store that it knows; the folder
must be shared by all executors.

Nulls: a null payload is empty, a null URL is written as about:blank, null ids order below any other. Repeated rows are records
of their own; of ties for the largest id one row is the response. URLs may hold any character; those that only differ in how white
space or a control character is written have one key. Extra columns don't matter."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, keyed_summary, salt_of, written

#: Least bytes of a payload that others may revisit; lines of an index block; bytes after which a new file begins.
LEAST, BLOCK, FILE_BYTES = 1000, 2000, 64 << 20
#: Compressed bytes of records that a task reads; a gap and a length up to which neighbouring ranges are read together.
TASK_BYTES, GAP, READ = 32 << 20, 64 << 10, 8 << 20
#: Entries of the directory that a look-up broadcasts.
COARSE = 100_000
DATE = "1970-01-01T00:00:00Z"
CAPTURES = "key string, url string, date string, kind string, file string, offset long, length long"


def _header_value(text: str) -> str:
    return "".join(c if " " < c and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def reversed_host_key(url: str | None) -> str:
    """com,example,www)/path?query of a URL: host labels reversed, without scheme, default port and fragment. White space and control
    characters are percent-encoded first, as in the record's header, so that a key has none; it is stored, sorted and searched so."""
    if not url:
        return ""
    url = _header_value(url)
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    host = ",".join(reversed(host.split(".")))
    port = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    return f"{host}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record(page_id, url: str | None, payload: bytes, refers_to, date: str = DATE, revisit: bool = False, named: bool = False) -> bytes:
    """One WARC record, not compressed. named: its id is that by which revisits refer to it."""
    sha1 = hashlib.sha1(payload).hexdigest()
    urn = lambda page, unique: f"<urn:{'no-page' if page is None else f'page:{page}'}:{unique}>"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id, sha1 if named else uuid.uuid4().hex)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header_value(url) if url else 'about:blank'}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to, sha1)}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """One record's headers, HTTP headers and payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    n = int(headers["Content-Length"])
    if not version.startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    sent = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    return {"headers": headers, "http": sent, "payload": None if headers["WARC-Type"] == "revisit" else payload}


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Writes WARC files into folder; returns the captures, a written table with CAPTURES' columns."""
    rows = pages.select(
        F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("order"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")
    ).withColumns({"content": F.unhex(F.sha2("payload", 256)), "large": F.octet_length("payload") >= least, "salt": salt_of(F.col("order"))})
    best = F.struct("order", "id")
    largest = rows.where("large").groupBy("content", "order").agg(F.first("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("salt").alias("salt"))
    groups = written(keyed_summary(largest, ["content"], "salt", {"best": F.max(best), "n": F.max_by("n", best)}, {"best": F.max("best"), "n": F.max_by("n", "best")}), "payloads")
    dealt = rows.join(groups, ["content", "salt"], "left").withColumn("first", F.col("order").eqNullSafe(F.col("best.order")))
    if not groups.where("n > 1").isEmpty():  # rows that repeat the largest id: one is the response, numbered within parts and then across them
        tied = F.coalesce(F.col("large") & F.col("first") & (F.col("n") > 1), F.lit(False))
        parts = dealt.where(tied).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(256)))
        numbered = parts.withColumn("nth", F.row_number().over(Window.partitionBy("content", "part").orderBy("url")))
        across = numbered.withColumn("place", F.row_number().over(Window.partitionBy("content", "nth").orderBy("url", "part")))
        dealt = dealt.where(~tied).unionByName(across.withColumn("first", (F.col("nth") == 1) & (F.col("place") == 1)).drop("part", "nth", "place"))
    dealt = dealt.select("id", "url", "payload", (F.col("large") & ~F.col("first")).alias("revisit"), F.col("best.id").alias("refers_to"), "large")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for b in batches:
            found = []
            for page, url, payload, revisit, refers, large in zip(*(b.column(k) for k in range(6))):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                url, revisit = url.as_py(), bool(revisit.as_py())
                raw = gzip.compress(record(page.as_py(), url, payload.as_py().encode(), refers.as_py(), revisit=revisit, named=bool(large.as_py()) and not revisit), 6, mtime=0)
                out.write(raw)
                found.append((reversed_host_key(url), url, DATE, "revisit" if revisit else "response", name, at, len(raw)))
                at += len(raw)
            columns = list(zip(*found)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 5 else pa.int64()) for k, c in enumerate(columns)], ["key", "url", "date", "kind", "file", "offset", "length"])
        if out is not None:
            out.close()

    return written(dealt.mapInArrow(run, CAPTURES), "captures")


def build_index(captures: DataFrame, block: int = BLOCK) -> DataFrame:
    """The index blocks, a written table (block, first_key, last_key, lines, bytes, data): sorted within and between blocks.
    bytes: of the records that the block's lines point to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            keys, entries = [r[0] for r in rows], ["\t".join(map(str, r[1:])) for r in rows]
            data = zlib.compress("\n".join(keys).encode() + b"\0" + "\n".join(entries).encode(), 6)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([keys[0]]), pa.array([keys[-1]]), pa.array([len(rows)], pa.int64()), pa.array([sum(r[5] for r in rows)], pa.int64()), pa.array([data], pa.binary())], ["block", "first_key", "last_key", "lines", "bytes", "data"])

        held: list[tuple] = []
        for b in batches:
            held += zip(*(b.column(k).to_pylist() for k in range(6)))
            while len(held) >= block:
                yield pack(held[:block])
                held = held[block:]
        if held:
            yield pack(held)

    ordered = captures.select("key", "date", "kind", "file", "offset", "length")
    n, shuffles = captures.count(), int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(-(-n // (4 * block)), max(shuffles, n // 1_000_000)))
    return written(ordered.repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset").mapInArrow(run, "block string, first_key string, last_key string, lines long, bytes long, data binary"), "index")


def block_lines(data: bytes) -> tuple[list[str], list[list[str]]]:
    """A block's keys in order, and (date, kind, file, offset, length) of each."""
    keys, _, entries = zlib.decompress(data).decode().partition("\0")
    return keys.split("\n"), [x.split("\t") for x in entries.split("\n")]


ENTRIES = "url string, file string, offset long, length long"


def read_ranges(folder: str, places: list[tuple[str, int, int]]) -> Iterator[dict]:
    """The records at (file, offset, length), which are in order; ranges close to each other are read together."""
    store, path = fs.FileSystem.from_uri(folder)
    k = 0
    while k < len(places):
        name, first, last = places[k][0], places[k][1], k + 1
        while last < len(places) and places[last][0] == name and places[last][1] - (places[last - 1][1] + places[last - 1][2]) <= GAP and places[last][1] + places[last][2] - first <= READ:
            last += 1
        with store.open_input_file(f"{path}/{name}") as f:
            raw = memoryview(f.read_at(places[last - 1][1] + places[last - 1][2] - first, first))
        for _, offset, length in places[k:last]:
            yield parse(gzip.decompress(raw[offset - first : offset - first + length]))
        k = last


def described(found: dict) -> tuple:
    """(page id, payload bytes, hexadecimal SHA-1, type, page referred to) of a parsed record; checks the payload."""
    headers = found["headers"]
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if found["payload"] is not None and hashlib.sha1(found["payload"]).hexdigest() != digest:
        raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't match its digest")
    bare = lambda x: x[len("<urn:page:") :].rsplit(":", 1)[0] if x and x.startswith("<urn:page:") else None
    return bare(headers["WARC-Record-ID"]), int(found["http"]["Content-Length"]), digest, headers["WARC-Type"], bare(headers.get("WARC-Refers-To"))


def find(index: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(url, key) -> the captures of each key (ENTRIES), a written table: binary search in the directory, then in the blocks.

    A sample of at most about COARSE directory entries goes along with the search; what lies between two of it is joined. The
    keys that a block is searched for come in groups of a few times the block's lines."""
    directory = index.select("block", "first_key", "last_key")
    n = directory.count()
    step = max(1, -(-n // COARSE))
    firsts = np.array(sorted(r[0] for r in directory.where(F.pmod(F.xxhash64("block"), F.lit(step)) == 0).select("first_key").collect()), object)

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(firsts, key.to_numpy(object), side="right"))

    wanted = keys.select("url", "key").distinct().withColumn("part", place("key"))
    spans = directory.withColumns({"low": place("first_key") - 1, "high": place("last_key")}).withColumn("part", F.explode(F.sequence(F.greatest("low", F.lit(0)), "high"))).drop("low", "high")
    hits = wanted.join(spans, "part").where("key >= first_key and key <= last_key").select("block", "url", "key")
    hits = written(hits.distinct(), "block-hits")
    groups = max(1, hits.count() // max(1, 4 * BLOCK * n))
    asked = hits.groupBy("block", F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("key", "url")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, pairs in zip(b.column(0), b.column(1)):
                keys, entries = block_lines(data.as_py())
                for pair in pairs.as_py():
                    for _, _, file, offset, length in entries[bisect.bisect_left(keys, pair["key"]) : bisect.bisect_right(keys, pair["key"])]:
                        out.append((pair["url"], file, int(offset), int(length)))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(columns)], ["url", "file", "offset", "length"])

    return written(asked.join(index.select("block", "data"), "block").select("data", "wanted").mapInArrow(run, ENTRIES), "entries")


def read_records(entries: DataFrame, folder: str, describe, schema: str) -> DataFrame:
    """describe(url, record) -> a row of schema, for each entry (ENTRIES); in tasks of about TASK_BYTES, by file and place."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    parts = max(1, -(-(entries.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES), min(entries.sparkSession.sparkContext.defaultParallelism, entries.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls, places, out, size = b.column(0).to_pylist(), list(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))), [], 0
            for url, place, found in zip(urls, places, read_ranges(folder, places)):
                out.append(describe(url, found))
                size += place[2]
                if size >= READ:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], arrow.names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], arrow.names)

    return entries.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


RECORDS = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read_archives(entries: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """The records of entries: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    found = read_records(entries, folder, lambda _, r: described(r), RECORDS)
    return found.select(F.col("page_id").cast(id_type), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type))


def url_keys(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The different URLs with their keys; a null URL has the empty key."""
    key_of = F.pandas_udf(lambda s: s.map(reversed_host_key), "string")
    return urls.select(F.col(url_col).alias("url")).distinct().withColumn("key", F.coalesce(key_of("url"), F.lit("")))


def look_up(index: DataFrame, folder: str, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """urls(url_col) -> (url, page_id, record_type, payload) of every capture of each URL; revisits have no payload. Null URLs
    are not looked up."""
    entries = find(index, url_keys(urls.where(F.col(url_col).isNotNull()), url_col))

    def describe(url: str, found: dict) -> tuple:
        page, _, _, kind, _ = described(found)
        return url, page, kind, found["payload"]

    return read_records(entries, folder, describe, "url string, page_id string, record_type string, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes pages to a folder of their own in the shared one, indexes the archives, and looks every key of the pages' URLs up
    there: each record has one key, so that all come back once."""
    folder = fresh_path(pages.sparkSession, "warc")
    index = build_index(write_archives(pages, folder, id_col, url_col, payload_col))
    keys = url_keys(pages, url_col).select("key").distinct().withColumn("url", F.lit(None).cast("string"))
    return read_archives(find(index, keys), folder, pages.schema[id_col].dataType.simpleString())
