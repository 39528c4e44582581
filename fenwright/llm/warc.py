"""Operator 8: WARC archives with a two-level capture index.

Each task writes the records that it scans to an archive file of its own, one gzip member per record, and returns a line per
record: the URL as a sort key with the host's labels reversed, and the record's file, offset and length. The lines are sorted
over all files by range partitioning (key, then page id, so a frequent key is split) and written as blocks of compressed
lines. At the end of an index file stands its sparse directory, the first line and the place of each block. A lookup does a
binary search over the index files' ranges, over a file's directory and over a block's lines, and then reads the bytes
of the record; many lookups are sorted and dealt out like the index. The list of index files has one line per partition, which
is all that the driver ever holds.

Records with equal payloads of at least `min_bytes` are stored once: the one with the largest page id is a response, the others
are revisits that name it. A file's name holds a random part and only the lines of a task attempt that ended well are
kept, so a task that is lost or run twice does no harm.

Defined cases: a null html is an empty payload; a null URL is an empty one; among equal payloads a null page id is a revisit of
the largest id, unless none has an id; rows that share the largest id and the payload are all responses; repeated rows are
records of their own; other columns are ignored; an empty table gives an archive without records."""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_back, lower_ascii, shared_dir, stored, table

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
#: Characters besides letters, digits and `_.-~` that a header holds as they are. A URL of these alone, percent signs included, is written as it
#: is. In any other one all else is quoted, percent signs too, and a header says so: each URL reads back.
_PLAIN = ":/?#[]@!$&()*+,;="


def sort_key(url: Column) -> Column:
    """`com,example,www)/path?query` of `http://www.example.com/path?query`: scheme, fragment and the host's case are dropped."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    host = lower_ascii(F.regexp_extract(u, r"(?s)^(?:[^:/?#]+://)?([^/?#]*)", 1))
    rest = F.regexp_extract(u, r"(?s)^(?:[^:/?#]+://)?[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member. A record with refers_to is a revisit and holds no payload."""
    kind = "response" if refers_to is None else "revisit"
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    block = _HTTP + (payload if refers_to is None else b"")
    quoted = quote(url, safe=_PLAIN + "%") != url
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {quote(url, safe=_PLAIN) if quoted else url}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {len(payload)}",
    ]
    if quoted:
        head.append("X-Target-URI-Quoted: yes")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes

    @property
    def url(self) -> str:
        uri = self.headers.get("warc-target-uri", "")
        return unquote(uri) if "x-target-uri-quoted" in self.headers else uri

    def number(self, name: str) -> int | None:
        value = self.headers.get(name)
        return None if value is None else int(value)


def parse_record(member: bytes) -> Record:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    n = int(headers["content-length"])
    if len(rest) < n or not raw.startswith(b"WARC/"):
        raise ValueError("broken record")
    payload = rest[:n].partition(b"\r\n\r\n")[2]
    if headers["warc-type"] == "response" and "sha1:" + payload_digest(payload) != headers["warc-payload-digest"]:
        raise ValueError("digest of a payload differs")
    return Record(headers, payload)


@dataclass
class Archive:
    """uri: the folder; files: (first place, last place, name) of the index files, sorted."""

    spark: SparkSession
    uri: str
    files: list[tuple[tuple, tuple, str]]


def place(key: str, page_id: int | None) -> tuple:
    """Where a line stands in the index: by key, then page id, null first."""
    return key, page_id is not None, page_id or 0


def _write_records(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        name, out, at = f"records-{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for b in batches:
                offset, length = [], []
                for page_id, url, payload, refers in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("payload"), b.column("refers_to").to_pylist(), strict=True):
                    member = record_bytes(page_id, url, payload.as_py(), refers)
                    out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(member)
                    offset.append(at)
                    length.append(len(member))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("page_id"), pa.array([name] * len(b)), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    return run


def _write_index(uri: str, block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        name, out, at = f"index-{uuid.uuid4().hex}.cdx", None, 0
        directory: list[tuple[tuple, tuple, int, int, int]] = []
        held: list[tuple] = []

        def flush(lines: list[tuple]) -> None:
            nonlocal out, at
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            out.write(data)
            directory.append((lines[0][:2], lines[-1][:2], at, len(data), len(lines)))
            at += len(data)

        for b in batches:
            held += zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)
            while len(held) >= block_lines:
                flush(held[:block_lines])
                held = held[block_lines:]
        if held:
            flush(held)
        if out:
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + struct.pack("<Q", len(tail)))
            out.close()
            (k, i), (m, j) = directory[0][0], directory[-1][1]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((k, i, m, j, name), kinds, strict=True)], names=["k1", "p1", "k2", "p2", "file"])

    return run


def write_archive(pages: DataFrame, min_bytes: int = 0, block_lines: int = 1000, broadcast_rows: int = 200_000) -> Archive:
    """pages: page_id, url, html."""
    spark = pages.sparkSession
    uri = f"{shared_dir(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    p = p.withColumn("sha", F.when(F.length("payload") >= min_bytes, F.sha1("payload")))
    copies = p.filter("sha is not null").groupBy("sha").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
    copies = stored(copies.filter("n > 1"), "copies")
    if copies.count() <= broadcast_rows:
        p = p.join(F.broadcast(copies), "sha", "left")
    else:  # the payloads meet their roles in a shuffle, those of a frequent payload are dealt out
        p = join_back(p, copies, ["sha"], "n", pages.count(), ["page_id", "url"])
    p = p.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")))
    lines = p.select(sort_key(F.col("url")).alias("key"), "page_id", "url", "payload", "refers_to").mapInArrow(_write_records(uri), "key string, page_id long, file string, offset long, length long")
    lines = stored(lines, "captures").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    files = lines.mapInArrow(_write_index(uri, block_lines), "k1 string, p1 long, k2 string, p2 long, file string").collect()  # one row per partition
    return Archive(spark, uri, sorted((place(r["k1"], r["p1"]), place(r["k2"], r["p2"]), r["file"]) for r in files))


def _ranges(fs: pafs.FileSystem, path: str, places: list[tuple[int, int]], gap: int = 1 << 16, most: int = 1 << 23) -> Iterator[bytes]:
    """The bytes at each (offset, length); neighbours that are at most `gap` apart are read at once, up to `most` bytes."""
    with fs.open_input_file(path) as f:
        first = 0
        while first < len(places):
            last, end = first, sum(places[first])
            while last + 1 < len(places) and 0 <= places[last + 1][0] - end <= gap and sum(places[last + 1]) - places[first][0] <= most:
                last += 1
                end = sum(places[last])
            begin = places[first][0]
            data = f.read_at(end - begin, begin)
            yield from (data[at - begin : at - begin + n] for at, n in places[first : last + 1])
            first = last + 1


class Index:
    """Reads an archive's index. The directories and blocks used last are kept."""

    def __init__(self, uri: str, files: list[tuple[tuple, tuple, str]]) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.files = files
        self.directory = functools.lru_cache(8)(self._directory)
        self.block = functools.lru_cache(8)(self._block)

    def _directory(self, name: str) -> list[list]:
        """[first place, last place, offset, length, lines] of each block of an index file."""
        path = f"{self.root}/{name}"
        size = self.fs.get_file_info(path).size
        n = struct.unpack("<Q", next(_ranges(self.fs, path, [(size - 8, 8)])))[0]
        blocks = json.loads(zlib.decompress(next(_ranges(self.fs, path, [(size - 8 - n, n)]))))
        return [[place(*first), place(*last), *rest] for first, last, *rest in blocks]

    def _block(self, name: str, at: int, n: int) -> list[list]:
        return [json.loads(x) for x in zlib.decompress(next(_ranges(self.fs, f"{self.root}/{name}", [(at, n)]))).decode().split("\n")]

    def search(self, low: tuple, high: tuple) -> list[list]:
        """The lines [key, page id, file, offset, length] from place low to place high, by binary search over the files, a file's blocks and a
        block's lines."""
        out = []
        at = bisect.bisect_left(self.files, low, key=lambda f: f[1])
        while at < len(self.files) and self.files[at][0] <= high:
            name = self.files[at][2]
            directory = self.directory(name)
            k = bisect.bisect_left(directory, low, key=lambda d: d[1])
            while k < len(directory) and directory[k][0] <= high:
                lines = self.block(name, directory[k][2], directory[k][3])
                of = lambda x: place(x[0], x[1])
                out += lines[bisect.bisect_left(lines, low, key=of) : bisect.bisect_right(lines, high, key=of)]
                k += 1
            at += 1
        return out

    def records(self, lines: list[list]) -> Iterator[Record]:
        by_file: dict[str, list[tuple[int, int]]] = {}
        for _, _, file, offset, length in lines:
            by_file.setdefault(file, []).append((offset, length))
        for file, places in by_file.items():
            yield from map(parse_record, _ranges(self.fs, f"{self.root}/{file}", sorted(places)))


_FACTS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _facts(records: Iterator[Record]) -> pa.RecordBatch:
    rows: list[list] = [[], [], [], [], []]
    for r in records:
        size = len(r.payload) if r.headers["warc-type"] == "response" else r.number("x-payload-length")
        row = (r.number("x-page-id"), size, r.headers["warc-payload-digest"].removeprefix("sha1:"), r.headers["warc-type"], r.number("x-refers-to-page"))
        for col, x in zip(rows, row, strict=True):
            col.append(x)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def look_up(archive: Archive, pages: DataFrame) -> DataFrame:
    """The records of the captures of pages (page_id, url): each is found by binary search and read by its range. The captures wanted are sorted
    as the index is, so that a task reads each block once; a URL with many captures is dealt to many tasks, by page id."""
    uri, files = archive.uri, archive.files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(uri, files)
        for b in batches:
            wanted = [place(k, i) for k, i in zip(b.column("key").to_pylist(), b.column("page_id").to_pylist(), strict=True)]
            yield _facts(index.records([line for w in wanted for line in index.search(w, w)]))

    keys = pages.select(sort_key(F.col("url")).alias("key"), F.col("page_id").cast("long")).distinct()
    return keys.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, _FACTS)


def read_all(archive: Archive) -> DataFrame:
    """Every record, without a list of captures: the index's blocks are dealt out, and each gives the places of its records."""
    uri, files = archive.uri, archive.files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(uri, files)
        for b in batches:
            for name, at, n in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                yield _facts(index.records(index.block(name, at, n)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(uri, files)
        for b in batches:
            found = [(name, d[2], d[3]) for name in b.column(0).to_pylist() for d in index.directory(name)]
            cols = [*zip(*found, strict=True)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["file", "offset", "length"])

    spark = archive.spark
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = spark.createDataFrame([(f[2],) for f in files], "file string").repartition(n)
    blocks = names.mapInArrow(places, "file string, offset long, length long").repartition(n)
    return blocks.mapInArrow(run, _FACTS)


def find(archive: Archive, key: str) -> list[list]:
    """The index lines of a key: [key, page id, file, offset, length]."""
    return Index(archive.uri, archive.files).search(place(key, None), place(key, (1 << 63) - 1))


def fetch(archive: Archive, line: list) -> Record:
    return next(Index(archive.uri, archive.files).records([line]))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return look_up(write_archive(pages), pages)
