"""WARC archives: a deterministic sharded writer and a streaming reader.

Records are dealt to shards by ranges of page_id that hold about `shard_bytes` of payload (from a
histogram, so the same table always gives the same shards), sorted inside a
shard, and rolled into files by compressed size. Every record is its own gzip member; headers, record
ids, block and payload digests are made anew. A task writes under a temporary name that only it uses
and renames the file when it is whole, so a second attempt replaces equal bytes by equal bytes;
readers see only what the manifest (a table that Spark commits at the end) lists.

Payloads of at least `revisit_bytes` that occur more than once are stored with the largest page_id;
the other records revisit it. Which ones is found on (page_id, digest) alone; the pages themselves are
shuffled once.

Defined results: null html is an empty payload; a null url becomes urn:page:<id>; a null page_id is
written without one, sorts first and is never referred to; repeated rows are repeated records (those
that share the largest page_id of a payload all carry it); an empty table gives no files. Only
page_id, url and html are stored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm.ranges import id_ranges
from phasegrid.llm.store import new_path

NAMES = uuid.UUID("8f2f8a54-63c6-4a0b-9d2e-0a3a4d1c7b11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard long, seq int, path string, bytes long, records long, sha1 string"
READ_BYTES = 1 << 20
PAGES_AT_ONCE = 256


def record_id(page_id: int | None, payload: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id} {payload}')}>"


def _digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line: control characters and spaces at the ends are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def format_record(kind: str, page_id: int | None, url: str | None, payload: bytes, date: str, refers_to: int | None) -> bytes:
    """One uncompressed record."""
    hexed = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, hexed)}", f"WARC-Date: {date}"]
    head.append(f"WARC-Target-URI: {_line(url) if url else f'urn:page:{page_id}'}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, hexed)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    block = f"software: phasegrid\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMES, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"WARC-Block-Digest: {_digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    """One archive file under its temporary name, until done() gives it its own."""

    def __init__(self, out: str, shard: int, seq: int, date: str) -> None:
        self.shard, self.seq, self.name = shard, seq, f"part-{shard:06d}-{seq:05d}.warc.gz"
        self.fs, root = pafs.FileSystem.from_uri(out)
        self.final, self.temporary = f"{root}/{self.name}", f"{root}/_temporary/{self.name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{root}/_temporary", recursive=True)
        self.stream, self.sha1, self.bytes, self.records = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha1(), 0, 0
        self._put(_info(self.name, date))

    def _put(self, record: bytes) -> None:
        member = gzip.compress(record, 6, mtime=0)
        self.stream.write(member)
        self.sha1.update(member)
        self.bytes += len(member)

    def add(self, record: bytes) -> None:
        self._put(record)
        self.records += 1

    def done(self) -> tuple:
        self.stream.close()
        if self.fs.get_file_info(self.final).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.final)  # an earlier attempt's, with the same bytes
        self.fs.move(self.temporary, self.final)
        return self.shard, self.seq, self.name, self.bytes, self.records, self.sha1.hexdigest()


def write_warc(pages: DataFrame, out: str, shard_bytes: int = 64 << 20, roll_bytes: int = 32 << 20, revisit_bytes: int = 1000, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes pages (page_id, url, html) as archives under the folder `out`; returns the manifest."""
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit(""))
    narrow = pages.select("page_id", payload.alias("html")).select("page_id", F.octet_length("html").cast("long").alias("bytes"), F.sha1(F.col("html").cast("binary")).alias("digest"))
    shard = id_ranges(pages.select("page_id", F.octet_length(payload).cast("long").alias("bytes")), "page_id", F.col("bytes"), shard_bytes)
    copied = narrow.filter(F.col("bytes") >= revisit_bytes).select("page_id", "digest")
    largest = copied.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    visits = copied.join(largest, "digest").filter("page_id is null and refers_to is not null or page_id < refers_to").distinct()
    # what a page revisits comes as a row of its own just before it: no join moves the pages
    notes = visits.select("page_id", "digest", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    rows = pages.select("page_id", F.sha1(payload.cast("binary")).alias("digest"), F.lit(None).cast("long").alias("refers_to"), "url", payload.alias("html"))
    met = shard(notes.unionAll(rows), "shard").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), shard.count), "shard")
    met = met.sortWithinPartitions("shard", "page_id", "digest", F.col("refers_to").isNull(), "url").select("shard", "page_id", "digest", "refers_to", "url", "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file: _File | None = None
        note: tuple = (None, None, None)
        for batch in batches:
            made = []
            for row in zip(*(batch.column(c) for c in batch.schema.names)):
                s, page_id, digest, refers_to, url, html = (x.as_py() for x in row)
                if refers_to is not None:
                    note = (page_id, digest, refers_to)
                    continue
                refers_to = note[2] if note[:2] == (page_id, digest) else None
                if file and (file.shard != s or file.bytes >= roll_bytes):
                    made.append(file.done())
                    file = _File(out, s, file.seq + 1 if file.shard == s else 0, date)
                file = file or _File(out, s, 0, date)
                file.add(format_record("response" if refers_to is None else "revisit", page_id, url, html.encode(), date, refers_to))
            if made:
                yield _rows(made)
        if file:
            yield _rows([file.done()])

    # whole pages go to Python: a few hundred at a time
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    spark.conf.set(key, str(PAGES_AT_ONCE))
    try:
        met.mapInArrow(write, MANIFEST).write.parquet(f"{out}/_manifest")
    finally:
        spark.conf.set(key, usual)
    fs, root = pafs.FileSystem.from_uri(out)
    if fs.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{root}/_temporary")  # what attempts that were lost have left
    return spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")


def _rows(made: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["shard", "seq", "path", "bytes", "records", "sha1"])


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    inflate, parts = zlib.decompressobj(31), []
    while chunk := stream.read(READ_BYTES):
        while chunk:
            parts.append(inflate.decompress(chunk))
            if not inflate.eof:
                break
            yield b"".join(parts)
            chunk, inflate, parts = inflate.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of one record; its digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a record: {version[:40]!r}")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != _digest(block):
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n") if headers["WARC-Type"] in ("response", "revisit") else (b"", b"", block)
    if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != _digest(payload):
        raise ValueError(f"damaged payload in {headers['WARC-Record-ID']}")
    return headers, http, payload


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_warc(spark: SparkSession, out: str, payload: bool = True) -> DataFrame:
    """The response and revisit records of all files that the manifest lists; with payload: html string (null for revisits)."""
    schema = RECORDS + (", html string" if payload else "")
    files = spark.read.schema(MANIFEST).parquet(f"{out}/_manifest").select("path")
    names = [x.split(" ")[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()][: len(names)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    for raw in members(stream):
                        headers, http, body = parse_record(raw)
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        size = int(http.decode().rpartition("Content-Length: ")[2].split("\r\n")[0])
                        hexed = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        ids = [int(headers[k]) if k in headers else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")]
                        rows.append((ids[0], headers["WARC-Target-URI"], kind, size, hexed, ids[1], body.decode() if kind == "response" else None)[: len(names)])
                        held += len(body) if payload else 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names)

    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame, out: str | None = None) -> DataFrame:
    """Writes the pages as archives (in the shared folder unless told where) and returns the records read back, without payloads."""
    out = out or new_path(pages.sparkSession, "warc")
    write_warc(pages, out)
    return read_warc(pages.sparkSession, out, payload=False)
