"""WARC archives with records compressed one by one against a dictionary that the archive carries.

Layout of an archive: a skippable frame (magic 0x184D2A5D) whose content is the Zstandard dictionary, then one Zstandard frame a
record. The dictionary is trained on records spread evenly over that archive, so that an archive can be read by itself, and any record
alone once the first frame is known. Records are of WARC/1.1: a `warcinfo` first, then `response` (an HTTP message with the page as its body)
and identical-payload `revisit` (the HTTP head alone). X-Page-ID and X-Refers-To-Page hold the ids of pages.

A null payload counts as empty. Payloads of under MIN_REVISIT bytes are never revisits. Among rows with one payload the
least id is the response; where even the id repeats, each row with the least id is one, with a record id of its own place in the archive.
A null id sorts last. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, shared_dir, stash, table, tuned

MIN_REVISIT = 100
#: Bytes of records that a task gathers for one archive; it holds them until the dictionary is trained.
ARCHIVE_BYTES = 16 << 20
DICT_BYTES = 64 << 10
#: Bytes of records that a dictionary is trained on, spread over the archive; and of one of them.
TRAIN_BYTES, TRAIN_RECORD = 2 << 20, 64 << 10
#: Parts that the rows of one digest are dealt to.
SALTS = 8
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _whole(kind: str, head: dict[str, str], block: bytes) -> bytes:
    fields = {"WARC-Type": kind} | head | {"Content-Length": str(len(block))}
    return "".join(("WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n")).encode() + block + _END


def record_id(page_id: int | None, digest: str) -> str:
    """The record of a page that others can refer to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def info(when: str, name: str) -> bytes:
    block = b"software: glossweave\r\nformat: WARC File Format 1.1\r\n"
    return _whole("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": when, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, block)


def record(page_id: int | None, url: str | None, digest: str, payload: bytes, first: int | None, when: str, own_id: str | None = None) -> bytes:
    """One WARC record. A revisit has no payload; its headers tell the payload's digest, length and first record."""
    head = {
        "WARC-Record-ID": own_id or (record_id(page_id, digest) if first is None else f"<urn:uuid:{uuid.uuid4()}>"),
        "WARC-Date": when,
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-ID": "" if page_id is None else str(page_id),
    }
    http = _HTTP.format(len(payload)).encode()
    if first is None:
        return _whole("response", head, http + payload)
    return _whole("revisit", head | {"WARC-Refers-To": record_id(first, digest), "X-Refers-To-Page": str(first), "WARC-Profile": PROFILE}, http)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record; raises ValueError if it isn't one."""
    head, found, rest = data.partition(_END)
    lines = head.decode().split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    # a value can be empty
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != _END:
        raise ValueError("record's length doesn't fit")
    return fields, rest[:n]


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; empty where there is too little to train on."""
    if len(samples) < 8 or sum(map(len, samples)) < 4096:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def spread(records: list[bytes]) -> list[bytes]:
    """Every so many-th record, so that all of them together hold about TRAIN_BYTES; of a long one its beginning."""
    step = max(1, -(-sum(min(len(r), TRAIN_RECORD) for r in records) // TRAIN_BYTES))
    return [r[:TRAIN_RECORD] for r in records[::step]]


class Writer:
    """Archives in a folder of any file system that Arrow reaches by its URI. A file gets its name once it is whole."""

    def __init__(self, folder: str, when: str) -> None:
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.when, self.waiting, self.waits, self.ids = when, [], 0, set()
        self.done: list[tuple[str, int, int]] = []

    def add(self, page_id: int | None, url: str | None, digest: str, payload: bytes, first: int | None) -> None:
        own = None
        if first is None:
            own = record_id(page_id, digest)
            if own in self.ids:  # a row that repeats another: nothing refers to it
                own = f"<urn:uuid:{uuid.uuid4()}>"
            self.ids.add(own)
        self.waiting.append(record(page_id, url, digest, payload, first, self.when, own))
        self.waits += len(self.waiting[-1])
        if self.waits >= ARCHIVE_BYTES:
            self._write()

    def _write(self) -> None:
        name = f"{uuid.uuid4().hex}.warc.zst"
        dictionary = train(spread(self.waiting))
        tool = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        size = 8 + len(dictionary)
        with self.fs.open_output_stream(posixpath.join(self.folder, "." + name), compression=None) as out:
            out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
            for x in (info(self.when, name), *self.waiting):
                frame = tool.compress(x)
                out.write(frame)
                size += len(frame)
        self.fs.move(posixpath.join(self.folder, "." + name), posixpath.join(self.folder, name))
        self.done.append((name, len(self.waiting), size))
        self.waiting, self.waits, self.ids = [], 0, set()

    def close(self) -> list[tuple[str, int, int]]:
        """(name, records of pages, bytes) of each archive."""
        if self.waiting:
            self._write()
        return self.done


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of one archive, one after the other; the archive is never whole in memory."""
    magic, n = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with its dictionary")
    dictionary = stream.read(n)
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if n else None)
    rest, one, got = b"", tool.decompressobj(), []
    while data := rest or stream.read(chunk):
        got.append(one.decompress(data))
        rest = b""
        if one.eof:
            yield b"".join(got)
            rest, one, got = one.unused_data, tool.decompressobj(), []
    if any(got):
        raise ValueError("the archive ends within a record")


def with_targets(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(page_id, url, payload, digest, first): first is the response that a revisit refers to, else null.

    What repeats is found by digests alone: payloads are not dealt by digest, as one payload can have a third of all rows, but by page
    and digest. Keys of digests are salted; AQE splits what is still too large. The narrow sides of both joins are hashed, so that no payload is sorted.
    """
    payload = F.coalesce(pages[html].cast("string").cast("binary"), F.lit(b""))
    narrow = pages.select(pages[key].alias("page_id"), payload.alias("payload")).where(F.length("payload") >= MIN_REVISIT).select("page_id", F.sha2("payload", 256).alias("digest"))
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("digest", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    again = narrow.withColumn("salt", salt).join(firsts.hint("shuffle_hash"), ["digest", "salt"]).where(F.col("page_id").isNull() | (F.col("page_id") != F.col("least")))
    again = again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("least").alias("first")).distinct()
    rows = pages.select(pages[key].alias("page_id"), pages[url].cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    return rows.join(again.hint("shuffle_hash"), rows["page_id"].eqNullSafe(again["p"]) & (rows["digest"] == again["d"]), "left").select("page_id", "url", "payload", "digest", "first")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Write every row as a record below the folder; one row (name, records, bytes) an archive, already on disk.

    A task that runs again writes files of other names; only those named in the result count.
    """
    tuned(pages.sparkSession)
    when = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(folder, when)
        for batch in by_bytes(batches, "payload"):
            for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "digest", "payload", "first")), strict=True):
                out.add(*row)
        done = out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], ["name", "records", "bytes"])

    return stash(with_targets(pages, key, html, url).mapInArrow(run, "name string, records long, bytes long"))


def read_archives(names: DataFrame, folder: str) -> DataFrame:
    """The records of the named archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    tuned(names.sparkSession)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def number(x: str | None) -> int | None:
        return int(x) if x else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for name in batch["name"].to_pylist():
                rows, size = [], 0
                with where.open_input_stream(posixpath.join(at, name), compression=None) as f:
                    for data in read_archive(f):
                        h, block = parse(data)
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        http, _, body = block.partition(_END)
                        told, n = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(http.rsplit(b" ", 1)[1])
                        revisit = h["WARC-Type"] == "revisit"
                        if not revisit and (len(body) != n or hashlib.sha256(body).hexdigest() != told):
                            raise ValueError(f"payload of {h['WARC-Record-ID']} doesn't have its digest")
                        rows.append((number(h["X-Page-ID"]), h["WARC-Target-URI"], n, told, h["WARC-Type"], number(h.get("X-Refers-To-Page")), None if revisit else body))
                        size += len(body)
                        if len(rows) >= 1000 or size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], fields)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], fields)

    return names.select("name").repartition("name").mapInArrow(run, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM f
"""
