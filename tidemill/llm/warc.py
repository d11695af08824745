"""WARC archives: a data source that writes records as gzip members, and reads ranges of bytes of any archive.

Writing: a task writes one archive; a manifest that the driver writes at the commit names those that
count, so lost and repeated tasks leave nothing that is read. Of equal payloads one record has the
bytes, the others are revisits of it.

Reading: a task scans its range for the gzip magic, takes what decodes as a WARC record, owns the
records that start inside the range and reads the last of them past its end. What looks like a record
but lies inside another one is told by its end: if no record follows there, the range's first
record is looked up by a walk from the start of the archive.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidemill.llm._common import give_back, stored
from tidemill.shared import passing_path

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n"

#: Payloads of fewer bytes are always written whole.
LEAST = 1000
#: Bytes of an archive that a task reads the records of.
SPLIT = 32 << 20
#: Bytes read at once.
CHUNK = 1 << 18
#: Payload bytes in a batch of rows, and of the records that wait until their range's first record is certain.
BATCH, HELD = 8 << 20, 64 << 20
#: Bytes after its range in which a task sees whether records still follow each other.
AFTER = 1 << 20

#: What a record is written from: payload is null in revisits, digest is lower-case hexadecimal SHA-1 of the whole payload.
WRITTEN = "id string, type string, uri string, refers_to string, payload binary, digest string, n_bytes long"
#: What is read: http_bytes is the length that HTTP headers state. Rows with an error have file, offset and error only.
READ = "file string, offset long, type string, id string, uri string, date string, refers_to string, digest string, http_bytes long, payload binary, error string"


def member(data: bytes) -> bytes:
    """One gzip member without a time."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _plain(value: str) -> str:
    """A header's value: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(*, id: str, type: str, uri: str | None, refers_to: str | None, payload: bytes | None, digest: str, n_bytes: int, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response with its payload or a revisit without; both state the whole payload's length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [VERSION, f"WARC-Type: {type}", f"WARC-Record-ID: <{_plain(id)}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_plain(uri)}"] if uri else []
    head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{_plain(refers_to)}>"] if refers_to else []
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return BREAK.join(x.encode() for x in head) + BREAK * 2 + block + BREAK * 2


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _digest(value: str | None) -> str | None:
    """Hexadecimal from ``sha1:`` and base 32 or base 16."""
    name, _, text = (value or "").partition(":")
    if name.lower() != "sha1":
        return None
    if re.fullmatch(r"[0-9A-Fa-f]{40}", text):
        return text.lower()
    return base64.b32decode(text.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", text) else None


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"\d{1,18}", text) else None


def parsed(data: bytes) -> dict | None:
    """The record that a member holds; None if it is not one whole record."""
    head, found, rest = data.partition(BREAK * 2)
    lines = head.split(BREAK)
    named = _headers(lines[1:])
    size = _number(named.get("content-length"))
    if not found or not lines[0].startswith(b"WARC/") or size is None or len(rest) < size or rest[size:].strip(BREAK):
        return None
    block, http_bytes = rest[:size], None
    if named.get("content-type", "").startswith("application/http"):
        http, _, block = block.partition(BREAK * 2)
        http_bytes = _number(_headers(http.split(BREAK)[1:]).get("content-length"))
    kind = named.get("warc-type")
    bare = lambda name: named[name].strip("<>") if name in named else None
    return {
        "type": kind, "id": bare("warc-record-id"), "uri": named.get("warc-target-uri"), "date": named.get("warc-date"), "refers_to": bare("warc-refers-to"),
        "digest": _digest(named.get("warc-payload-digest")), "http_bytes": http_bytes, "payload": None if kind == "revisit" else block,
    }


class Bytes:
    """A file's bytes by place, through a buffer."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.at, self.held = handle, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.at <= at or at + min(n, self.size - at) > self.at + len(self.held):
            self.at, self.held = at, self.handle.read_at(max(n, CHUNK), at) if at < self.size else b""
        return self.held[at - self.at : at - self.at + n]

    def find(self, at: int, stop: int) -> int:
        """The first place from ``at`` and before ``stop`` where the magic starts; -1 if there is none."""
        while at < stop:
            some = self.read(at, min(CHUNK, stop - at) + len(MAGIC) - 1)
            if (i := some.find(MAGIC)) >= 0:
                return at + i if at + i < stop else -1
            at += max(1, len(some) - len(MAGIC) + 1)
        return -1


def decoded(source: Bytes, at: int) -> tuple[dict, int] | None:
    """The record of the member that starts at a place, and the place of its end."""
    inflate, out, pos = zlib.decompressobj(31), bytearray(), at
    while not inflate.eof:
        some = source.read(pos, CHUNK)
        if not some:
            return None
        try:
            out += inflate.decompress(some)
        except zlib.error:
            return None
        pos += len(some)
        if not out.startswith(b"WARC/"[: len(out)]):
            return None
    got = parsed(bytes(out))
    return None if got is None else (got, pos - len(inflate.unused_data))


def walk(source: Bytes, at: int, stop: int) -> Iterator[tuple[int, int, dict | None]]:
    """(start, end, record) of the records that start from ``at`` to before ``stop``; record is None for bytes that are none."""
    done, stop = at, min(stop, source.size)
    while at < stop and (at := source.find(at, stop)) >= 0:
        got = decoded(source, at)
        if got is None:
            at += 1
            continue
        if at > done:
            yield done, at, None
        yield at, got[1], got[0]
        at = done = got[1]
    if done < stop:
        yield done, stop, None


def owned(source: Bytes, start: int, stop: int) -> Iterator[tuple[int, dict | None]]:
    """(place, record) of the records that start in a range; record is None for bytes after a record that are none.

    An archive that a record of the range before has uncompressed inside looks like records. It ends inside that record, though, so
    a chain of records that breaks off before AFTER bytes past the range is compared with a walk from
    the archive's start. HELD bytes of records wait for that.
    """
    if start:
        wait, held, broken = [], 0, False
        found = walk(source, start, stop + AFTER)
        for at, _, got in found:
            if got is None and not wait:
                if at >= stop:
                    break
                continue  # the end of a record of the range before
            if got is None:
                broken = True
                break
            wait.append((at, got))
            held += len(got["payload"] or b"")
            if held > HELD:
                break
        if not broken:
            yield from (x for x in wait if x[0] < stop)
            yield from ((at, got) for at, _, got in found if at < stop)
            return
        start = next((at for at, _, got in walk(source, 0, stop) if got is not None and at >= start), stop)
    yield from ((at, got) for at, _, got in walk(source, start, stop))


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int
    size: int


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    size: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class WarcSource(DataSource):
    """``format("warc")``. Options: path (a folder or one archive, any store that ``pyarrow.fs`` opens), split (bytes of a range), date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are appended, not overwritten")
        return _Writer(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        store, path = _open(self.path)
        if store.get_file_info(path).type == fs.FileType.Directory:
            listed = store.get_file_info(fs.FileSelector(path))
            notes = [f.path for f in listed if f.base_name.startswith("_manifest-")]
            sizes = {f.path: f.size for f in listed if f.base_name.endswith(".warc.gz")}
            if notes:
                named = [x for n in notes for x in json.loads(store.open_input_stream(n).read())]
                sizes = {f"{path}/{x['file']}": x["size"] for x in named}
        else:
            sizes = {path: store.get_file_info(path).size}
        return [Range(f, a, min(a + self.split, n), n) for f, n in sorted(sizes.items()) for a in range(0, n, self.split)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        store, _ = _open(self.path)
        rows, held = [], 0
        with store.open_input_file(partition.file) as handle:
            for at, got in owned(Bytes(handle, partition.size), partition.start, partition.stop):
                rows.append({"file": partition.file, "offset": at, "error": None if got else "these bytes are no record", **(got or {})})
                held += len((got or {}).get("payload") or b"") + 200
                if held > BATCH:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)
        give_back()


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_READ = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in READ.split(", "))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _READ)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")
        store, path = _open(self.path)
        store.create_dir(path, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _open(self.path)
        name, out, size = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                    data = member(record(**row, date=self.date))
                    out = out or store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(data)
                    size += len(data)
        except BaseException:
            if out:
                out.close()
                store.delete_file(f"{path}/{name}")
            raise
        if out:
            out.close()
        return Written(name if out else None, size)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _open(self.path)
        named = [{"file": m.file, "size": m.size} for m in messages if m is not None and m.file]
        with store.open_output_stream(f"{path}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(named).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _open(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{path}/{m.file}")


def records_of(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """The records (WRITTEN) of pages: of equal payloads of ``least`` bytes the one with the largest key has the bytes.

    Null texts count as empty. A null key is smaller than any other; rows that share the largest key all
    have the bytes, and so do rows of a group without any key. Only digests are grouped, counted before they are
    shuffled; payloads stay where they are unless the groups with copies are too many to broadcast.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("uri"), payload.alias("payload")).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    # Short payloads are never joined: their group is null.
    rows = rows.withColumn("_group", F.when(F.col("n_bytes") >= least, F.sha2("payload", 256)))
    groups = rows.where("_group IS NOT NULL").groupBy("_group").agg(F.max("_key").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    copies = stored(groups.where("_n > 1 AND _kept IS NOT NULL").drop("_n"))
    named = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    again = F.col("_kept").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_kept"))
    return rows.join(copies, "_group", "left").select(
        named("_key").alias("id"),
        F.when(again, "revisit").otherwise("response").alias("type"),
        "uri",
        F.when(again, named("_kept")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
        F.sha1("payload").alias("digest"),
        "n_bytes",
    )


def write_archives(records: DataFrame, path: str, *, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes records (WRITTEN) into a folder, an archive per task."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").option("date", date).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, *, split: int = SPLIT) -> DataFrame:
    """The records (READ) of a folder's archives or of one archive, by ranges of ``split`` bytes."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("split", split).load(path)


def archived(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", split: int = SPLIT) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of pages, written to archives in the shared folder and read back."""
    path = passing_path(pages.sparkSession, "warc")
    write_archives(records_of(pages, key=key, url=url, html=html), path)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    whole = F.col("type") != "revisit"
    return read_archives(pages.sparkSession, path, split=split).select(
        number("id").alias(key),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("http_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )
