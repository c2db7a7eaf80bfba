"""WARC archives: a distributed writer with revisit records, and a reader that salvages what damage leaves.

The writer puts each record into a gzip member of its own and starts a new file at a size limit. The reader checks
each member and record; after a failed check it looks for the next member or version line, whichever comes first, that
holds a valid record, goes on from there, and tells the bytes in between as a gap. A member of many records is read in
the same way inside, as far as it unpacks.
"""

from __future__ import annotations

import base64
import hashlib
import mmap
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, raw_texts, shared_folder, write_shared

VERSION = b"WARC/1.0\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def _name(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: object, url: str | None, kind: str, payload_digest: str, payload_size: int, payload: bytes = b"", refers_to: object = None) -> bytes:
    """The bytes of one response or revisit record; a revisit has the HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_size}\r\n\r\n".encode()
    block = http + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _zip(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _filed(folder: str, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write the records of a partition to files of about `most` bytes; a file gets its name when it is whole."""
    fs, base = pafs.FileSystem.from_uri(folder)
    part, attempt, done, out = TaskContext.get().partitionId(), uuid.uuid4().hex, [], None
    size = count = 0

    def close() -> None:
        nonlocal out
        if out is not None:
            out.close()
            path = f"{base}/part-{part:06d}-{len(done):06d}-{attempt}.warc.gz"
            fs.move(f"{base}/.{attempt}", path)
            done.append((path, count, size))
            out = None

    for whole in batches:
        for batch in pieces(whole, "html", 4 << 20):
            ids, urls, refers = (batch.column(x).to_pylist() for x in ("page_id", "url", "refers_to"))
            for page_id, url, first, payload in zip(ids, urls, refers, raw_texts(batch.column("html")), strict=True):
                if out is None:
                    out, size, count = fs.open_output_stream(f"{base}/.{attempt}", compression=None), 0, 0
                kind, body = ("response", payload) if first is None else ("revisit", b"")
                data = _zip(record(page_id, url, kind, digest(payload), len(payload), body, first))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= most:
                    close()
    close()
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "n_records", "n_bytes"])


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = 16 << 20, most_sent: int = 500_000, salts: int = 16) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) below folder; returns path, n_records, n_bytes of each file.

    Of the pages whose UTF-8 payloads are equal and of at least least_bytes, that with the largest page_id is a
    response and the others revisit it; smaller ones are responses. A null html is an empty payload. Rows without a
    page_id are responses, and so are all rows that bear the largest; an empty table gives no file; further columns are
    left alone. Payloads that occur twice or more are found by their digests alone and counted: up to most_sent of these
    are sent to all tasks, and no payload is shuffled; more are joined, each page under one of `salts` parts of its
    digest, so that copies of one payload are no single task. A file is renamed into place when it is whole; the table
    that is returned names the files of the attempts that counted and writes when it is read, so write it down once.
    """
    pages = pages.select("page_id", "url", "html")
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    summed = pages.withColumn("_sum", F.unhex(F.sha1(body))).withColumn("_n", F.octet_length(body).cast("long"))
    copies = summed.filter(F.col("_n") >= least_bytes).groupBy("_sum", "_n").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    copies = write_shared(copies)
    if copies.count() <= most_sent:
        joined = summed.join(F.broadcast(copies), ["_sum", "_n"], "left")
    else:
        parted = copies.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = summed.withColumn("_part", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(parted.hint("merge"), ["_sum", "_n", "_part"], "left")
    rows = joined.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("_first"), F.col("_first")).alias("refers_to"))
    return rows.mapInArrow(lambda it: _filed(folder, file_bytes, it), "path string, n_records long, n_bytes long")


class Damage(ValueError):
    pass


class Unfinished(Damage):
    """What more bytes might mend."""


_MARK, _MEMBER = b"WARC/1.", b"\x1f\x8b\x08"


def parse_record(data: bytes, at: int, end: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record at `at`, or Damage."""
    if data[at : at + 7] != _MARK:
        raise Damage("no version line")
    stop = data.find(b"\r\n\r\n", at, end)
    if stop < 0:
        raise Unfinished("no end of header")
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if not sep:
            raise Damage("bad header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not {"warc-type", "warc-record-id", "warc-date"} <= head.keys():
        raise Damage("a mandatory field is missing")
    size = head.get("content-length", "")
    if not size.isdigit():
        raise Damage("no content length")
    to = stop + 4 + int(size)
    if to + 4 > end:
        raise Unfinished("record does not end where it should")
    if data[to : to + 4] != b"\r\n\r\n":
        raise Damage("record does not end where it should")
    block = bytes(data[stop + 4 : to])
    told = head.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != digest(block):
        raise Damage("block digest differs")
    return head, block, to + 4


def _inflated(data: bytes, at: int, step: int = 1 << 16) -> Iterator[tuple[bytes, int | None, str]]:
    """Pieces of what the gzip member at `at` unpacks to; last its end, or None and the reason where it is damaged."""
    unpack, i = zlib.decompressobj(31), at
    while not unpack.eof:
        piece = data[i : i + step]
        if not piece:
            yield b"", None, "member is cut off"
            return
        before = unpack.copy()
        try:
            out = unpack.decompress(piece)
        except zlib.error as e:
            for k in range(len(piece)):  # what stands before the damage
                try:
                    yield before.decompress(piece[k : k + 1]), None, ""
                except zlib.error:
                    break
            yield b"", None, str(e)
            return
        i += len(piece)
        yield out, None, ""
    yield b"", i - len(unpack.unused_data), ""


class _Member:
    """Reads the records of a member from its unpacked pieces; what has been read is let go of."""

    def __init__(self):
        self.held, self.at, self.gone, self.bad, self.why = bytearray(), 0, 0, None, ""
        self.gaps: list[str] = []
        self.follows = False  # a version line behind the last record

    def _gap(self, to: int) -> None:
        if self.bad is not None:
            self.gaps.append(f"unpacked bytes {self.bad} to {to}: {self.why}")
            self.bad = None

    def feed(self, piece: bytes, last: bool) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += piece
        while self.at < len(self.held):
            try:
                head, block, to = parse_record(self.held, self.at, len(self.held))
            except Damage as e:
                if not last and (isinstance(e, Unfinished) or len(self.held) - self.at < len(_MARK)):
                    break
                if self.bad is None:
                    self.bad, self.why = self.gone + self.at, str(e)
                    self.follows = self.held.startswith(_MARK, self.at)
                found = self.held.find(_MARK, self.at + 1)
                if found < 0 and not last:
                    self.at = max(self.at + 1, len(self.held) - len(_MARK) + 1)
                    break
                self.at = len(self.held) if found < 0 else found
                continue
            self._gap(self.gone + self.at)
            self.at, self.follows = to, False
            yield head, block
        if self.at > 1 << 20:
            self.gone += self.at
            del self.held[: self.at]
            self.at = 0
        if last:
            self._gap(self.gone + len(self.held))


def _next(data: bytes, at: int) -> int:
    """Where the next member or version line begins; the end if none does."""
    return min((x for x in (data.find(_MARK, at), data.find(_MEMBER, at)) if x >= 0), default=len(data))


def _member_end(data: bytes, at: int) -> tuple[int | None, str]:
    """The end of the member at `at`, or None and why it is damaged."""
    to, wrong = None, ""
    for _, to, wrong in _inflated(data, at):
        pass
    return to, wrong


def _member(data: bytes, at: int, most_held: int = 16 << 20) -> tuple[int | None, str, Iterator[tuple[dict[str, str], bytes]], _Member]:
    """End, reason of damage, records and reader of the member at `at`. A member of more than most_held bytes is read
    once for its end and once for its records, so that it is never held whole."""
    inside, held, size = _Member(), [], 0
    for piece, to, wrong in _inflated(data, at):
        for x in inside.feed(piece, to is not None or bool(wrong)):
            held.append(x)
            size += len(x[1])
        if size > most_held:
            again = _Member()
            more = (x for piece, to, wrong in _inflated(data, at) for x in again.feed(piece, to is not None or bool(wrong)))
            return *_member_end(data, at), more, again
    return to, wrong, iter(held), inside


def salvage(data: bytes) -> Iterator[tuple]:
    """('record', start, end, header, block) for what is sound and ('gap', start, end, reason, b'') for the rest.

    Start and end are those of the member for what lies in one; a gap inside a sound member tells its unpacked bytes in
    the reason. Of a damaged member the records that still unpack come inside its gap, with its start for both; the last
    of them counts only if another version line follows, for it may be what the failed check is about.
    """
    end, at, bad, why = len(data), 0, None, ""
    while at < end:
        if data[at : at + 3] == _MEMBER:
            to, wrong, records, inside = _member(data, at)
            if to is not None:
                count = 0
                for head, block in records:
                    if bad is not None:
                        yield "gap", bad, at, why, b""
                        bad = None
                    count += 1
                    yield "record", at, to, head, block
                if count or not inside.gaps:
                    for told in inside.gaps:
                        yield "gap", at, to, told, b""
                    at = to
                    continue
            else:
                last = None
                for x in records:
                    if last is not None:
                        yield "record", at, at, *last
                    last = x
                if last is not None and inside.follows:
                    yield "record", at, at, *last
            if bad is None:
                bad, why = at, "; ".join([*([wrong] if wrong else []), *inside.gaps])
            at = _next(data, at + 1) if to is None else to
            continue
        try:
            head, block, to = parse_record(data, at, end)
        except Damage as e:
            if bad is None:
                bad, why = at, str(e)
            at = _next(data, at + 1)
            continue
        if bad is not None:
            yield "gap", bad, at, why, b""
            bad = None
        yield "record", at, to, head, block
        at = to
    if bad is not None:
        yield "gap", bad, end, why, b""


def _payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


_READ = T.StructType([T.StructField(n, t) for n, t in (("file", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("gap", T.StringType()), ("record_type", T.StringType()), ("record_name", T.StringType()), ("url", T.StringType()), ("refers_to", T.StringType()), ("payload_digest", T.StringType()), ("payload_bytes", T.LongType()), ("payload", T.BinaryType()))])
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())


def _rows(path: str, data: bytes) -> Iterator[tuple]:
    for kind, start, end, head, block in salvage(data):
        if kind == "gap":
            yield path, start, end, head, None, None, None, None, None, None, None
            continue
        name = lambda x: (re.fullmatch(r"<urn:page:(.*)>", head.get(x, "")) or [None, None])[1]  # noqa: B023, E731
        told = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if head.get("warc-type") == "revisit":
            size = re.search(rb"(?i)content-length: *(\d+)", block)
            yield path, start, end, None, "revisit", name("warc-record-id"), head.get("warc-target-uri"), name("warc-refers-to"), told, int(size[1]) if size else None, None
        else:
            payload = _payload(block)
            yield path, start, end, None, head.get("warc-type"), name("warc-record-id"), head.get("warc-target-uri"), None, digest(payload), len(payload), payload


def _read(folder: str, with_payload: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, _ = pafs.FileSystem.from_uri(folder)
    for batch in batches:
        for path in batch.column("path").to_pylist():
            if isinstance(fs, pafs.LocalFileSystem):
                with open(path, "rb") as f:
                    size = f.seek(0, 2)
                    data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if size else b""
            else:
                with fs.open_input_file(path) as f:
                    data = f.read()
            held, size = [], 0
            for row in _rows(path, data):
                held.append(row if with_payload else (*row[:-1], None))
                size += len(row[-1] or b"") + 200
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(_KINDS)], _READ.names)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(_KINDS)], _READ.names)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the files below a folder."""
    fs, base = pafs.FileSystem.from_uri(folder)
    paths = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if x.is_file and not x.base_name.startswith("."))
    return spark.createDataFrame([(p,) for p in paths], "path string")


def read_archives(folder: str, files: DataFrame, with_payload: bool = True, most_tasks: int = 100_000) -> DataFrame:
    """One row for each record and each quarantined gap in the WARC files (plain or gzip) of a folder. files: their paths.

    A gap has a reason in `gap` and nothing from record_type on. A response's digest and size are those of the payload
    that was read; a revisit's are told by its header. Files are dealt out one by one, to most_tasks tasks at most; a
    local one is mapped, any other is read into the worker's memory. No file, or empty ones, give no rows; records of
    one name each give a row.
    """
    return files.select("path").repartition(max(1, min(files.count(), most_tasks)), "path").mapInArrow(lambda it: _read(folder, with_payload, it), _READ)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages as archives to the shared folder and read those back: page_id (as pages has it) and what read_archives()
    tells. See write_archives() for nulls, repeated rows and empty tables."""
    folder = shared_folder(pages.sparkSession)
    read = read_archives(folder, write_shared(write_archives(pages, folder, least_bytes)), with_payload=False)
    kind = pages.schema["page_id"].dataType
    name = lambda x: F.when(F.col(x) != "", F.col(x)).cast(kind)
    return read.select(name("record_name").alias("page_id"), "payload_bytes", "payload_digest", "record_type", name("refers_to").alias("refers_to"), "gap", "file", "start", "end", "url")
