"""WARC archives: writing with revisit records, and a reader that salvages damaged ones.

Archives are written by the tasks, one gzip member per record, to any file system pyarrow knows.
Every attempt of a task uses names of its own and reports them in a manifest that Spark commits, so
files of lost or repeated attempts are never read. An archive is read as a stream by one task.

The reader checks every record: gzip checksum, version line, header lines, length, the line breaks at the
end and the digests. Where a check fails it searches for the next place from which a whole record passes,
a gzip member or a version line, and reports the bytes in between as a gap. The unpacked bytes of a member of
several records are searched in the same way, also if the member itself fails.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
import hashlib
import gzip
import re
import tempfile
from urllib.parse import quote, unquote
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, functions as F

from docquarry.session import materialize, shared_path

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20
#: A record that claims more is not believed.
MAX_RECORD_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"
_BLOCK = 1 << 20
#: A member that unpacks to more is held in a temporary file of the task, not in memory.
_SPOOL_BYTES = 16 << 20
_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|(?:(?<=\n)|\A)WARC/\d")
_LINE = re.compile(rb"(?:(?<=\n)|\A)WARC/\d")
_PRINTABLE = "".join(chr(c) for c in range(33, 127) if chr(c) not in "<>%\"")
_NO_ID = "-"


class Damaged(Exception):
    """A check that failed."""


def _record(kind: str, key: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload

    def urn(value: str | None) -> str:
        return f"<{_URN}{_NO_ID if value is None else quote(value, safe='')}>"

    lines = [("WARC-Type", kind), ("WARC-Record-ID", urn(key)), ("WARC-Date", DATE)]
    if url is not None:
        lines.append(("WARC-Target-URI", quote(url, safe=_PRINTABLE)))
    lines += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if kind == "revisit":
        lines += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", urn(refers_to))]
    lines += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {value}\r\n" for name, value in lines)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def with_roles(pages: DataFrame, key: str, url: str, payload: str, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``key``, ``url``, ``payload`` (bytes, NULL as empty), ``digest``, ``refers_to`` (NULL for a response)."""
    own = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"),
                       F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = own.where(F.octet_length("payload") >= least).groupBy("digest").agg(
        F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    later = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return own.join(firsts, "digest", "left").select(
        "key", "url", "payload", "digest", F.when(later, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` and return the manifest: ``path``, ``records``, ``bytes``.

    Of rows with equal payloads of at least 100 bytes the one with the smallest key is a response
    (with the rows that repeat its key), the others are revisits of it. Rows with a NULL key have
    no id in their record. Columns other than those named are not read.
    """
    own = with_roles(pages, key, url, payload).select(
        F.col("key").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = arrow_fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out = path = None
        records = size = 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{path}", "records": records, "bytes": size}], schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{path}", compression=None)
                own_key, own_url, data, digest, first = row
                member = gzip.compress(_record("revisit" if first is not None else "response", own_key, own_url, data, digest, first), 6, mtime=0)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    return materialize(own.mapInArrow(run, "path string, records long, bytes long"))


class Source:
    """Bytes of a file by position, read in blocks of which one is held."""

    def __init__(self, file, size: int | None = None):
        self.file, self.size = file, file.size() if size is None else size
        self._at, self._block = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self._at <= at or at + n > self._at + len(self._block):
            self.file.seek(at)
            self._at, self._block = at, self.file.read(max(n, _BLOCK))
        return self._block[at - self._at:at - self._at + n]


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in head.split(b"\r\n"):
        if line[:1] in b" \t" and line and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged("header line")
        last = name.strip().lower().decode("utf-8", "replace")
        out[last] = value.strip().decode("utf-8", "replace")
    return out


def _check_digest(stated: str | None, data: bytes, what: str) -> None:
    name, _, value = (stated or "").partition(":")
    if name.lower() not in ("sha1", "sha256", "md5"):
        return
    digest = hashlib.new(name.lower(), data)
    if value.lower() != digest.hexdigest() and value.upper() != base64.b32encode(digest.digest()).decode():
        raise Damaged(f"{what} digest")


def _parse(read, at: int, size: int) -> tuple[int, dict[str, str], bytes]:
    """(end, header fields, block) of the record at ``at``; ``read`` gives bytes by position."""
    head, step = b"", 2048
    while b"\r\n\r\n" not in head:
        got = read(at, min(len(head) + step, size - at))
        # Only what begins like a record is read on, as far as the header of a very long URL may go.
        if got and not _VERSION.match(got):
            raise Damaged("version line")
        if len(got) == len(head) or len(got) > MAX_RECORD_BYTES:
            raise Damaged("header end")
        head, step = got, 2 * step
    stop = head.index(b"\r\n\r\n")
    fields = _fields(head[head.index(b"\r\n") + 2:stop])
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or int(length) > MAX_RECORD_BYTES:
        raise Damaged("content length")
    start, end = at + stop + 4, at + stop + 8 + int(length)
    if end > size:
        raise Damaged("truncated record")
    block = read(start, int(length) + 4)
    if block[-4:] != b"\r\n\r\n":
        raise Damaged("record end")
    block = block[:-4]
    _check_digest(fields.get("warc-block-digest"), block, "block")
    return end, fields, block


def _unpacked(source: Source, at: int, out) -> tuple[int, str | None]:
    """Write what can be unpacked of the gzip member at ``at``; (where it ends or fails, the check that failed)."""
    unpack, pos, step = zlib.decompressobj(wbits=31), at, _BLOCK // 16
    while not unpack.eof:
        piece = source.read(pos, min(step, source.size - pos))
        if not piece:
            return pos, "truncated member"
        before = unpack.copy() if step > 1 else None
        try:
            out.write(unpack.decompress(piece))
        except zlib.error:
            if step == 1:
                return pos, "gzip member"
            # Again byte by byte, for what the bytes before the damage give.
            unpack, step = before, 1
            continue
        pos += len(piece)
    return pos - len(unpack.unused_data), None


def _vouched(fields: dict[str, str]) -> bool:
    """Whether a digest that can be checked stands for the block or, if that is all of it, the payload."""
    names = ("warc-block-digest",) if fields.get("warc-type") == "revisit" else ("warc-block-digest", "warc-payload-digest")
    return any(fields.get(name, "").partition(":")[0].lower() in ("sha1", "sha256", "md5") for name in names)


def _plain_at(source: Source, at: int) -> tuple[int, tuple[dict[str, str], bytes]]:
    """(end, record) of the plain record at ``at``, its digests checked."""
    end, fields, block = _parse(source.read, at, source.size)
    if fields.get("warc-type") != "revisit":
        _check_digest(fields.get("warc-payload-digest"), _payload(fields, block), "payload")
    return end, (fields, block)


def _lines(source: Source) -> Iterator[tuple[int, int, str | None, list[tuple[dict[str, str], bytes]]]]:
    """Like :func:`salvage` for unpacked bytes, where only version lines start records."""
    at = 0
    while at < source.size:
        reason, end, found = None, source.size, []
        place = source.size
        for place in (p for q in ((at,), _candidates(source, at + 1, _LINE), (source.size,)) for p in q):
            if place == source.size:
                end = place
                break
            try:
                end, record = _plain_at(source, place)
                found = [record]
                break
            except Damaged as failed:
                reason = reason or str(failed)
        if place > at:
            yield at, place - at, reason, []
        if found:
            yield place, end - place, None, found
        at = end


def _from_member(source: Source, at: int) -> Iterator[tuple[int, int, str | None, list[tuple[dict[str, str], bytes]]]]:
    """What :func:`salvage` gives for the member at ``at``; an error before anything else if nothing in it passes.

    A member that fails and holds no more than one whole record fails with it. Records of other members that
    fail their checksum need a digest of their own. Offsets are those of the member; a gap
    inside it names the unpacked bytes.
    """
    with tempfile.SpooledTemporaryFile(_SPOOL_BYTES) as out:
        end, failed = _unpacked(source, at, out)
        inner = Source(out, out.tell())
        if not inner.size and failed is None:
            yield at, end - at, None, []
            return
        first, waiting = None, []
        for place, length, reason, records in _lines(inner):
            if failed is not None and records:
                if length == inner.size:
                    raise Damaged(failed)
                if failed == "gzip member" and not _vouched(records[0][0]):
                    reason, records = failed, []
            if not records:
                first = first or reason
                gap = at, end - at, f"{reason}, bytes {place} to {place + length} unpacked", []
                if waiting is None:
                    yield gap
                else:
                    waiting.append(gap)
                continue
            yield from waiting or ()
            waiting = None
            yield at, end - at, None, records
        if waiting is not None:
            raise Damaged(failed or first or "no record")
        if failed is not None:
            yield at, end - at, failed, []


def _candidates(source: Source, at: int, pattern: re.Pattern[bytes] = _CANDIDATE) -> Iterator[int]:
    """Places from ``at`` on where a record might start."""
    overlap = 8
    while at < source.size:
        # One byte before tells whether a version line starts a line.
        before = min(1, at)
        window = source.read(at - before, min(_BLOCK // 2, source.size - at + before))
        for m in pattern.finditer(window, before):
            if m.start() < len(window) - overlap or at - before + len(window) == source.size:
                yield at - before + m.start()
        if at - before + len(window) == source.size:
            return
        at += max(1, len(window) - before - overlap)


def _payload(fields: dict[str, str], block: bytes) -> bytes:
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def salvage(source: Source) -> Iterator[tuple[int, int, str | None, list[tuple[dict[str, str], bytes]]]]:
    """(offset, length, reason, records): stretches that passed, and gaps with the check that failed."""
    at = 0
    while at < source.size:
        reason = None
        for place in (p for q in ((at,), _candidates(source, at + 1)) for p in q):
            try:
                if source.read(place, 3) == _MEMBER:
                    found = _from_member(source, place)
                    part = next(found)
                else:
                    end, record = _plain_at(source, place)
                    found, part = iter(()), (place, end - place, None, [record])
                break
            except Damaged as failed:
                reason = reason or str(failed)
        else:
            yield at, source.size - at, reason, []
            return
        if place > at:
            yield at, place - at, reason, []
        yield part
        yield from found
        at = place + part[1]


_SCHEMA = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gap", pa.string()), ("type", pa.string()), ("key", pa.string()),
    ("url", pa.string()), ("refers_to", pa.string()), ("stated_digest", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("payload", pa.binary())])


def _identifier(value: str | None) -> str | None:
    """The key in a record id of ours, the whole id of any other."""
    if value is None:
        return None
    value = value.strip("<>")
    if not value.startswith(_URN):
        return value
    key = value[len(_URN):]
    return None if key == _NO_ID else unquote(key)


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives named in the column ``path``, plain or gzipped.

    A row is a record (``gap`` is NULL) or a quarantined stretch of bytes (``gap`` names the first check that
    failed, all but ``path``, ``offset`` and ``length`` is NULL). Bytes and digest are those of the payload found; a revisit
    has none of its own. An empty archive gives no rows; one that is not there is an error.
    """
    count = max(1, paths.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            system, name = arrow_fs.FileSystem.from_uri(path)
            rows, held = [], 0
            with system.open_input_file(name) as file:
                for offset, length, reason, records in salvage(Source(file)):
                    if reason is not None or not records:
                        rows.append({"path": path, "offset": offset, "length": length, "gap": reason or "no record"})
                    for fields, block in records:
                        payload = _payload(fields, block)
                        kind = fields.get("warc-type")
                        url, own = fields.get("warc-target-uri"), kind != "revisit"
                        rows.append({
                            "path": path, "offset": offset, "length": length, "type": kind, "key": _identifier(fields.get("warc-record-id")),
                            "url": None if url is None else unquote(url), "refers_to": _identifier(fields.get("warc-refers-to")),
                            "stated_digest": fields.get("warc-payload-digest", "").rpartition(":")[2] or None,
                            "payload_bytes": len(payload) if own else None, "payload_digest": hashlib.sha256(payload).hexdigest() if own else None,
                            "payload": payload if own and with_payload else None})
                        held += len(payload) if with_payload else 64
                    if held > _BLOCK:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return paths.select("path").repartition(count).mapInArrow(
        run, "path string, offset long, length long, gap string, type string, key string, url string, refers_to string, "
             "stated_digest string, payload_bytes long, payload_digest string, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """``records`` without gaps, revisits with the bytes and digest of the response they refer to.

    A revisit whose response was lost keeps NULL bytes and the digest it states.
    """
    found = records.where("gap IS NULL")
    responses = found.where("type = 'response'").select(
        F.col("key").alias("_key"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).distinct()
    own = found.select("key", "url", "type", "refers_to", "payload_bytes", "payload_digest", "stated_digest")
    met = own.join(responses, (own["refers_to"] == responses["_key"]) & (own["stated_digest"] == responses["_digest"]), "left")
    return met.select("key", "url", "type", "refers_to", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
                      F.coalesce("payload_digest", "_digest", "stated_digest").alias("payload_digest"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to the shared folder, read the archives back and resolve the revisits.

    A gap in these archives is an error, since it would lose pages.
    """
    spark = pages.sparkSession
    manifest = write_archives(pages, shared_path(spark))
    records = materialize(read_archives(manifest, with_payload=False))
    lost = records.where("gap IS NOT NULL").select("path", "offset", "gap").first()
    if lost is not None:
        raise ValueError(f"{lost['path']} at {lost['offset']}: {lost['gap']}")
    return resolved(records)
