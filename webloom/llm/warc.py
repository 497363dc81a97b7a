"""WARC archives: a writer of one gzip member a record, and a splittable reader.

The writer goes through Spark's own file sink, so archives may lie in any store that
Spark can write. Each record is a gzip member, and a file is its members one after
another, a ``warcinfo`` record first, as any gzip or WARC reader expects. (The sink ends
each row with a zero byte. A member ends with one, the highest byte of its size, so this
one is left out of the row; a record of 16 MB or more is followed by an empty member for
that.) A payload of at least ``min_revisit`` bytes is stored once, with the largest key
that has it; the other records with it are revisits that name that key.

The reader cuts every file into byte ranges. A task scans its range for the gzip
magic, inflates the head of each candidate member and takes it for a record only
if that starts with a WARC version line; it owns the records that start in its range
and reads on past the end of it to finish the last one. Magic bytes that turn up
inside compressed data fail this test, or lie inside a member already read.

Archives of other writers are read as well: record ids of any form (``record_id``;
``page_id`` is null then), digests in hexadecimal or base 32 of any usual algorithm or none,
HTTP answers of stated, unstated or chunked length, field names of either case. A record that
does not hold what it states has a row like any other, which says so in ``error``; all
records but responses and revisits are passed over.

Cases: a null payload is empty; a null key is written as such and read back as null.
Repeated rows make a record each, the same one for equal key and payload. An empty
table makes no record. Other columns are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import scratch

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a file that one task owns; payloads below MIN_REVISIT bytes are always stored.
RANGE_BYTES = 8 << 20
MIN_REVISIT = 1000
_READ_BYTES = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(key: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response, or a revisit without payload if ``refers_to`` is given."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if key is None else key}>",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def info(date: str) -> bytes:
    """The record that opens a file."""
    body = b"software: webloom\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member, with an empty one after it if else its last byte were not zero."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    made = packer.compress(data) + packer.flush()
    return made if made[-1] == 0 else made + member(b"")


def _members(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    opened = False
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "length", "refers_to")]
        made = [member(record(k, u, h or b"", d, n, r, date)) for k, u, h, d, n, r in zip(*columns, strict=True)]
        if made and not opened:
            made, opened = [member(info(date)), *made], True
        yield pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in made], pa.binary())], ["member"])


def plan_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, length and refers_to.

    The key to join on is a pair of digests. A payload that many pages share has one
    row on the other side; such hot payloads are few and go out as a broadcast, the
    rest meet in a shuffle in which no key is hot.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), payload.alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("length"), F.sha2(payload, 256).alias("strong")
    )
    slim = keyed.select("page_id", "strong", "length")
    shared = (
        slim.where(F.col("length") >= MIN_REVISIT)
        .groupBy("strong")
        .agg(F.max("page_id").alias("kept_by"), F.count("*").alias("n"))
        .where("n > 1")
    )
    shared = scratch.materialize(shared, "warc-shared")
    total = max(1, shared.agg(F.sum("n")).first()[0] or 0)
    hot_from = max(64, total // 2000)  # so there are at most 2000 hot payloads
    hot = F.broadcast(shared.where(F.col("n") >= hot_from).select(F.col("strong").alias("strong"), F.col("kept_by").alias("hot_kept_by")))
    cold = shared.where(F.col("n") < hot_from).select("strong", "kept_by")
    with_hot = keyed.join(hot, "strong", "left")
    # rows of hot payloads and rows too short for revisits meet nothing, so they are dealt by their own key
    salted = with_hot.withColumn("strong", F.when(F.col("hot_kept_by").isNull() & (F.col("length") >= MIN_REVISIT), F.col("strong")).otherwise(F.concat(F.lit("-"), F.col("page_id").cast("string"))))
    joined = salted.join(cold, "strong", "left")
    kept_by = F.coalesce("hot_kept_by", "kept_by")
    return joined.withColumn("refers_to", F.when(kept_by.isNotNull() & ~F.col("page_id").eqNullSafe(kept_by), kept_by)).select(
        "page_id", "url", "html", "digest", "length", "refers_to"
    )


def write(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) as ``.warc.gz`` files below ``path``, dated now or as given."""
    spark = pages.sparkSession
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    members = plan_revisits(pages).mapInArrow(lambda it: _members(it, date), "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = folder(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for uri, _ in files_below(spark, path):
        if uri.endswith(".txt"):
            store.rename(folder(uri), folder(uri.removesuffix(".txt") + ".warc.gz"))


class _Window:
    """Bytes of a file from ``start`` on, read a piece at a time."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.data = file, start, size, bytearray()

    def upto(self, end: int) -> bytearray:
        """Bytes from ``start`` to at least ``end``, if the file has them."""
        end = min(end, self.size)
        while self.start + len(self.data) < end:
            piece = self.file.read_at(min(max(_READ_BYTES, 0), self.size - self.start - len(self.data)), self.start + len(self.data))
            if not piece:
                break
            self.data += piece
        return self.data

    def forget(self, before: int) -> None:
        if before > self.start:
            del self.data[: before - self.start]
            self.start = before


def _inflate(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The record that starts at byte ``at`` and the byte after its member, or None if there is none."""
    reader, out, done, looked = zlib.decompressobj(31), [], 0, False
    try:
        while not reader.eof:
            data = window.upto(at + done + _READ_BYTES)
            piece = data[at - window.start + done : at - window.start + done + _READ_BYTES]
            if not piece:
                return None
            if not looked:  # a cheap look at the head first
                if not zlib.decompressobj(31).decompress(piece[:1024], 16).startswith(b"WARC/1."):
                    return None
                looked = True
            out.append(reader.decompress(piece))
            done += len(piece)
    except zlib.error:
        return None
    return b"".join(out), at + done - len(reader.unused_data)


def records_from(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """Records whose first byte lies in [start, end)."""
    window, at = _Window(file, start, size), start
    while at < end:
        data = window.upto(at + _READ_BYTES)
        found = data.find(MAGIC, at - window.start)
        if found < 0:
            after = window.start + len(data) - len(MAGIC) + 1
            if after <= at or window.start + len(data) >= size:
                return
            at = after
            window.forget(at)
            continue
        at = window.start + found
        if at >= end:
            return
        got = _inflate(window, at)
        if got is None:
            at += 1
        else:
            yield got[0]
            at = got[1]
        if at - window.start > 4 * _READ_BYTES:
            window.forget(at)


_PAGE = re.compile(r"<urn:page:(-?\d+)>")
#: Digest algorithms by the names that records give them, and their bytes.
DIGEST_BYTES = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}


def _headers(head: bytes) -> dict[str, str]:
    """Fields after the first line, by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def _page(record_id: str) -> int | None:
    found = _PAGE.fullmatch(record_id)
    return int(found[1]) if found else None


def _stated_digest(value: str) -> tuple[str, str] | None:
    """Algorithm and lower-case hex of a digest field, in hexadecimal or base 32; None for other algorithms."""
    kind, _, digest = value.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in DIGEST_BYTES:
        return None
    if len(digest) == 2 * DIGEST_BYTES[kind]:
        return kind, digest.lower()
    return kind, base64.b32decode(digest.upper().rstrip("=") + "=" * (-len(digest.rstrip("=")) % 8)).hex()


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunks; ValueError if it is none."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        part = body[line + 2 : line + 2 + size]
        if size < 0 or len(part) < size:
            raise ValueError("chunk cut short")
        parts.append(part)
        at = line + 4 + size


def _payload(fields: dict[str, str], rest: bytes) -> dict:
    """Size and digest of a record's payload, and what is wrong with it."""
    stated = fields.get("content-length", "")
    if not stated.isdecimal():
        return {"error": "no length"}
    block = rest[: int(stated)]
    head, _, payload = block.partition(b"\r\n\r\n")
    http = _headers(head) if head.startswith(b"HTTP/") else {}
    payload = payload if head.startswith(b"HTTP/") else block
    length, digest, wrong = http.get("content-length", ""), None, []
    if len(block) < int(stated):
        wrong.append(f"{len(block)} bytes of {stated}")
    with contextlib.suppress(ValueError):
        digest = _stated_digest(fields.get("warc-payload-digest", ""))
    if fields["warc-type"] == "revisit":
        own = digest[1] if digest and digest[0] == "sha1" else None
        return {"payload_bytes": int(length) if length.isdecimal() else None, "payload_digest": own, "error": "; ".join(wrong) or None}
    forms, chunked = [payload], "chunked" in http.get("transfer-encoding", "").lower()
    if chunked:  # some writers keep the field and store the payload whole
        with contextlib.suppress(ValueError):
            forms.insert(0, dechunked(payload))
    if digest and not any(hashlib.new(digest[0], form, usedforsecurity=False).hexdigest() == digest[1] for form in forms):
        wrong.append("payload does not match its digest")
    if length.isdecimal() and not chunked and int(length) != len(payload):
        wrong.append(f"payload of {len(payload)} bytes, {length} stated")
    own = hashlib.sha1(forms[0], usedforsecurity=False).hexdigest()
    return {"payload_bytes": len(forms[0]), "payload_digest": own, "error": "; ".join(wrong) or None}


def parse(raw: bytes) -> dict | None:
    """Fields of a record, size and digest taken from the payload where it is there; None for other than responses and revisits."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _headers(head)
    kind, record_id = fields.get("warc-type"), fields.get("warc-record-id", "")
    if kind not in ("response", "revisit"):
        return None
    found = {"page_id": _page(record_id), "payload_bytes": None, "payload_digest": None, "record_type": kind}
    found |= {"refers_to": _page(fields.get("warc-refers-to", "")) if kind == "revisit" else None, "record_id": record_id or None, "error": None}
    return found | _payload(fields, rest)


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, error string"


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _READ.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for path, size, start, end in zip(*[batch.column(c).to_pylist() for c in ("path", "size", "start", "end")], strict=True):
            store, name = pafs.FileSystem.from_uri(path)
            with store.open_input_file(name) as file:
                held: list[dict] = []
                for raw in records_from(file, size, start, end):
                    if (fields := parse(raw)) is not None:
                        held.append(fields)
                    if len(held) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], k) for n, k in zip(names, kinds, strict=True)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], k) for n, k in zip(names, kinds, strict=True)], names)


def files_below(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """URI and size of the files below ``path``, listed by Spark's own file systems."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    return [(str(f.getPath().toUri().toString()), int(f.getLen())) for f in listed if f.isFile() and not f.getPath().getName().startswith(("_", "."))]


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row per record of the archives below ``path``."""
    files = spark.createDataFrame(files_below(spark, path), "path string, size long").where("size > 0")
    starts = F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(range_bytes))).alias("start")
    ranges = files.select("path", "size", starts).withColumn("end", F.least("size", F.col("start") + range_bytes))
    n_ranges = files.agg(F.coalesce(F.sum(F.ceil(F.col("size") / range_bytes)), F.lit(0))).first()[0]
    # one range a task: the reader streams, so a task holds one record and a few MB of its file
    spread = ranges.repartition(max(1, min(int(n_ranges), 4000)), F.xxhash64("path", "start"))
    return spread.mapInArrow(_read_ranges, _READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back."""
    path = scratch.new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path).drop("record_id", "error")


def member_places(data: bytes) -> list[int]:
    """Places of the records in a file's bytes (for tests and tools)."""
    import io

    found, at = [], 0
    file = pa.PythonFile(io.BytesIO(data), mode="r")
    window = _Window(file, 0, len(data))
    window.upto(len(data))
    while (at := data.find(MAGIC, at)) >= 0:
        got = _inflate(window, at)
        if got is None:
            at += 1
        else:
            found.append(at)
            at = got[1]
    return found


