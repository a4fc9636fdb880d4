"""WARC records in ZIP packages: write, find and range-read them without extraction.

A package is a ZIP file whose members are *stored*: ``archive/data.warc.gz`` (one gzip member per record, as usual for WARC) and
``indexes/index.cdxj`` (one JSON line per record with its offset and length in the archive member).  Because members are stored, a
record's place in the package is member offset + record offset, and one range read gets it.

Write: records with equal payloads of at least ``min_revisit`` bytes are one group; the one with the smallest id is the response,
the others are revisits that refer to it and hold no payload.  Groups are found on digests, the payload moves once.
Tasks write packages of bounded size under the shared folder and report them in a manifest.

Read: the end-of-central-directory record, its ZIP64 form and the central directory are parsed from range reads; the local header
gives where a stored member begins; index lines become (package, offset, length) rows that Spark deals out; each record is
read by its range, unpacked and parsed.  An archive member without an index is scanned record by record.  The digest of
every stored payload is computed anew and must equal the one in its header.

Null payloads are empty.  Null urls give no target URI.  Rows with a null id are written and read back (id null); they are
responses unless a row with an id has the same payload.  Rows that repeat an id and payload are each a response if their id is the group's smallest.
An empty table writes no package and reads no row.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import save, scratch_path, small_batches
from cohortlab.session import shuffle_partitions

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MIN_REVISIT, PACKAGE_BYTES = 100, 16 << 20
#: Bytes of packages that a reading task gets.
READ_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    return fs.FileSystem.from_uri(path)


# --- records -------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has headers only."""
    block = _HTTP if kind == "revisit" else _HTTP + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        escaped = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)
        head.append(("WARC-Target-URI", escaped))
        if escaped != url:  # a header line holds no line break, and an escape may have been there before
            head.append(("X-Target-URI-JSON", json.dumps(url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record; raises where digest or length do not hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
    if fields["warc-type"] != "revisit" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")

    def page(urn: str | None) -> int | None:
        number = (urn or "")[len("<urn:page:") : -1]
        return int(number) if number else None

    return {
        "page_id": page(fields["warc-record-id"]),
        "url": json.loads(fields["x-target-uri-json"]) if "x-target-uri-json" in fields else fields.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": page(fields.get("warc-refers-to")),
        "payload": None if fields["warc-type"] == "revisit" else payload,
    }


# --- packages ------------------------------------------------------------------------------------------------


class _Package:
    """A package in the making (bounded by ``PACKAGE_BYTES`` and one record)."""

    def __init__(self):
        self.data, self.lines = io.BytesIO(), []

    def add(self, page_id: int | None, raw: bytes, kind: str) -> None:
        packed = zlib.compressobj(1, zlib.DEFLATED, 31)
        at = self.data.tell()
        size = self.data.write(packed.compress(raw) + packed.flush())
        self.lines.append(json.dumps({"page_id": page_id, "offset": at, "length": size, "type": kind}))

    def write(self, folder: str) -> dict:
        path = f"{folder}/{uuid.uuid4().hex}.zip"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(zipfile.ZipInfo(DATA), self.data.getbuffer())
            z.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        system, name = open_path(path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(name) as f:
            f.write(out.getbuffer())
        return {"path": path, "records": len(self.lines), "bytes": out.tell()}


def _write(batches, folder: str, package_bytes: int):
    def done(p: _Package):
        row = p.write(folder)
        return pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    package = _Package()
    for batch in batches:
        for row in batch.to_pylist():
            raw = record(row["page_id"], row["url"], (row["html"] or "").encode("utf-8", "surrogatepass"), row["digest"], row["kind"], row["refers_to"])
            package.add(row["page_id"], raw, row["kind"])
            if package.data.tell() >= package_bytes:
                yield done(package)
                package = _Package()
    if package.lines:
        yield done(package)


def write_packages(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, package_bytes: int = PACKAGE_BYTES
) -> DataFrame:
    """Write the records of a table; the manifest ``path, records, bytes`` of the packages."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    text = F.coalesce("html", F.lit(""))
    rows = rows.withColumn("digest", F.sha2(text.cast("binary"), 256)).withColumn("size", F.octet_length(text))
    firsts = rows.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    marked = rows.join(firsts.select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = marked.select(
        "page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to")
    )
    return save(marked.mapInArrow(partial(_write, folder=folder, package_bytes=package_bytes), "path string, records long, bytes long"), "warc-manifest")


class ZipDirectory:
    """Members of a ZIP or ZIP64 file from range reads; ``read(at, size)`` returns bytes."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 65_557 - 20)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no ZIP end of central directory")
        count, length, at = struct.unpack("<HII", tail[end + 10 : end + 20])
        locator = end - 20
        if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
            (end64,) = struct.unpack("<Q", tail[locator + 8 : locator + 16])
            record64 = read(end64, 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("damaged ZIP64 end of central directory")
            count, length, at = struct.unpack("<QQQ", record64[32:56])
        self.members = self._parse(read(at, length), count)

    @staticmethod
    def _parse(directory: bytes, count: int) -> dict[str, dict]:
        out, p = {}, 0
        for _ in range(count):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("damaged ZIP central directory")
            method = struct.unpack("<H", directory[p + 10 : p + 12])[0]
            packed, size, n, m, k = struct.unpack("<IIHHH", directory[p + 20 : p + 34])
            (at,) = struct.unpack("<I", directory[p + 42 : p + 46])
            name = directory[p + 46 : p + 46 + n].decode("utf-8")
            extra, q = directory[p + 46 + n : p + 46 + n + m], 0
            while q + 4 <= len(extra):  # ZIP64 values stand in this order, each only where the short one is all ones
                tag, long = struct.unpack("<HH", extra[q : q + 4])
                if tag == 1:
                    values = iter(struct.unpack(f"<{long // 8}Q", extra[q + 4 : q + 4 + long // 8 * 8]))
                    size = next(values) if size == 0xFFFFFFFF else size
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    at = next(values) if at == 0xFFFFFFFF else at
                q += 4 + long
            out[name] = {"method": method, "packed": packed, "size": size, "header": at}
            p += 46 + n + m + k
        return out

    def stored(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes are: (offset, length)."""
        member = self.members[name]
        if member["method"] != 0:
            raise ValueError(f"{name} is not stored")
        head = self.read(member["header"], 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("damaged ZIP local header")
        n, m = struct.unpack("<HH", head[26:30])
        return member["header"] + 30 + n + m, member["size"]


def _scan(read, at: int, length: int, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Offset and length of each gzip member in a range, holding one step of bytes at a time."""
    p, start, unpack = 0, 0, zlib.decompressobj(31)
    while p < length:
        chunk = read(at + p, min(step, length - p))
        p += len(chunk)
        while chunk:
            unpack.decompress(chunk)
            if not unpack.eof:
                break
            chunk = unpack.unused_data
            stop = p - len(chunk)
            yield at + start, stop - start
            start, unpack = stop, zlib.decompressobj(31)


def _locate(batches):
    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, name = open_path(path)
            with system.open_input_file(name) as f:
                read = lambda at, size, f=f: f.read_at(size, at)
                directory = ZipDirectory(read, f.size())
                for member in [m for m in directory.members if m.startswith("archive/") and ".warc" in m]:
                    base, length = directory.stored(member)
                    if member == DATA and INDEX in directory.members:
                        lines = read(*directory.stored(INDEX)).decode().splitlines()
                        spots = [(base + x["offset"], x["length"]) for x in map(json.loads, lines)]
                    else:
                        spots = list(_scan(read, base, length))
                    for i in range(0, len(spots), 4096):
                        part = spots[i : i + 4096]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path] * len(part)), pa.array([a for a, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64())], schema=schema
                        )


RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    + [("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def _read(batches, with_payload: bool):
    schema = RECORD if with_payload else pa.schema(list(RECORD)[:-1])
    path = file = None
    try:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    if file is not None:
                        file.close()
                    system, name = open_path(row["path"])
                    path, file = row["path"], system.open_input_file(name)
                raw = file.read_at(row["size"], row["at"])
                out.append(parse(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw))
                if not with_payload:
                    out[-1].pop("payload")
            yield pa.RecordBatch.from_pylist(out, schema)
    finally:
        if file is not None:
            file.close()


def read_packages(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the packages listed in column ``path``: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]``.

    As many tasks as the packages' bytes ask for (column ``bytes`` of a manifest, else packages of the usual size): the rows that say
    where records lie are tiny, and Spark would put them all into one task.
    """
    spark = paths.sparkSession
    small_batches(spark)
    size = F.sum("bytes") if "bytes" in paths.columns else F.count(F.lit(1)) * PACKAGE_BYTES
    known = paths.agg(F.count(F.lit(1)).alias("packages"), F.coalesce(size, F.lit(0)).alias("bytes")).first()
    least = shuffle_partitions(spark)
    spots = paths.select("path").repartition(max(1, min(int(known["packages"]), max(least, int(known["packages"]) // 16))), "path")
    spots = spots.mapInArrow(_locate, "path string, at long, size long")
    # neighbouring records (about 64 to a piece) go to one task, so it reads a package forwards
    dealt = spots.repartition(max(least, int(known["bytes"]) // READ_BYTES), "path", F.expr("at div 1048576")).sortWithinPartitions("path", "at")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return dealt.mapInArrow(partial(_read, with_payload=with_payload), schema + (", payload binary" if with_payload else ""))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write a table as packages under the shared folder and read the records back."""
    return read_packages(write_packages(pages, scratch_path(spark, "warc")), with_payload=False)
