"""WARC archives: distributed writing, and a splittable reader for archives of one gzip member a record.

Reading: a task has a byte range. It looks for the gzip magic from the range's first byte and takes a candidate as its
first member if that decodes whole (checksum included) to a WARC record, with another record or the end behind it. From
there on (from byte 0 in a file's first range) records follow one another, but for padding (zeros, line ends): anything
else, a broken or a cut-off record is an error, never skipped. A task owns every record that starts inside its range,
reads on past the range's end to finish the last one, and makes sure that a record, or the end, comes next.
``check_counts`` holds what was read against the manifest. Archives lie in the shared folder; tasks open them through
pyarrow's file systems (file, hdfs, s3, gs, abfs).

Cases: null html is an empty payload; null urls and ids leave their header out and come back as null. Repeated rows
give a record each; rows that share the largest page_id of a payload are all responses, with one record id where they
are equal. A large payload without any page_id is a response. A payload that holds stored gzip members with whole WARC
records, one after the other, can be told from records of the archive only from byte 0 on: where a range begins inside
it, reading ends with an error and needs a larger ``split_bytes``. Other columns are ignored, whatever their names. No rows give no
archives and an empty result.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import new_path, qualified, written
from .words import slices

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 8 << 20
READ = 1 << 18
MOST_TASKS = 50_000
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PADDING = b"\0\r\n"
SCHEMES = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, _, rest = uri.partition(":")
    if not rest or scheme not in SCHEMES:
        if "://" in uri:
            raise ValueError(f"archives can't be kept under {uri}: tasks open {', '.join(SCHEMES)} only")
        return pafs.LocalFileSystem(), uri
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(uri.replace("s3a:", "s3:", 1))


def record_id(page_id: int | None, payload_digest: str) -> str:
    """The id of a response that others may revisit: the same wherever it is worked out."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    own = f"<urn:uuid:{uuid.uuid4()}>" if revisit else record_id(page_id, digest)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(0x21, 0x7F)))))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives; returns the manifest ``path, size, records``.

    Payloads of at least ``least`` bytes that are equal (by SHA-1) are stored with the largest page_id; other
    rows revisit it. ``date`` is the records' WARC-Date, now if not given. An archive is moved to its name once it is whole, and only archives of tasks that ended are in
    the manifest, so a task that runs twice leaves no record twice.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder or new_path(spark, "warc"))
    file_system(folder)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.withColumn("d", F.when(F.octet_length("html") >= least, F.sha1(F.encode("html", "UTF-8"))))
    firsts = keyed.filter("d is not null").groupBy("d").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1 and top is not null").select("d", "top")
    # Small payloads get keys of their own, which no digest equals, so that they are dealt out evenly.
    keyed = keyed.withColumn("d", F.coalesce("d", F.concat(F.lit("-"), F.xxhash64("page_id", "url", "html").cast("string"))))
    marked = keyed.join(firsts, "d", "left").select("page_id", "url", "html", F.when(~F.col("top").eqNullSafe(F.col("page_id")), F.col("top")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        store.create_dir(f"{base}/open", recursive=True)
        out = name = None
        size = count = 0
        done = []

        def close():
            out.close()
            store.move(f"{base}/open/{name}", f"{base}/{name}")
            done.append((f"{folder}/{name}", size, count))

        for b in slices(batches, "html"):
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/open/{name}", compression=None)
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, refers_to is not None, date)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done, strict=True)) or [[], [], []], (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "size", "records"])

    return written(marked.mapInArrow(run, "path string, size long, records long"), "manifest")


class _Range:
    """Bytes of a file from a place on, read as they are asked for."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, bytearray()
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(READ)
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.at += n

    def padded(self, n: int) -> int:
        """Where the padding that begins at ``n`` ends."""
        while n < len(self.data) or self.more():
            if self.data[n] not in PADDING:
                break
            n += 1
        return n

    def over(self, n: int = 0) -> bool:
        """If the file ends at ``n``."""
        return n >= len(self.data) and not self.more()

    def record_at(self, n: int) -> bool:
        """If a gzip member that begins like a WARC record begins at ``n``."""
        unpack, got = zlib.decompressobj(31), b""
        while len(got) < 5 and not unpack.eof and not self.over(n):
            piece = bytes(self.data[n : n + 512])
            try:
                got += unpack.decompress(piece, 5)
            except zlib.error:
                return False
            n += len(piece)
        return got[:5] == b"WARC/"


def member(src: _Range) -> tuple[bytes, int] | None:
    """The member at the start of ``src`` and its packed length; None if this is not a record's member.

    What begins like a record but does not decode whole is an error.
    """
    if not src.record_at(0):
        return None
    unpack, parts, used = zlib.decompressobj(31), [], 0
    while not unpack.eof:
        if src.over(used):
            raise ValueError(f"the record at byte {src.at} is cut off")
        piece = bytes(src.data[used : used + READ])
        try:
            parts.append(unpack.decompress(piece))
        except zlib.error as e:
            raise ValueError(f"the record at byte {src.at} is broken: {e}") from e
        used += len(piece) - len(unpack.unused_data)
    return b"".join(parts), used


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's block has not the length that its header states")
    return fields, block


def records_in(path: str, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, headers and block of the records of an archive that start from ``start`` up to before ``end``."""
    store, local = file_system(path)
    with store.open_input_file(local) as file:
        src = _Range(file, start)
        follows = start == 0  # if a record, padding or the end must be here
        while True:
            if follows:
                src.skip(src.padded(0))
                if src.over():
                    return
            else:
                place = src.data.find(MAGIC)
                if place < 0:
                    src.skip(max(0, len(src.data) - 2))
                    if src.at >= end or not src.more():
                        return
                    continue
                src.skip(place)
            if src.at >= end:
                if follows and not src.record_at(0):
                    raise ValueError(f"{path}: no record at byte {src.at}")
                return
            got = member(src)
            if follows and got is None:
                raise ValueError(f"{path}: no record at byte {src.at}")
            if not follows and (got is None or not (src.over(after := src.padded(got[1])) or src.record_at(after))):
                src.skip(1)
                continue
            follows = True
            yield src.at, *parse(got[0])
            src.skip(got[1])


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Records of the archives of ``manifest`` (path, size): place, headers, digest and length of the payload, the payload."""
    ranges = manifest.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, F.col("size")).alias("end"))

    def row(path: str, place: int, fields: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(http.lower().partition(b"content-length: ")[2].partition(b"\r\n")[0])
        digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
        if fields["warc-type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"payload of record {fields['warc-record-id']} is not whole")
        page, refers = fields.get("page-id"), fields.get("refers-to-page-id")
        return path, place, fields["warc-record-id"], fields.get("warc-refers-to"), page and int(page), fields.get("warc-target-uri"), fields["warc-type"], length, digest, refers and int(refers), payload if payloads else None

    schema = pa.schema([("path", pa.string()), ("place", pa.int64()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, size = [], 0
                for place, fields, block in records_in(path, start, end):
                    rows.append(row(path, place, fields, block))
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    n = max(1, min(manifest.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 0, MOST_TASKS))
    return ranges.repartition(n, "path", "start").mapInArrow(run, "path string, place long, record_id string, refers_to_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def check_counts(found: DataFrame, manifest: DataFrame) -> None:
    """An error if an archive gave another number of records than ``manifest`` (path, records) states."""
    got = found.groupBy("path").agg(F.count("*").alias("got"))
    odd = manifest.select("path", "records").join(got, "path", "full").filter("coalesce(records, 0) <> coalesce(got, 0)").first()
    if odd:
        raise ValueError(f"{odd.path} should have {odd.records} records, but {odd.got} were read")


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes ``pages`` and reads the archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    manifest = write_archives(pages)
    found = written(read_archives(manifest, split_bytes, payloads=False).drop("payload"), "records")
    check_counts(found, manifest)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
