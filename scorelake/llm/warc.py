"""WARC archives: writing pages, normalising whole-file gzip, reading records by offset.

An archive that was compressed as one gzip stream can only be read from its start. The normaliser
inflates each such file once, as a stream, writes every record as a gzip member of its own, and
writes a sidecar index with a line of JSON per record: its offset and length in the new file. Any
record can then be read alone, so a large archive is shared by many tasks.

Each task writes under a name of its own and renames the finished file, so a repeated task leaves
whole files only and the same bytes. Memory is bounded by a chunk when normalising and by a
record when reading. Folders are given as URIs that executors can reach (file, hdfs, s3, ...).

Defined cases: a NULL page is the empty payload; a NULL url is left out of the record; a NULL
page_id is kept as NULL and never referred to. Repeated rows of one page_id are alike: all of them
are responses if that id is the smallest of its payload. No pages give no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
#: Compressed bytes that one task reads back, about.
READ_BYTES = 64 << 20
_INDEX = "file string, offset long, length long, record_id string, type string"
_RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its file system, as Spark understands it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(where).toString()


def _finish(system: pafs.FileSystem, made: str, final: str) -> None:
    if system.type_name != "local" and system.get_file_info(final).type != pafs.FileType.NotFound:
        system.delete_file(final)
    system.move(made, final)


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    name = "page" if page_id is None else f"page:{page_id}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response, or a revisit without its payload if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload and refers_to: the smallest page_id of an equal payload.

    refers_to is NULL for that page itself and for payloads below min_bytes.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    )
    size, digest = F.octet_length("payload"), F.sha1("payload")
    keyed = rows.withColumn("digest", F.when(size >= min_bytes, F.concat_ws("-", digest, size)))
    firsts = keyed.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")
    )
    joined = keyed.join(firsts.where("n > 1").select("digest", "first_id"), "digest", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Writes each partition of with_revisits() as one gzip stream; returns a table of (file, n_records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.warc.gz"
        system, base = _opened(folder)
        made = f"{base}/work/{name}.{task.taskAttemptId()}"
        out, squeeze, count = None, zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = system.open_output_stream(made)
                out.write(squeeze.compress(record(row["page_id"], row["url"], row["payload"], row["refers_to"], date)))
                count += 1
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            _finish(system, made, f"{base}/archives/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["file", "n_records"])

    _folders(folder, "work", "archives")
    spark = pages.sparkSession
    pages.mapInArrow(run, "file string, n_records long").write.parquet(f"{folder}/written")
    return spark.read.parquet(f"{folder}/written")


def _folders(folder: str, *names: str) -> None:
    system, base = _opened(folder)
    for name in names:
        system.create_dir(f"{base}/{name}", recursive=True)


class _Inflated:
    """A gzip file of one or more members as a stream of plain bytes."""

    def __init__(self, stream) -> None:
        self.stream, self.plain, self.inflate = stream, bytearray(), zlib.decompressobj(31)
        self.packed = b""

    def _more(self) -> bool:
        if self.inflate.eof:
            self.packed, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
        data = self.packed or self.stream.read(CHUNK)
        if not data:
            return False
        self.plain += self.inflate.decompress(data, CHUNK)
        self.packed = self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with a mark; empty at the end of the file."""
        seen = 0
        while (at := self.plain.find(mark, seen)) < 0:
            seen = max(0, len(self.plain) - len(mark))
            if not self._more():
                if self.plain.strip():
                    raise ValueError("a record's header is cut off")
                return b""
        taken = bytes(self.plain[: at + len(mark)])
        del self.plain[: at + len(mark)]
        return taken

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes, a chunk at a time."""
        while n:
            if not self.plain and not self._more():
                raise ValueError("a record's block is cut off")
            taken = bytes(self.plain[: min(n, CHUNK)])
            del self.plain[: len(taken)]
            n -= len(taken)
            if taken:
                yield taken


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    pairs = (line.partition(":") for line in lines if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def normalise_file(source, target, level: int = 6) -> Iterator[dict]:
    """Copies the records of one gzip file to a stream, each as its own member; gives an index entry per record."""
    plain, offset = _Inflated(source), 0
    while head := plain.until(b"\r\n\r\n"):
        head = head.lstrip(b"\r\n")  # blank lines between records
        if not head:
            continue
        fields = _fields(head)
        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
        length = target.write(squeeze.compress(head)) or 0
        written = [length]
        for piece in plain.pieces(int(fields["content-length"])):
            written.append(target.write(squeeze.compress(piece)) or 0)
        written.append(target.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush()) or 0)
        length = sum(written)
        yield {"offset": offset, "length": length, "record_id": fields.get("warc-record-id"), "type": fields.get("warc-type")}
        offset += length


def normalise(files: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Normalises the archives of a table with a column file; returns the index of all records.

    Reads folder/archives; writes folder/members and, per archive, folder/index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                own = f"{base}/work/{name}.{TaskContext.get().taskAttemptId()}"
                with (
                    system.open_input_stream(f"{base}/archives/{name}", compression=None) as source,
                    system.open_output_stream(f"{own}.members", compression=None) as target,
                    system.open_output_stream(f"{own}.index", compression=None) as index,
                ):
                    count = 0
                    for entry in normalise_file(source, target, level):
                        index.write(json.dumps({"file": name} | entry).encode() + b"\n")
                        count += 1
                _finish(system, f"{own}.members", f"{base}/members/{name}")
                _finish(system, f"{own}.index", f"{base}/index/{name.removesuffix('.gz')}.json")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["file", "n_records"])

    _folders(folder, "work", "members", "index")
    spark = files.sparkSession
    spread = files.select("file").repartition(max(1, files.count()), "file")
    spread.mapInArrow(run, "file string, n_records long").write.parquet(f"{folder}/normalised")
    return spark.read.schema(_INDEX).json(f"{folder}/index")


def parse_record(plain: bytes) -> dict:
    """Fields of one record; the payload of a revisit is NULL, its size and digest are those stated."""
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = _fields(head + b"\r\n")
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["warc-payload-digest"].partition(":")[2]
    revisit = fields["warc-type"] == "revisit"
    if not revisit and digest_of(payload) != stated:
        raise ValueError(f"payload of {fields['warc-record-id']} has another digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("x-page-id"),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": int(_fields(http + b"\r\n")["content-length"]) if revisit else len(payload),
        "payload_digest": stated if revisit else digest_of(payload),
        "record_type": fields["warc-type"],
        "refers_to": number("x-refers-to-page"),
        "payload": None if revisit else payload,
    }


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records an index names, each read by its offset and checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        name, source = None, None
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        )
        for batch in batches:
            made, held = [], 0
            for row in batch.to_pylist():
                if row["file"] != name:
                    if source is not None:
                        source.close()
                    name, source = row["file"], system.open_input_file(f"{base}/members/{row['file']}")
                made.append(parse_record(zlib.decompress(source.read_at(row["length"], row["offset"]), 31)))
                held += len(made[-1]["payload"] or b"")
                if held > 16 * CHUNK:
                    yield pa.RecordBatch.from_pylist(made, schema)
                    made, held = [], 0
            yield pa.RecordBatch.from_pylist(made, schema)
        if source is not None:
            source.close()

    parts = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] // READ_BYTES
    parts = max(int(parts), index.sparkSession.sparkContext.defaultParallelism)
    stretch = F.floor(F.col("offset") / (4 * CHUNK))
    ordered = index.withColumn("stretch", stretch).repartition(parts, "file", "stretch").sortWithinPartitions("file", "offset")
    return ordered.select("file", "offset", "length").mapInArrow(run, _RECORD)
