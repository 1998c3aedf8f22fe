"""WARC archives: records as gzip members, and a splittable reader.

Writing: one record a page, each a gzip member of its own. Spark's text writer puts the members into the files as they are
and an empty member after each, so any gzip tool reads the archive and Spark's commit protocol covers lost tasks. Of pages
with equal payloads the one with the largest id holds it; the others are revisit records that refer to it.

Reading: each task scans its byte range for the gzip magic through Spark's splittable text source, whose record separator is
the magic; so a task owns the candidates that start in its range, and any store that Spark reads will do. A candidate is a
member if its header decodes and its content starts as a WARC record. Compressed data can hold the magic by chance: then the
candidates that follow are part of the open member and are joined to it until it ends. A member that is still open at the
end of a range and the parts that the next ranges could not place are few; they are joined in file order afterwards.

Defined results: a null payload is empty; null targets are left out; repeated rows each give a record; of several rows that
share the largest id all are responses; a null id counts as smallest. Empty tables give an archive without records. Other
columns are not archived, so their names can't clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramsieve.llm.common import salted_lookup
from gramsieve.places import remove, shared_dir
from gramsieve.shipping import ship

MAGIC = b"\x1f\x8b\x08"
_EMPTY = gzip.compress(b"", mtime=0)
_RECORD = "record_type string, record_id string, target string, refers_to string, payload_digest string, payload_bytes long, payload binary, path string"
_PART = "path string, start long, seq long, open boolean, data binary"


def revisits(pages: DataFrame, page_id: str, payload: str, least: int = 1000) -> DataFrame:
    """Adds ``__digest`` (hex SHA-1 of the payload), ``__bytes`` and ``__first``, the id of the response a revisit refers to."""
    x = pages.withColumn(payload, F.coalesce(F.col(payload).cast("binary"), F.lit(b"")))
    x = x.withColumns({"__digest": F.sha1(F.col(payload)), "__bytes": F.octet_length(payload).cast("long")})
    large = x.filter(F.col("__bytes") >= least).groupBy("__digest", "__bytes").agg(F.max(page_id).alias("__top"), F.count("*").alias("__n"))
    x = salted_lookup(x, large.filter("__n > 1").drop("__n"), ["__digest", "__bytes"], F.col(page_id))
    later = F.col("__top").isNotNull() & ~F.col("__top").eqNullSafe(F.col(page_id))
    return x.withColumn("__first", F.when(later, F.col("__top"))).drop("__top")


def _line(name: str, value) -> str:
    return f"{name}: {value}\r\n" if value is not None else ""


def _record(page, target, payload: bytes, digest: str, size: int, first, date: str) -> bytes:
    if first is None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        block, kind, media = http + payload, "response", "application/http; msgtype=response"
    else:
        block, kind, media = b"", "revisit", "application/http; msgtype=response"
    head = "WARC/1.1\r\n" + _line("WARC-Type", kind) + _line("WARC-Record-ID", f"<urn:page:{page}>") + _line("WARC-Date", date)
    head += _line("WARC-Target-URI", None if target is None else target.replace("\r", "%0D").replace("\n", "%0A"))
    head += _line("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()) + _line("X-Payload-Length", size)
    if first is not None:
        head += _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest") + _line("WARC-Refers-To", f"<urn:page:{first}>")
    head += _line("Content-Type", media) + _line("Content-Length", len(block))
    return gzip.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes one record a page to the folder ``path``; payloads of at least ``least`` bytes are written once."""
    ship(pages.sparkSession)
    x = revisits(pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), F.col(html).alias("payload")), "id", "payload", least)
    x = x.select(F.col("id").cast("string"), "url", F.when(F.col("__first").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "__digest", "__bytes", F.col("__first").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                rows = zip(*(c.to_pylist() for c in whole.slice(at, 256).columns), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([_record(*r, date) for r in rows], pa.binary())], names=["record"])

    out = x.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    out.write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY.decode("latin1")).text(path)


def _inflate(data: bytes) -> tuple[bytes, bool] | None:
    """The content of a member and whether it has ended; None if it doesn't decode or isn't the start of a WARC record."""
    z = zlib.decompressobj(31)
    try:
        out = z.decompress(data)
    except zlib.error:
        return None
    if out and not b"WARC/1.".startswith(out[:7]):
        return None
    return out, z.eof


def _parse(content: bytes, path: str) -> tuple:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", 0))]
    kind = fields.get("warc-type")
    payload = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
    digest, size = fields.get("warc-payload-digest", ""), fields.get("x-payload-length")
    digest = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
    if payload is not None:  # of what was read, not of what the header says
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    return kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, None if size is None else int(size), payload, path


class _Scan:
    """Joins the candidates of one byte range to members."""

    def __init__(self, path: str, start: int):
        self.path, self.start, self.seq, self.open, self.began = path, start, 0, None, False
        self.records: list[tuple] = []
        self.parts: list[tuple] = []

    def take(self, data: bytes) -> None:
        seq, self.seq = self.seq, self.seq + 1
        if seq == 0 and self.start == 0:
            if data:
                raise ValueError(f"{self.path}: does not start with a gzip member")
            return  # what stands before the first magic
        data = MAGIC + data
        if self.open is not None:
            data = self.open + data
        found = _inflate(data)
        if found is None:
            if self.open is not None or self.began:
                raise ValueError(f"{self.path}: damaged member in the range from byte {self.start}")
            self.parts.append((self.path, self.start, seq, False, data))  # belongs to a member that an earlier range began
            return
        self.began = True
        content, ended = found
        self.open = None if ended else data
        if ended and content:
            self.records.append(_parse(content, self.path))

    def close(self) -> None:
        if self.open is not None:
            self.parts.append((self.path, self.start, self.seq, True, self.open))


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kind]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
_ARROW = {s: pa.schema([(n, _KINDS[t]) for n, t in (c.split() for c in s.split(", "))]) for s in (_RECORD, _PART, f"{_RECORD}, {_PART.replace('path', 'part', 1)}")}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``: type, id, target, the id referred to, payload digest (hex), size and bytes."""
    ship(spark)
    both = f"{_RECORD}, {_PART.replace('path', 'part', 1)}"
    none = (None,) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, held = None, 0
        for batch in batches:
            for data, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if scan is None or (scan.path, scan.start) != (file, start):
                    if scan is not None:
                        scan.close()
                        yield _batch([(*r, *none[:5]) for r in scan.records] + [(*none, *p) for p in scan.parts], _ARROW[both])
                    scan, held = _Scan(file, start), 0
                scan.take(data)
                held += len(data)
                if held > 8 << 20 and scan.records:
                    yield _batch([(*r, *none[:5]) for r in scan.records], _ARROW[both])
                    scan.records, held = [], 0
        if scan is not None:
            scan.close()
            yield _batch([(*r, *none[:5]) for r in scan.records] + [(*none, *p) for p in scan.parts], _ARROW[both])

    def join(table: pa.Table) -> pa.Table:
        out, data = [], b""
        for file, _, _, begins, part in sorted(zip(*(c.to_pylist() for c in table.columns), strict=True), key=lambda r: r[1:3]):
            data = part if begins and not data else data + part
            found = _inflate(data)
            if found is None:
                raise ValueError(f"{file}: damaged member")
            if found[1]:
                out += [_parse(found[0], file)] if found[0] else []
                data = b""
        if data:
            raise ValueError(f"{table.column(0)[0]}: the last member does not end")
        return pa.Table.from_batches([_batch(out, _ARROW[_RECORD])])

    raw = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin1")).option("recursiveFileLookup", True).schema("value string").text(path)
    raw = raw.select(F.col("value").cast("binary"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    found = raw.mapInArrow(run, both)
    names = [c.split()[0] for c in _RECORD.split(", ")]
    parts = found.filter("part IS NOT NULL").select(F.col("part").alias("path"), "start", "seq", "open", "data")
    return found.filter("part IS NULL").select(*names).unionByName(parts.groupBy("path").applyInArrow(join, _RECORD))


def archive(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to a new folder of the shared one, which goes with the driver, and reads the records back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4()}"
    write(pages, path, **options)
    remove(spark, path, at_exit=True)
    return read(spark, path)
