"""Operator 1: WARC archives, written by tasks and read by a Python data source.

Every record is a gzip member of its own with its length in the header ("sl" extra field), so the
reader inflates the WARC header of a record first, applies the pushed predicates to it, and skips to
the next member without inflating an unwanted payload. Archives are closed at ARCHIVE_BYTES; a read
partition is a list of archives of about SPLIT_BYTES. An archive has its task's attempt in its name, and
a table beside the archives (MANIFEST), which Spark commits, has those of the attempts that succeeded: the
reader takes these only, so a task that runs again, in another order of rows, leaves no record twice. A
folder without that table is read whole.

Of records with equal payloads the one with the largest page_id is written as response and the
others as revisit; of rows with that page_id the one with the largest url is the response, and of equal
ones any.

Defined results: null html is an empty payload; a null url leaves out the target URI; null page_ids
count as the smallest; an empty table gives no archives and an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith
from pyspark.sql.types import StructType

from netloom.llm.shared import fresh_path

ARCHIVE_BYTES, SPLIT_BYTES, LEVEL = 64 << 20, 64 << 20, 3
#: Inflated first from every record; more only if its header is longer.
HEADER_BYTES = 1024
#: The table of the archives that count.
MANIFEST = "manifest"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "record_type string, record_id string, target_uri string, page_id long, refers_to long, "
    "payload_digest string, payload_bytes long, payload binary"
)
#: Columns that come from the header, so that predicates on them can be pushed down.
HEADER_COLUMNS = ("record_type", "record_id", "target_uri", "page_id", "refers_to", "payload_digest")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """An uncompressed WARC record; length and digest are the payload's, which a revisit doesn't hold."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_urn(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    fields += [("WARC-Target-URI", _clean(url))] if url is not None else []
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    fields += [("X-Page-ID", str(page_id))] if page_id is not None else []
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_urn(refers_to)), ("X-Payload-Length", str(length))]
        fields += [("X-Refers-To-Page-ID", str(refers_to))] if refers_to is not None else []
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """data as a gzip member that tells its own length."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    if size >= 1 << 32 or len(data) >= 1 << 32:
        raise ValueError("a record of 4 GB or more")
    lengths = size.to_bytes(4, "little") + len(data).to_bytes(4, "little")
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + (12).to_bytes(2, "little") + b"sl" + (8).to_bytes(2, "little") + lengths
    return head + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, html (of responses only), sha1, size, refers_to, revisit: a row a record.

    Responses are one row a payload, which is all that moves html, once and without its copies. Revisits come
    from keys: equal rows are counted before they move, the one that is the response is taken off, and they
    are joined with one row a payload, a join that adaptive execution can split where a payload is common.
    """
    content = F.coalesce(F.encode("html", "utf-8"), F.lit(b""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(content).alias("sha1"), F.octet_length(content).alias("size"))
    # the largest page_id, then the largest url; a null is the smallest
    place = F.struct(F.col("page_id").isNotNull().alias("has_id"), F.col("page_id"), F.col("url").isNotNull().alias("has_url"), F.col("url"))
    first = keyed.groupBy("sha1", "size").agg(F.max(place).alias("place"), F.max_by("html", place).alias("html"))
    responses = first.select("place.page_id", "place.url", "html", "sha1", "size", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))

    counted = keyed.groupBy("sha1", "size", "page_id", "url").agg(F.count("*").alias("n"))
    groups = counted.groupBy("sha1", "size").agg(F.max(place).alias("place"), F.sum("n").alias("rows")).filter("rows > 1").drop("rows")
    taken = (F.col("page_id").eqNullSafe(F.col("place.page_id")) & F.col("url").eqNullSafe(F.col("place.url"))).cast("long")
    others = counted.join(groups, ["sha1", "size"]).withColumn("n", F.col("n") - taken).filter("n > 0")
    revisits = others.select(
        "page_id", "url", F.lit(None).cast("string").alias("html"), "sha1", "size", F.col("place.page_id").alias("refers_to"), F.explode(F.array_repeat(F.lit(True), F.col("n").cast("int"))).alias("revisit")
    )
    return responses.unionByName(revisits)


def write_archives(pages: DataFrame, path: str) -> int:
    """Writes a record for every page under `path`; how many records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        task, out, name = TaskContext.get(), None, ""
        done: list[tuple[str, int, int]] = []
        size = rows = 0

        def close() -> None:
            out.close()
            done.append((name, size, rows))

        for batch in batches:
            for page_id, url, html, sha1, size_, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out, size, rows = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = member(record(page_id, url, (html or "").encode(), size_, base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to, revisit))
                out.write(data)
                size, rows = size + len(data), rows + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        columns = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["archive", "bytes", "records"])

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    manifest = f"{path}/{MANIFEST}"
    marked(pages).mapInArrow(write, "archive string, bytes long, records long").write.parquet(manifest)
    return pages.sparkSession.read.parquet(manifest).agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]


class Archives(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.wanted.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        manifest = [x.path for x in store.get_file_info(fs.FileSelector(f"{root}/{MANIFEST}", allow_not_found=True)) if x.path.endswith(".parquet")]
        if manifest:
            tables = [pq.read_table(name, columns=["archive", "bytes"], filesystem=store) for name in manifest]
            found = sorted((f"{root}/{name}", size) for t in tables for name, size in zip(*(c.to_pylist() for c in t.columns)))
        else:
            found = sorted((x.path, x.size) for x in store.get_file_info(fs.FileSelector(root)) if x.is_file)
        parts, held, size = [], [], 0
        for name, own in found:
            if held and size + own > SPLIT_BYTES:
                parts.append(Archives(held))
                held, size = [], 0
            held.append(name)
            size += own
        return [*parts, Archives(held)] if held or not parts else parts

    def accepts(self, head: dict) -> bool:
        for f in self.wanted:
            value = head[f.attribute[0]]
            if value is None:
                return False
            if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value or isinstance(f, StringStartsWith) and not value.startswith(f.value):
                return False
        return True

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for name in partition.files:
            with store.open_input_file(name) as file:
                for row in self.records(file):
                    rows.append(row)
                    held += len(row[-1] or b"") + 200
                    if held > 4 << 20:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def records(self, file) -> Iterator[tuple]:
        """Rows of the records of an archive that the pushed predicates accept."""
        at, end = 0, file.size()
        while at < end:
            file.seek(at)
            first = file.read(24 + HEADER_BYTES)
            size = int.from_bytes(first[16:20], "little") if first[:4] == b"\x1f\x8b\x08\x04" and first[12:14] == b"sl" else None
            inflate, more = zlib.decompressobj(31), len(first)

            def until_blank(data: bytes, got: bytes = b"") -> bytes:
                """Inflates, at most HEADER_BYTES at a time, until data has a blank line or ends."""
                nonlocal more
                while True:
                    data += inflate.decompress(got, HEADER_BYTES)
                    if b"\r\n\r\n" in data or inflate.eof:
                        return data
                    got = inflate.unconsumed_tail
                    if not got:
                        got = file.read(HEADER_BYTES)
                        more += len(got)
                        if not got:
                            raise ValueError("an archive that ends within a record")

            head, _, block = until_blank(b"", first).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            digest = fields.get("WARC-Payload-Digest", "")
            number = lambda k: int(fields[k]) if k in fields else None
            row = {
                "record_type": fields.get("WARC-Type"),
                "record_id": fields.get("WARC-Record-ID"),
                "target_uri": fields.get("WARC-Target-URI"),
                "page_id": number("X-Page-ID"),
                "refers_to": number("X-Refers-To-Page-ID"),
                "payload_digest": digest.removeprefix("sha1:") or None,
            }
            wanted = self.accepts(row)
            whole = wanted and row["record_type"] == "response" and (self.payload or self.verify)
            if whole or size is None:
                rest = file.read(size - more) if size is not None and size > more else b""
                block += inflate.decompress(inflate.unconsumed_tail + rest)
                while not inflate.eof:  # a member that doesn't tell its length
                    got = file.read(1 << 16)
                    if not got:
                        raise ValueError("an archive that ends within a record")
                    block, more = block + inflate.decompress(got), more + len(got)
                if size is None:
                    size = more - len(inflate.unused_data)
            at += size
            if not wanted:
                continue
            length, payload = number("X-Payload-Length"), None
            if whole:
                block = block[: int(fields["Content-Length"])]
                payload = block.partition(b"\r\n\r\n")[2]
                length = len(payload)
                if self.verify:
                    row["payload_digest"] = digest_of(payload)
                    if f"sha1:{row['payload_digest']}" != digest:
                        raise ValueError(f"the payload of {row['record_id']} doesn't have its digest")
            elif row["record_type"] == "response":
                block = until_blank(block, inflate.unconsumed_tail) if b"\r\n\r\n" not in block and not inflate.eof else block
                http = int(m[1]) if (m := re.search(rb"Content-Length: (\d+)", block)) else None
                length = http
            yield (*row.values(), length, payload if self.payload else None)


class WarcSource(DataSource):
    """spark.read.format("warc"). Options: path; payload (false: not returned); verify (true: digests of payloads are computed and compared)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)


def read_archives(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload)).option("verify", str(verify)).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of pages in the shared folder, read back with their payloads verified."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, payload=False, verify=True)
