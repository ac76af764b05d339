"""WARC archives as a Python data source, with identical-payload revisits.

Writing: one gzip member per record. Its header carries the member's length (the `sl` extra field), so a reader can jump
over it. Tasks write files of bounded size under names of their own; only files of committed tasks enter the manifest
that readers plan by, so retried and lost tasks leave nothing visible. Reading: files are packed into partitions by
size; a record's headers are parsed first, pushed-down predicates are tried on them, and a payload that is not wanted is
neither inflated nor read. Archives written elsewhere are read as well, plain or gzip; without a manifest all *.warc and
*.warc.gz files of the folder count.

Nulls and odd cases: a null payload is written as an empty one, a null header value is left out and read back as null.
Control characters in header values are percent-encoded. For `archive`: a null html is an empty payload; a null page_id
is larger than any other, so such a row revisits the row with an id if there is one, and else stays a response; rows
with the same page_id and payload have the same type. An empty table gives an empty archive; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from veilwright.sources.scratch import written

#: Column -> header.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, payload binary, file string, file_offset long"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"
#: Bytes after which a task begins another file, and bytes of files that one read task takes.
FILE_BYTES = PARTITION_BYTES = 128 << 20
#: Bytes of payload after which a read task hands on its rows.
BATCH_BYTES = 8 << 20
HEAD_BYTES = 4096


#: Schemes of Hadoop's connectors, as Arrow names them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def arrow_uri(uri: str) -> str:
    """A Hadoop path as Arrow's file systems read it; a path without a scheme stays one."""
    if "://" not in uri:
        return "file://" + uri[5:] if uri.startswith("file:") else uri
    scheme, rest = uri.split("://", 1)
    if scheme in ("wasb", "wasbs"):
        rest = rest.replace(".blob.core.", ".dfs.core.", 1)
    return f"{SCHEMES.get(scheme, scheme)}://{rest}"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = arrow_uri(uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


# --- records -------------------------------------------------------------------------------


def record_bytes(headers: dict[str, str], payload: bytes) -> bytes:
    lines = [f"{k}: {''.join(c if c >= ' ' else f'%{ord(c):02X}' for c in v)}" for k, v in headers.items()]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(payload)}", "", ""])
    return head.encode() + payload + b"\r\n\r\n"


def member(record: bytes, level: int = 2) -> bytes:
    """One gzip member whose header tells the length of its data (RFC 1952, extra field `sl`)."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = packer.compress(record) + packer.flush()
    told = (len(data), len(record)) if max(len(data), len(record)) < 1 << 32 else (0, 0)
    extra = b"sl" + struct.pack("<HII", 8, *told)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + data
            + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF))


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
    pairs = (line.split(":", 1) for line in lines[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    payload: bytes | None


def read_records(source: pa.NativeFile, wanted) -> Iterator[Record]:
    """Records of one file; `wanted(headers)` tells None (leave out), False (headers only) or True (payload too)."""
    size, at = source.size(), 0
    source.seek(0)
    zipped = source.read(2) == b"\x1f\x8b"
    while at < size:
        source.seek(at)
        record, at = (_zipped if zipped else _plain)(source, at, wanted)
        if record is not None:
            yield record


def _plain(source: pa.NativeFile, at: int, wanted) -> tuple[Record | None, int]:
    head = b""
    while (end := head.find(b"\r\n\r\n")) < 0:
        more = source.read(HEAD_BYTES)
        if not more:
            raise ValueError("the file ends inside a record's headers")
        head += more
    headers = parse_headers(head[:end])
    length, begin = int(headers.get("content-length", 0)), at + end + 4
    want = wanted(headers)
    payload = None
    if want:
        source.seek(begin)
        payload = source.read(length)
    return (None if want is None else Record(at, headers, payload)), begin + length + 4


def _zipped(source: pa.NativeFile, at: int, wanted) -> tuple[Record | None, int]:
    head = source.read(HEAD_BYTES)
    skip = _told_length(head)
    inflate, raw, plain = zlib.decompressobj(31), len(head), b""
    pending = head
    while (end := plain.find(b"\r\n\r\n")) < 0:
        plain += inflate.decompress(pending, HEAD_BYTES)
        pending = inflate.unconsumed_tail
        if not pending and not inflate.eof and plain.find(b"\r\n\r\n") < 0:
            pending = source.read(HEAD_BYTES)
            raw += len(pending)
            if not pending:
                raise ValueError("the file ends inside a record's headers")
        elif inflate.eof and plain.find(b"\r\n\r\n") < 0:
            raise ValueError("a gzip member without a whole record")
    headers = parse_headers(plain[:end])
    want = wanted(headers)
    length = int(headers.get("content-length", 0))
    if not want and skip:
        return (None if want is None else Record(at, headers, None)), at + skip
    parts = [plain[end + 4:]]
    while not inflate.eof:
        if not pending:
            pending = source.read(1 << 16)
            raw += len(pending)
            if not pending:
                raise ValueError("the file ends inside a record")
        part = inflate.decompress(pending)
        pending = b""
        if want:
            parts.append(part)
    payload = b"".join(parts)[:length] if want else None
    return (None if want is None else Record(at, headers, payload)), at + raw - len(inflate.unused_data)


def _told_length(head: bytes) -> int:
    """Bytes of a whole gzip member, if its header tells, else 0."""
    if len(head) < 24 or not head[3] & 4:
        return 0
    if head[12:16] != b"sl\x08\0" or head[3] != 4 or struct.unpack_from("<H", head, 10)[0] != 12:
        return 0
    data = struct.unpack_from("<I", head, 16)[0]
    return 24 + data + 8 if data else 0


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- data source ---------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    names: list[str] = field(default_factory=list)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcSource(DataSource):
    """Options: path (a folder or file), payload ("false": headers only), verify ("false": trust payload digests)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options)


def _test(test: Filter):
    """A predicate over headers that does exactly what `test` does, or None."""
    if isinstance(test, Not):
        inner = _test(test.child)
        # NOT over a null is null, so the row must have the header, unless the inner test is total.
        if inner is None:
            return None
        if isinstance(test.child, (IsNull, IsNotNull, EqualNullSafe)):
            return lambda h: not inner(h)
        name = HEADERS[test.child.attribute[0]].lower()
        return lambda h: name in h and not inner(h)
    attribute = getattr(test, "attribute", ())
    if len(attribute) != 1 or attribute[0] not in HEADERS:
        return None
    name, value = HEADERS[attribute[0]].lower(), getattr(test, "value", None)
    if isinstance(test, (EqualTo, EqualNullSafe)):
        if value is None:
            return (lambda h: name not in h) if isinstance(test, EqualNullSafe) else (lambda h: False)
        return lambda h: h.get(name) == value
    if isinstance(test, In):
        if None in test.value:
            return None
        return lambda h: h.get(name) in test.value
    if isinstance(test, IsNull):
        return lambda h: name not in h
    if isinstance(test, IsNotNull):
        return lambda h: name in h
    if isinstance(test, StringStartsWith):
        return lambda h: h.get(name, "").startswith(value) and name in h
    if isinstance(test, StringEndsWith):
        return lambda h: h.get(name, "").endswith(value) and name in h
    if isinstance(test, StringContains):
        return lambda h: name in h and value in h[name]
    return None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.verify = options.get("verify", "true") == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            if _test(test) is None:
                yield test
            else:
                self.filters.append(test)

    def partitions(self) -> list[Files]:
        system, path = file_system(self.path)
        info = system.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(path))
        manifests = [i for i in found if i.base_name.endswith(MANIFEST)]
        listed = {n for m in manifests for n in json.loads(system.open_input_stream(m.path).read())}
        files = [i for i in found if i.is_file and i.base_name.endswith((".warc", ".warc.gz"))
                 and (not manifests or i.base_name in listed)]
        parts, room = [], 0
        for i in sorted(files, key=lambda i: (-i.size, i.path)):
            if not i.size:
                continue
            if not parts or room < i.size:
                parts.append(Files())
                room = PARTITION_BYTES
            parts[-1].names.append(i.path)
            room -= i.size
        return parts or [Files()]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        tests = [_test(f) for f in self.filters]

        def wanted(headers: dict[str, str]) -> bool | None:
            return self.payload if all(t(headers) for t in tests) else None

        kinds = [pa.string()] * len(HEADERS) + [pa.int64(), pa.binary(), pa.string(), pa.int64()]
        names = [*HEADERS, "content_length", "payload", "file", "file_offset"]
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for name in partition.names:
            with system.open_input_file(name) as source:
                for r in read_records(source, wanted):
                    told = r.headers.get("warc-payload-digest")
                    if self.verify and r.payload is not None and told and r.headers.get("warc-type") != "revisit" and told != digest(r.payload):
                        raise ValueError(f"the record at {name}:{r.offset} does not match its digest")
                    rows.append((*[r.headers.get(h.lower()) for h in HEADERS.values()],
                                 int(r.headers.get("content-length", 0)), r.payload, name, r.offset))
                    size += len(r.payload or b"") + 500
                    if size > BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    """Writes columns named as in `HEADERS`, and payload."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
                for i in range(batch.num_rows):
                    headers = {h: v for c, h in HEADERS.items() if c in columns and (v := columns[c][i].as_py()) is not None}
                    if headers.get("WARC-Type") == "revisit":
                        headers["WARC-Profile"] = REVISIT
                    if out is None or size > FILE_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                    data = member(record_bytes(headers, columns["payload"][i].as_py() or b""))
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{uuid.uuid4().hex}{MANIFEST}") as out:
            out.write(json.dumps([n for m in messages if m is not None for n in m.names]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, path = file_system(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            system.delete_file(f"{path}/{name}")


# --- operators -----------------------------------------------------------------------------


def register(spark: SparkSession) -> None:
    """Make the source known. It travels by value: planning processes need not be able to import this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(WarcSource)


def write_archive(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of an archive. Turns on the session's filter push-down into Python data sources."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """A WARC record per page. Of equal payloads of at least `least` bytes only the smallest page_id's is stored.

    Payloads meet by SHA-1; the group's smallest id is found with a map-side minimum. Those are stored first, so a large
    group is an ordinary skewed join of two plain shuffles, which Spark splits.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    each = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"))
    hashed = each.select("*", F.sha1("payload").alias("hash"), F.octet_length("payload").cast("long").alias("n"))
    first = hashed.where(F.col("n") >= least).groupBy(F.col("hash").alias("known_hash")).agg(F.min("page_id").alias("first"), F.lit(True).alias("known"))
    first = written(first, "first_pages")
    # As a left join on the hash alone; short payloads find no partner.
    joined = hashed.join(first, (F.col("hash") == F.col("known_hash")) & (F.col("n") >= least), "left")
    revisit = F.coalesce(F.col("known"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"),
        F.lit("1970-01-01T00:00:00Z").alias("date"), F.col("url").alias("target_uri"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.concat(F.lit("sha1:"), base32(F.col("hash"))).alias("payload_digest"),
        F.when(revisit, urn("first")).alias("refers_to"), F.col("n").cast("string").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def base32(hexadecimal):
    """RFC 4648 base 32 of 40 hexadecimal digits: five of them are four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for k in range(8):
        five = F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, F.shiftright(five, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def page_results(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of archived pages."""
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:x-page:(-?[0-9]+)>$', 1), '') as bigint)")
    length = F.when(F.col("record_type") == "revisit", F.col("payload_length").cast("long")).otherwise(F.octet_length("payload").cast("long"))
    return records.select(number("record_id").alias("page_id"), length.alias("payload_bytes"),
                          F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type",
                          F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"))
