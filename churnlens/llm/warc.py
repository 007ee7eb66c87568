"""WARC archives: a Spark data source that reads them, and a writer with revisit records.

Archives hold one gzip member per record. The member's header has the ``sl`` extra field of the
WARC specification's gzip annex (compressed and uncompressed length of the member), so that a
reader that has parsed a record's headers and does not want its payload goes on to the next
member without decoding the rest; members without the field, and plain archives, are read too.

``spark.read.format("warc").load(folder)`` plans one partition per group of files, about equal in
bytes. Filters on ``record_type`` and on header columns are taken over by the source and tested on the
parsed headers, before any payload is decoded; the payload is not decoded either when the
``payload`` option is ``none`` (then it is null), or for revisit records, which have none.

``write_warc`` writes each row as a response record with its payload or, where an equal payload
of at least ``min_revisit`` bytes is in a row with a larger id, as a revisit of the largest one.

Defined cases: a null payload is empty, a null id or URL has an empty header; rows that tie at the
largest id are all responses; an empty table gives an empty folder and no record; header values
are percent-encoded outside printable ASCII; other columns are not written.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, LessThan, LessThanOrEqual)

from churnlens.llm import text as tx
from churnlens.llm.registry import query, small_batches, table
from churnlens.llm.storage import NewFile, file_system, new_folder

MIN_REVISIT = 1000
#: Bytes of archives that one partition is planned for; a larger file is a partition of its own.
PARTITION_BYTES = 64 << 20
_DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the format: response and revisit records and the profile of the latter.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- writing

def _member(record: bytes, level: int = 1) -> bytes:
    """A gzip member with the ``sl`` extra field."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(record) + c.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF))


def _headers(pairs: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs).encode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           revisit: bool) -> bytes:
    """One WARC/1.1 record; ``digest`` is the hex SHA-1 of the full payload, also for revisits."""
    http = "HTTP/1.1 200 OK\r\n" + "Content-Type: text/html; charset=utf-8\r\n"
    http = http.encode() + (b"\r\n" if revisit else f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload)
    ident = "" if page_id is None else str(page_id)
    head = [("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<urn:page:{ident}>"), ("WARC-Date", _DATE),
            ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~")),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
            ("WARC-Payload-Length", str(len(payload)))]
    if revisit:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", _PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http)))]
    return b"WARC/1.1\r\n" + _headers(head) + b"\r\n" + http + b"\r\n\r\n"


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               min_revisit: int = MIN_REVISIT, file_bytes: int = PARTITION_BYTES) -> int:
    """Write the rows as archives below ``folder``; the number of files. A task begins a new file after
    ``file_bytes``, so that a file is one partition of a later read."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                      F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    # Digests of several rows only: a hot payload is one row a task here.
    last = (pages.filter(F.length("payload") >= min_revisit).groupBy("digest")
            .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("digest", "last"))
    # A plain join: AQE splits the partitions of a hot payload.
    pages = pages.join(last, "digest", "left").withColumn(
        "revisit", F.coalesce(F.col("page_id") < F.col("last"), F.col("last").isNotNull() & F.col("page_id").isNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, files = None, 0
        for whole in batches:
            for b in tx.slices(whole, "payload"):
                for r in b.to_pylist():
                    if out is not None and out.size >= file_bytes:
                        out.close()
                        out = None
                    if out is None:
                        out = NewFile(f"{folder}/part-{TaskContext.get().partitionId():06d}-{files:06d}.warc.gz")
                        files += 1
                    out.write(_member(record(r["page_id"], r["url"], r["payload"], r["digest"], r["last"], r["revisit"])))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    written = small_batches(pages).mapInArrow(run, "files long")
    return int(written.agg(F.sum("files")).first()[0] or 0)


# ---------------------------------------------------------------- reading

class _Member:
    """A record at a position of an archive: headers now, payload on demand, then the next position."""

    FIRST = 4096

    def __init__(self, f: pa.NativeFile, at: int, size: int):
        self.f, self.at, self.size = f, at, size
        raw = f.read_at(min(self.FIRST, size - at), at)
        self.zipped = raw[:2] == b"\x1f\x8b"
        self.raw, self.read, self.length = raw, len(raw), None
        self.plain = b""
        if self.zipped:
            start = self._gzip_header()
            self.z = zlib.decompressobj(-15)
            self.plain = self.z.decompress(raw[start:], self.FIRST)
        else:
            self.plain = raw
        while b"\r\n\r\n" not in self.plain and self._more():
            pass
        head, _, _ = self.plain.partition(b"\r\n\r\n")
        self.body = len(head) + 4
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        self.headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        self.content = int(self.headers.get("content-length", 0))

    def _gzip_header(self) -> int:
        raw, flags, at = self.raw, self.raw[3], 10
        if flags & 4:
            n = struct.unpack_from("<H", raw, at)[0]
            at += 2
            stop = at + n
            while at + 4 <= stop:
                name, size = raw[at:at + 2], struct.unpack_from("<H", raw, at + 2)[0]
                if name == b"sl" and size == 8:
                    self.length = struct.unpack_from("<I", raw, at + 4)[0]
                at += 4 + size
            at = stop
        for bit in (8, 16):
            if flags & bit:
                at = raw.index(b"\0", at) + 1
        return at + 2 * bool(flags & 2)

    def _more(self, want: int = 1 << 18) -> bool:
        """Read or inflate some more of the record; false at the end of its member or of the file."""
        if not self.zipped:
            got = self.f.read_at(min(want, self.size - self.at - self.read), self.at + self.read)
            self.read += len(got)
            self.plain += got
            return bool(got)
        if self.z.eof:
            return False
        src = self.z.unconsumed_tail
        if not src:
            src = self.f.read_at(min(want, self.size - self.at - self.read), self.at + self.read)
            self.read += len(src)
            if not src:
                raise ValueError(f"truncated gzip member at byte {self.at}")
        self.plain += self.z.decompress(src, want)
        return True

    def payload(self) -> bytes:
        while len(self.plain) < self.body + self.content and self._more(max(1 << 18, self.content)):
            pass
        block = self.plain[self.body:self.body + self.content]
        if "msgtype=response" in self.headers.get("content-type", ""):
            return block.partition(b"\r\n\r\n")[2]
        return block

    def next_position(self) -> int:
        if not self.zipped:
            return self.at + self.body + self.content + 4
        if self.length:
            return self.at + self.length
        while self._more():     # no length field: decode to the member's end, keep nothing
            self.plain = b""
        return self.at + self.read - len(self.z.unused_data) + 8     # the trailer's 8 bytes



#: Columns of the source: name, SQL type, WARC header.
_COLUMNS = {"record_type": ("string", "warc-type"), "record_id": ("string", "warc-record-id"),
            "target_uri": ("string", "warc-target-uri"), "warc_date": ("string", "warc-date"),
            "content_length": ("bigint", "content-length"), "payload_length": ("bigint", "warc-payload-length"),
            "payload_digest": ("string", "warc-payload-digest"), "refers_to": ("string", "warc-refers-to")}


def _value(headers: dict[str, str], column: str):
    kind, name = _COLUMNS[column]
    v = headers.get(name)
    if v is None:
        return None
    if kind == "bigint":
        return int(v)
    if column == "target_uri":
        return unquote(v)
    if column == "payload_digest" and v.lower().startswith("sha1:"):
        v = v[5:]
        return base64.b32decode(v).hex() if len(v) == 32 else v.lower()
    return v[1:-1] if v[:1] == "<" and v[-1:] == ">" else v


_TESTS = {EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x,
          GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x}


class WarcPartition(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(0)
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns, self.options = [f.name for f in schema.fields], options
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Take over comparisons of header columns; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _COLUMNS and (type(f) in _TESTS or isinstance(f, IsNotNull)):
                self.tests.append((type(f), column, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[WarcPartition]:
        scheme = self.options["path"]
        fs, path = file_system(scheme)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True)) if fs.get_file_info(path).type == \
            pafs.FileType.Directory else [fs.get_file_info(path)]
        files = sorted((f.path, f.size) for f in found
                       if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz")))
        head = scheme[:scheme.index(path)] if path in scheme else ""
        limit = int(self.options.get("partitionbytes", PARTITION_BYTES))
        out: list[list[str]] = []     # an empty folder is one empty partition
        room = 0
        for name, size in files:
            if not out or size > room:
                out.append([])
                room = limit
            out[-1].append(head + name)
            room -= size
        return [WarcPartition(x) for x in out or [[]]]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for kind, column, x in self.tests:
            v = _value(headers, column)
            if v is None or (kind in _TESTS and not _TESTS[kind](v, x)):
                return False
        return True

    def read(self, partition: WarcPartition) -> Iterator[pa.RecordBatch]:
        decode = self.options.get("payload", "all") != "none" and "payload" in self.columns
        types = pa.schema([(c, pa.binary() if c == "payload" else pa.int64() if _COLUMNS[c][0] == "bigint" else pa.string())
                           for c in self.columns])
        rows: list[dict] = []
        held = 0
        for name in partition.files:
            fs, path = file_system(name)
            with fs.open_input_file(path) as f:
                at, size = 0, f.size()
                while at < size:
                    m = _Member(f, at, size)
                    if self._wanted(m.headers):
                        row = {c: _value(m.headers, c) for c in self.columns if c != "payload"}
                        if decode and row.get("record_type", m.headers.get("warc-type")) != "revisit":
                            row["payload"] = m.payload()
                            held += len(row["payload"])
                        rows.append(row)
                        if len(rows) >= 1000 or held >= tx.BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows, held = [], 0
                    at = m.next_position()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, types)


class WarcDataSource(DataSource):
    """Options: path; payload = all | none; partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return ", ".join(f"{c} {k}" for c, (k, _) in _COLUMNS.items()) + ", payload binary"

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, {k.lower(): v for k, v in self.options.items()})


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of all archives below ``folder``; filters on header columns reach the source."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", "all" if payload else "none").load(folder)


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """Page records read back: response digests and lengths from the payload, revisits' from their headers."""
    page = F.regexp_extract("record_id", "^urn:page:([0-9-]+)$", 1).try_cast("long")
    to = F.regexp_extract("refers_to", "^urn:page:([0-9-]+)$", 1).try_cast("long")
    full = read_warc(spark, folder).filter(F.col("record_type") == "response").select(
        page.alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    # No payload column is asked for: only headers are decoded.
    again = read_warc(spark, folder, payload=False).filter(F.col("record_type") == "revisit").select(
        page.alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type",
        to.alias("refers_to"))
    return full.unionByName(again)


_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT html, max(page_id) AS last, count(*) AS n FROM p WHERE strlen(html) >= {MIN_REVISIT} GROUP BY html)
SELECT page_id, strlen(p.html) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN m ON p.html = m.html
"""


@query("op4_warc", _SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    folder = new_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return page_records(spark, folder)
