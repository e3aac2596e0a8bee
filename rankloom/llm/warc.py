"""WARC archives as a PySpark data source, for reading and writing.

Reading: files are planned as partitions from a listing alone; a file with an offset index beside it (this module's own
writer leaves one) is divided into parts of `split_bytes`, and a part's task finds the records that start in it.  Filters on the record type, the target address and
every other header column are pushed down: headers are parsed first, and the block of a record that fails a filter is
skipped, undecoded.  Plain and gzip files (one member a record) are read.

Writing: every task writes one file of gzip members under a name of its own; the job commits by one list of the files
that count, and readers leave out files of a job that no list names, so a lost executor or a repeated task leaves no
record twice and nothing is renamed.

Paths go through pyarrow's file systems (file:, hdfs:, s3: ...), so they must be ones that all executors share.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from rankloom.llm import kernel
from rankloom.llm.graph import join_hot
from rankloom.session import saved, shared_dir, table

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, full_length long, content_length long, payload binary"
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "full_length": "WARC-Full-Payload-Length", "content_length": "Content-Length"}
NUMBERS = ("full_length", "content_length")
DATE = "2026-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES = 32 << 20
CHUNK = 1 << 16


#: Files of this module's writer, by job.
OWN_FILE = re.compile("/part-([0-9a-f]{32})-[0-9a-f]{32}\\.warc\\.gz$")


def _committed(system, folder: str, job: str) -> set[str]:
    """The files of a job that count: none before it has committed."""
    from pyarrow import fs

    name = f"{folder}/_files-{job}.json"
    if system.get_file_info(name).type == fs.FileType.NotFound:
        return set()
    with system.open_input_file(name) as listed:
        return set(json.loads(listed.read()))


def _open(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split("\n")).replace("\r", " ") if "\n" in value or "\r" in value else value


def record_bytes(fields: dict, payload: bytes) -> bytes:
    """One WARC record; fields by column name, null ones left out."""
    lines = ["WARC/1.1", f"WARC-Date: {DATE}"]
    lines += [f"{HEADERS[k]}: {_clean(str(v))}" for k, v in fields.items() if v is not None]
    if fields.get("record_type") == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += [f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int | None
    size: int | None

    def __init__(self, path: str, start: int, end: int | None, size: int | None = None):
        super().__init__(None)
        self.path, self.start, self.end, self.size = path, start, end, size  # a size: the file has an index


class _Bytes:
    """A reader over a plain or gzip (member after member) stream that can skip."""

    def __init__(self, raw, start: int, end: int | None):
        raw.seek(start)
        self.raw, self.left = raw, None if end is None else end - start
        self.ahead = self._more(2)
        self.zip = zlib.decompressobj(31) if self.ahead == b"\x1f\x8b" else None
        self.out, self.at = b"", 0

    def _more(self, n: int = CHUNK) -> bytes:
        n = n if self.left is None else min(n, self.left)
        found = self.raw.read(n) if n else b""
        if self.left is not None:
            self.left -= len(found)
        return found

    def _fill(self) -> bool:
        block, self.ahead = self.ahead or self._more(), b""
        if not block:
            return False
        parts = [self.out[self.at :]]
        if self.zip is None:
            parts.append(block)
        else:
            parts.append(self.zip.decompress(block))
            while self.zip.eof:
                rest, self.zip = self.zip.unused_data, zlib.decompressobj(31)
                parts.append(self.zip.decompress(rest))
                if not rest:
                    break
        self.out, self.at = b"".join(parts), 0
        return True

    def line(self) -> bytes | None:
        while (end := self.out.find(b"\n", self.at)) < 0:
            if not self._fill():
                rest, self.at = self.out[self.at :], len(self.out)
                return rest or None
        found, self.at = self.out[self.at : end].rstrip(b"\r"), end + 1
        return found

    def take(self, n: int, keep: bool) -> bytes:
        parts = []
        while True:
            part = self.out[self.at : self.at + n] if keep else b""
            got = min(n, len(self.out) - self.at)
            self.at += got
            n -= got
            if keep:
                parts.append(part)
            if not n:
                return b"".join(parts)
            if not keep and self.zip is None and not self.ahead:  # a plain file: step over the rest unread
                self.raw.seek(n, 1)
                if self.left is not None:
                    self.left -= n
                return b""
            if not self._fill():
                raise ValueError("a WARC record ends early")


def _parsed(lines: Iterator[bytes | None]) -> dict[str, str]:
    fields: dict[str, str] = {}
    last = None
    for line in lines:
        if line is None:
            raise ValueError("a WARC record ends early")
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and last:
            fields[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            fields[last := name.strip().lower()] = value.strip()
    return fields


def read_members(raw, offsets: list[int], end: int, wanted=lambda fields: True, payload: bool = True) -> Iterator[tuple[dict, bytes | None]]:
    """Like read_records(), of gzip members at known offsets: a member is inflated no further than its headers unless it is wanted."""
    for start, stop in zip(offsets, [*offsets[1:], end]):
        raw.seek(start)
        left, inflate, out = stop - start, zlib.decompressobj(31), b""
        block = b""
        while b"\r\n\r\n" not in out:
            if not block:
                block = raw.read(min(CHUNK, left))
                left -= len(block)
                if not block:
                    raise ValueError("a WARC record ends early")
            out += inflate.decompress(block, 2048)
            block = inflate.unconsumed_tail
        head, _, body = out.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {lines[0][:40]!r}")
        fields = _parsed(iter(lines[1:]))
        if not wanted(fields):
            continue
        if not payload:
            yield fields, None
            continue
        length, parts, got = int(fields.get("content-length", 0)), [body], len(body)
        while got < length:
            block = block or raw.read(min(CHUNK, left))
            if not block:
                raise ValueError("a WARC record ends early")
            left -= 0 if inflate.unconsumed_tail else len(block)
            parts.append(inflate.decompress(block))
            got += len(parts[-1])
            block = b""
        yield fields, b"".join(parts)[:length]


def read_records(raw, start: int = 0, end: int | None = None, wanted=lambda fields: True, payload: bool = True) -> Iterator[tuple[dict, bytes | None]]:
    """(header fields by lower-case name, block) of the records from start to end; blocks of unwanted records are skipped."""
    stream = _Bytes(raw, start, end)
    while True:
        line = stream.line()
        while line is not None and not line:
            line = stream.line()
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        fields = _parsed(iter(stream.line, b""))
        length = int(fields.get("content-length", 0))
        keep = wanted(fields)
        block = stream.take(length, keep and payload)
        if keep:
            yield fields, block if payload else None


def _value(fields: dict, column: str):
    found = fields.get(HEADERS[column].lower())
    return int(found) if found is not None and column in NUMBERS else found


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns, self.filters = options, columns, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In, IsNull, IsNotNull, StringStartsWith)):
                self.filters.append((type(f).__name__, column, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, fields: dict) -> bool:
        tests = {
            "EqualTo": lambda x, v: x is not None and x == v,
            "In": lambda x, v: x is not None and x in v,
            "IsNull": lambda x, _: x is None,
            "IsNotNull": lambda x, _: x is not None,
            "StringStartsWith": lambda x, v: x is not None and x.startswith(v),
        }
        return all(tests[kind](_value(fields, column), value) for kind, column, value in self.filters)

    def partitions(self):
        from pyarrow import fs

        system, path = _open(self.options["path"])
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else sorted(system.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda f: f.path)
        names = {f.path for f in files}
        most, parts, committed = int(self.options.get("split_bytes", SPLIT_BYTES)), [], {}
        for f in files:
            if not f.path.endswith((".warc", ".warc.gz")) or "/_" in f.path[len(path) :]:
                continue
            job = OWN_FILE.search(f.path)
            if job:
                if job[1] not in committed:
                    committed[job[1]] = _committed(system, f.path.rpartition("/")[0], job[1])
                if f.path.rpartition("/")[2] not in committed[job[1]]:
                    continue
            if f.path + ".idx" not in names:
                parts.append(Part(f.path, 0, None))
                continue
            parts += [Part(f.path, a, min(a + most, f.size), f.size) for a in range(0, f.size, most)]
        return parts or [Part("", 0, 0)]

    def read(self, part):
        if not part.path:
            return
        system, _ = _open(self.options["path"])
        payload = str(self.options.get("payload", "true")).lower() == "true"
        columns = [[] for _ in self.columns]
        types = [pa.int64() if c in NUMBERS else pa.binary() if c == "payload" else pa.string() for c in self.columns]
        size = 0
        with system.open_input_file(part.path) as raw:
            if part.size is None:
                found = read_records(raw, part.start, part.end, self.wanted, payload)
            else:
                with system.open_input_file(part.path + ".idx") as index:
                    offsets = np.frombuffer(index.read(), "<u8")
                a, b = np.searchsorted(offsets, [part.start, part.end])
                found = read_members(raw, offsets[a:b].tolist(), int(offsets[b]) if b < len(offsets) else part.size, self.wanted, payload)
            for fields, block in found:
                for name, column in zip(self.columns, columns):
                    column.append(block if name == "payload" else _value(fields, name))
                size += len(block or b"") + 500
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], self.columns)
                    columns, size = [[] for _ in self.columns], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], self.columns)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        name, offsets, at, out = f"part-{self.job}-{uuid.uuid4().hex}.warc.gz", [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                payload = row.pop("payload") or b""
                row.pop("content_length", None)
                member = gzip.compress(record_bytes(row, payload), 1, mtime=0)
                offsets.append(at)
                at += len(member)
                out.write(member)
        if out is None:
            return Written(None)
        out.close()
        with system.open_output_stream(f"{path}/{name}.idx", compression=None) as index:
            index.write(np.array(offsets, "<u8").tobytes())
        return Written(name)

    def commit(self, messages):
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        names = [m.name for m in messages if m is not None and m.name]
        with system.open_output_stream(f"{path}/_files-{self.job}.json", compression=None) as out:
            out.write(json.dumps(names).encode())
        self._remove(set(names))

    def abort(self, messages):
        self._remove(set())

    def _remove(self, kept: set[str]) -> None:
        """The job's files that don't count, of tasks that were repeated or lost."""
        from pyarrow import fs

        system, path = _open(self.path)
        if system.get_file_info(path).type == fs.FileType.Directory:
            for f in system.get_file_info(fs.FileSelector(path)):
                if f.base_name.startswith(f"part-{self.job}-") and f.base_name.removesuffix(".idx") not in kept:
                    system.delete_file(f.path)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options), schema.names)

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make format("warc") known, with filter pushdown."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records_of(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """The archive's rows for `pages` (page_id, url, html).

    Of the rows with equal payloads of at least `least_bytes`, the one with the largest page_id is a response and the
    others revisit it; smaller payloads are all responses.  A null html is an empty payload.  Rows that share the largest
    page_id are all responses; a null page_id is below all others, and equal payloads under null ids only are all responses.
    Other columns are ignored; an empty table gives no rows.

    What is equal is found from digests, and a revisit is made of them alone, so payloads stay where they are: a row is a
    response if a bitmap of revisits doesn't hold it; of the others only those move that a second bitmap, of the responses
    that the first one holds by chance, holds too.
    """
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("full_length", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    own = own.withColumn("key", F.when(F.col("full_length") >= least_bytes, F.xxhash64("page_id", "payload_digest")))
    meta = saved(own.where("key is not null").drop("payload"))
    same = ["payload_digest", "full_length"]
    last = meta.groupBy(*same).agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).where("n > 1 and last_id is not null").drop("n")
    revisits = saved(join_hot(meta, last, same, meta.count()).where(~F.col("page_id").eqNullSafe(F.col("last_id"))))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))

    def records(rows: DataFrame, again: bool) -> DataFrame:
        return rows.select(
            name(F.col("page_id")).alias("record_id"), F.lit("revisit" if again else "response").alias("record_type"), "target_uri", F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"),
            (name(F.col("last_id")) if again else F.lit(None).cast("string")).alias("refers_to"), "full_length", F.lit(None).cast("long").alias("content_length"), (F.lit(None).cast("binary") if again else F.col("payload")).alias("payload"),
        )

    held = spark.sparkContext.broadcast(kernel.id_bitmap(revisits.select("key").distinct()))
    exact = lambda a, b: a["page_id"].eqNullSafe(b["page_id"]) & (a["payload_digest"] == b["payload_digest"]) & (a["full_length"] == b["full_length"])
    inside = kernel.rows_with_id(meta, held, column="key").select("page_id", *same, "key").distinct()
    chance = saved(inside.join(revisits, exact(inside, revisits), "left_anti"))
    out = records(kernel.rows_with_id(own, held, inside=False, column="key"), False).unionByName(records(revisits, True))
    if chance.take(1):
        both = spark.sparkContext.broadcast(kernel.id_bitmap(chance.select("key").distinct()))
        doubtful = kernel.rows_with_id(kernel.rows_with_id(own, held, column="key"), both, column="key")
        out = out.unionByName(records(doubtful.join(chance, exact(doubtful, chance), "left_semi"), False))
    return out


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000) -> None:
    """Archive `pages` under `path`, a folder all executors share."""
    register(pages.sparkSession)
    records_of(pages, least_bytes).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records under `path`, with the columns of SCHEMA."""
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all `pages` to archives in the shared folder, read them back, and describe each page's record."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    read = read_archives(spark, path)
    full = F.col("record_type") == "response"
    return read.select(
        page("record_id").alias("page_id"), F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("full_length")).alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"),
    )
