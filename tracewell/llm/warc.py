"""WARC archives as a Spark data source: one gzip member a record, split anywhere.

``spark.read.format("warc")`` cuts every archive into byte ranges, and a task reads one of them. It
looks for the gzip magic from the start of its range, takes the first place whose member decodes to a WARC
header and from which members follow each other to the end of the range (and for ``REACH`` bytes), and then owns every record that starts inside
the range, wherever it ends. So each record is read once, no task needs to know where another began, and no index
or whole file is needed. If members stop following each other, the place was either inside another record, whose
payload holds an archive uncompressed, or the archive is damaged: then the task walks the file from its
beginning, which tells the two apart, and a damaged archive fails the job with file and offset. Only a record that holds
an archive of more than ``REACH`` bytes uncompressed could mislead a task.

``df.write.format("warc")`` writes an archive or more a partition. Files of failed or repeated attempts are left out: the
commit lists the files of the attempts that count, and a reader takes what is listed (all ``*.warc.gz`` where there is
no list, as in archives from elsewhere).

Files are opened in the tasks through ``pyarrow.fs``, so paths may be local, ``hdfs``, ``viewfs``, ``s3`` or ``gs``.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tracewell.scratch import cut, shared_dir

MAGIC = b"\x1f\x8b\x08"
LISTED = "_SUCCESS"
WINDOW, STEP, BATCH = 1 << 20, 1 << 14, 1 << 23
#: So many bytes at least must be a chain of members, before its first one is taken for a record of its own.
REACH = 1 << 24
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "file string, offset long, type string, record_id string, uri string, refers_to string, "
    "digest string, length long, payload binary"
)
WRITTEN = ["id", "uri", "type", "refers_to", "digest", "length", "payload"]


class DamagedArchive(ValueError):
    """A file whose members don't follow each other."""


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def listed(path: str) -> list[tuple[str, int]]:
    """The archives of a folder (or one archive), with their sizes."""
    fs, root = filesystem(path)
    if fs.get_file_info(root).type == pafs.FileType.File:
        return [(root, fs.get_file_info(root).size)]
    if fs.get_file_info(f"{root}/{LISTED}").type == pafs.FileType.File:
        with fs.open_input_stream(f"{root}/{LISTED}") as f:
            lines = f.read().decode().splitlines()
        return [(f"{root}/{n}", int(size)) for n, size in (x.split("\t") for x in lines)]
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((x.path, x.size) for x in found if x.path.endswith(".warc.gz"))


class Members:
    """The gzip members of one file, read through a window."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.at, self.window = file, size, 0, b""

    def bytes_at(self, at: int) -> bytes:
        """Some bytes from ``at`` on, none at the end of the file."""
        if not self.at <= at < self.at + len(self.window):
            self.at, self.window = at, self.file.read_at(min(WINDOW, self.size - at), at) if at < self.size else b""
        return self.window[at - self.at : at - self.at + STEP]

    def find(self, at: int, end: int) -> int | None:
        """The first magic that starts in ``[at, end)``."""
        while at < end:
            block = self.file.read_at(min(WINDOW, self.size - at, end + len(MAGIC) - 1 - at), at)
            hit = block.find(MAGIC)
            if hit >= 0:
                return at + hit
            at += max(1, len(block) - len(MAGIC) + 1)
        return None

    def decode(self, at: int, keep: bool) -> tuple[int, bytes] | None:
        """``(end, data)`` of the member at ``at``, none if there isn't a whole one that opens with a WARC header."""
        d, pos, parts, head = zlib.decompressobj(31), at, [], b""
        while not d.eof:
            block = self.bytes_at(pos)
            try:
                out = d.decompress(block)
            except zlib.error:
                return None
            if not block:
                return None
            pos += len(block)
            if len(head) < 7:
                head += out[: 7 - len(head)]
                if head != b"WARC/1."[: len(head)]:
                    return None
            if keep:
                parts.append(out)
        return (pos - len(d.unused_data), b"".join(parts)) if len(head) == 7 else None

    def opens(self, at: int) -> bool:
        """Whether the first bytes of a member at ``at`` are those of a WARC header."""
        try:
            return zlib.decompressobj(31).decompress(self.bytes_at(at), 7) == b"WARC/1."
        except zlib.error:
            return False

    def first(self, start: int, end: int) -> int | None:
        """Where the first member starts that starts in ``[start, end)``."""
        if start == 0:
            return 0 if self.size else None
        at = self.find(start, end)
        while at is not None:
            got = self.decode(at, False)
            while got and got[0] < min(max(end, at + REACH), self.size):
                got = self.decode(got[0], False)
                if got is None:
                    return self.walk(start, end)
            if got:
                return at
            if self.opens(at):
                return self.walk(start, end)
            at = self.find(at + 1, end)
        return None

    def walk(self, start: int, end: int) -> int | None:
        """:meth:`first`, from the beginning of the file."""
        at = 0
        while at < start:
            at = self.whole(at, False)[0]
        return at if at < min(end, self.size) else None

    def whole(self, at: int, keep: bool = True) -> tuple[int, bytes]:
        got = self.decode(at, keep)
        if got is None:
            raise DamagedArchive(f"no WARC record at byte {at}")
        return got

    def owned(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        """``(offset, data)`` of the members that start in ``[start, end)``."""
        at = self.first(start, end)
        while at is not None and at < min(end, self.size):
            after, data = self.whole(at)
            yield at, data
            at = after
        if at is not None and at < self.size and not self.opens(at):  # whoever owns it could not know
            raise DamagedArchive(f"no WARC record at byte {at}")


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of a member, each with its payload: the HTTP body where there is one, else the block; none for a revisit."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        f = _fields(data[at:head]) if head > 0 else {}
        if not f.get("content-length", "").isdigit():
            raise DamagedArchive("a record without its length")
        body = head + 4
        block = data[body : body + int(f["content-length"])]
        if len(block) < int(f["content-length"]):
            raise DamagedArchive("a record shorter than its length")
        at = body + len(block) + 4
        kind, length = f.get("warc-type"), len(block)
        if f.get("content-type", "").replace(" ", "").startswith("application/http"):
            cut_at = block.find(b"\r\n\r\n")
            http, block = (block[:cut_at], block[cut_at + 4 :]) if cut_at >= 0 else (block, b"")
            said = _fields(http).get("content-length", "")
            length = int(said) if kind == "revisit" and said.isdigit() else len(block)
        yield {
            "type": kind, "record_id": f.get("warc-record-id", "").strip("<>") or None, "uri": f.get("warc-target-uri"),
            "refers_to": f.get("warc-refers-to", "").strip("<>") or None, "digest": _hex(f.get("warc-payload-digest")),
            "length": length, "payload": None if kind == "revisit" else block,
        }


def _hex(digest: str | None) -> str | None:
    """A labelled digest as bare lower-case hex; sha1 may be written in base 32."""
    if not digest:
        return None
    value = digest.rsplit(":", 1)[-1]
    return base64.b32decode(value.upper()).hex() if len(value) == 32 and digest.lower().startswith("sha1") else value.lower()


def record_id(name: str | None) -> str:
    """The record id of a row's id, which :func:`row_id` turns back."""
    return "urn:x-no-id" if name is None else f"urn:x-row:{quote(name, safe='')}"


def row_id(record: str | None) -> str | None:
    return unquote(record.removeprefix("urn:x-row:")) if record and record.startswith("urn:x-row:") else None


def render(row: dict, date: str) -> bytes:
    """One record. Control characters of a URI are written as their percent codes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['length']}\r\n\r\n".encode()
    block = http if row["type"] == "revisit" else http + (row["payload"] or b"")
    lines = [f"WARC-Type: {row['type']}", f"WARC-Record-ID: <{record_id(row['id'])}>", f"WARC-Date: {date}"]
    if row["uri"] is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), row["uri"]))
    if row["digest"]:
        lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode())
    if row["type"] == "revisit":
        lines += [f"WARC-Refers-To: <{record_id(row['refers_to'])}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class ByteRange(InputPartition):
    file: str
    size: int
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitbytes", 64 << 20))

    def partitions(self):
        every = [
            ByteRange(file, size, at, min(size, at + self.split)) for file, size in listed(self.path) for at in range(0, size, self.split)
        ]
        return every or [ByteRange("", 0, 0, 0)]

    def read(self, partition):
        if not partition.size:
            return
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
        rows, held = [], 0
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.file) as f:
            try:
                for at, data in Members(f, partition.size).owned(partition.start, partition.end):
                    for r in parse_records(data):
                        rows.append({"file": partition.file, "offset": at, **r})
                        held += len(r["payload"] or b"")
                    if held > BATCH or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)
                        rows, held = [], 0
            except DamagedArchive as e:
                raise DamagedArchive(f"{partition.file}, bytes {partition.start} to {partition.end}: {e}") from e
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.most = options["path"], int(options.get("maxbytes", 1 << 30))
        self.level, self.date = int(options.get("level", 6)), options.get("date", "1970-01-01T00:00:00Z")
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        if overwrite:
            fs.delete_dir_contents(root)

    def write(self, iterator):
        fs, root = filesystem(self.path)
        files, out = [], None
        for b in iterator:
            for row in b.to_pylist():
                if out is not None and out.tell() >= self.most:
                    files.append((name, out.tell()))
                    out.close()
                    out = None
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(gzip_member(self._about(name), self.level))
                out.write(gzip_member(render(row, self.date), self.level))
        if out is not None:
            files.append((name, out.tell()))
            out.close()
        return Written(files)

    def _about(self, name: str) -> bytes:
        lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"]
        block = b"format: WARC File Format 1.1\r\n"
        lines += [f"WARC-Date: {self.date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
        return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"

    def commit(self, messages):
        fs, root = filesystem(self.path)
        has = fs.get_file_info(f"{root}/{LISTED}").type == pafs.FileType.File
        before = [(p.rsplit("/", 1)[-1], size) for p, size in listed(self.path)] if has else []
        lines = [f"{n}\t{size}\n" for n, size in [*before, *(f for m in messages if m for f in m.files)]]
        with fs.open_output_stream(f"{root}/{LISTED}", compression=None) as f:
            f.write("".join(lines).encode())

    def abort(self, messages):
        fs, root = filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                fs.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """Format ``warc``. Options: ``splitBytes`` to read; ``maxBytes``, ``level``, ``date`` to write."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def read_warc(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """All records below ``path``: ``file, offset, type, record_id, uri, refers_to, digest, length, payload``.

    ``length`` and ``digest`` are those of the full payload; a revisit has them from its headers and its payload
    is null. Records of all types are returned, ``warcinfo`` too. A folder without archives gives no rows.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("splitBytes", split_bytes).load(path)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 1000) -> None:
    """A record for every row of ``pages``, its body in UTF-8 as payload.

    Of rows whose equal payloads have ``least`` bytes or more, those with the largest id are responses and the
    others revisits of it, without the payload; shorter ones are all responses. A null body is an empty payload. Rows that repeat
    are written each. A null id is smaller than all others; payloads that only null ids have are all responses.
    A null URL is left out. Texts may have any length, other columns are not looked at, and an empty table writes
    no archive.
    """
    p = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("uri"), F.coalesce(F.col(body_col), F.lit("")).cast("binary").alias("payload")
    ).withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload").cast("long")})
    long, short = p.filter(F.col("length") >= least), p.filter(F.col("length") < least)
    copies = long.groupBy("digest").agg(F.max("id").alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # a table, so that the join is of two plain shuffles, and Spark can split what many pages share
    copies = cut(copies, "warc-copies")
    again = F.col("keep").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep"))
    rows = long.join(copies, "digest", "left").withColumn("again", again)
    rows = rows.unionByName(short.withColumns({"keep": F.lit(None).cast(p.schema["id"].dataType), "again": F.lit(False)}))
    rows = rows.select(
        F.col("id").cast("string").alias("id"), "uri", F.when(F.col("again"), "revisit").otherwise("response").alias("type"),
        F.when(F.col("again"), F.col("keep").cast("string")).alias("refers_to"), "digest", "length",
        F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )
    pages.sparkSession.dataSource.register(WarcSource)
    rows.write.format("warc").mode("append").save(path)


def row_ids(record: str):
    """The row's id in a record id, as a column; null for records from elsewhere."""
    return F.when(F.col(record).startswith("urn:x-row:"), F.expr(f"url_decode(replace(substring({record}, 11), '+', '%2B'))"))


def op13_warc(spark, sf_dir):
    """All pages written to archives and read back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    r = read_warc(spark, path).filter(F.col("type").isin("response", "revisit"))
    full = F.col("payload").isNotNull()
    return r.select(
        row_ids("record_id").cast("long").alias("page_id"),
        F.when(full, F.octet_length("payload")).otherwise(F.col("length")).cast("long").alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        row_ids("refers_to").cast("long").alias("refers_to"),
    )


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS keep FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM k
"""
