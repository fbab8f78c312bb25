"""WARC archives as a Python data source: format "warc".

Writing: each task writes files of bounded size (option maxFileBytes), each record a gzip member of its own, and beside each file an
index of its records (offset, length, type). Reading: the driver lists the files and plans partitions of about maxPartitionBytes from
their sizes alone; an indexed file may be planned as several ranges of bytes, and the task that gets one reads the index and takes the
records that begin in it. Predicates on record_type, page_id, url and payload_digest are pushed down (where
spark.sql.python.filterPushdown.enabled is true); with an index, records of an unwanted type are not even read. A record's header is
parsed first, and the payload of a record that fails a predicate is skipped without being decoded. Option payload=skip leaves all out.

Files are reached through pyarrow's file systems, so a path may be in any store that they know (file, hdfs, s3, gs). Only whole
records are written under a temporary name. Commit renames the files of successful tasks, then removes what failed attempts of the same
write left, and with mode overwrite the files that were there before; until then the old archive stays whole.
"""

from __future__ import annotations

import base64
import binascii
import contextlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import Scratch, ship

SCHEMA = "record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: Fixed values of the WARC 1.1 format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PUSHED = {"record_type", "page_id", "url", "payload_digest"}
MIN_REVISIT = 1000


def _fs(path: str):
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _of_urn(text: str | None):
    inner = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner.lstrip("-").isdigit() else None


def _digest(text: str | None) -> str | None:
    """A SHA-1 in base 32 or hexadecimal as lower-case hexadecimal; digests of other kinds as they are."""
    kind, _, value = (text or "").rpartition(":")
    if kind.lower() in ("", "sha1"):
        with contextlib.suppress(binascii.Error):
            if len(value) == 32:
                return base64.b32decode(value.upper()).hex()
        if re.fullmatch("[0-9a-fA-F]{40}", value):
            return value.lower()
    return text or None


def header(fields: list[tuple[str, object]]) -> bytes:
    """A header block; line ends in values become spaces."""
    lines = [f"{k}: {' '.join(str(v).splitlines())}" for k, v in fields if v is not None]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n"


def record(kind: str, page_id, url, digest: str, size: int, refers_to, payload: bytes | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id)), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{b32}")]
    if kind == "revisit":
        fields += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return header(fields) + block + b"\r\n\r\n"


def parse_header(data: bytes) -> dict[str, str]:
    first, *lines = data.split(b"\r\n")
    if not first.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines if x)}


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.most, self.level = options["path"], int(options.get("maxfilebytes", 128 << 20)), int(options.get("level", 1))
        self.run, self.overwrite = uuid.uuid4().hex, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        done, out, name, index = Written(), None, "", []

        def close():
            out.close()
            with fs.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(json.dumps(index).encode())
            done.files.append(name)

        for b in iterator:
            columns = [b.column(c) for c in ("record_type", "page_id", "url", "payload_digest", "payload_bytes", "refers_to", "payload")]
            for i in range(b.num_rows):
                kind, page, url, digest, size, refers, payload = (c[i].as_py() for c in columns)
                if out is None:
                    name, index = f".tmp-{self.run}-{uuid.uuid4().hex}.warc.gz", []
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                data = z.compress(record(kind, page, url, digest, size, refers, payload)) + z.flush()
                index.append([out.tell(), len(data), kind])
                out.write(data)
                if out.tell() >= self.most:
                    close()
                    out = None
        if out is not None:
            close()
        return done

    def _clear(self, keep: set[str] | None) -> None:
        """Removes this write's temporary files, and if keep is given all other archive files."""
        fs, root = _fs(self.path)
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            name = info.base_name
            old = keep is not None and name.removesuffix(".idx").endswith((".warc", ".warc.gz")) and not name.startswith(".tmp-") and name not in keep
            if info.type == pafs.FileType.File and (name.startswith(f".tmp-{self.run}-") or old):
                fs.delete_file(info.path)

    def commit(self, messages) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        kept = set()
        for m in messages:
            for name in m.files if m else []:
                final = name.removeprefix(".tmp-")
                fs.move(f"{root}/{name}.idx", f"{root}/{final}.idx")
                fs.move(f"{root}/{name}", f"{root}/{final}")
                kept |= {final, f"{final}.idx"}
        self._clear(kept if self.overwrite else None)

    def abort(self, messages) -> None:
        self._clear(None)


class Part(InputPartition):
    """Pieces of files: (file, first byte, end byte, whether the file has an index)."""

    def __init__(self, pieces):
        super().__init__(pieces)
        self.pieces = pieces


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("maxpartitionbytes", 32 << 20))
        self.payload = options.get("payload", "bytes") != "skip"
        self.equal: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                column = f.attribute[0]
                self.equal[column] = self.equal[column] & values if column in self.equal else values
            else:
                yield f

    def partitions(self):
        fs, root = _fs(self.path)
        found = fs.get_file_info(root)
        if found.type == pafs.FileType.File:
            infos = [found, fs.get_file_info(f"{root}.idx")]
        else:
            infos = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        files = {i.path: i for i in infos if i.type == pafs.FileType.File}
        parts, size = [[]], 0
        for path in sorted(files):
            if not path.endswith((".warc", ".warc.gz")) or files[path].base_name.startswith("."):
                continue
            whole, indexed = files[path].size, f"{path}.idx" in files
            step = self.most if indexed else max(1, whole)
            for a in range(0, max(1, whole), step):
                n = min(step, whole - a)
                if size and size + n > self.most:
                    parts.append([])
                    size = 0
                parts[-1].append((path, a, a + n, indexed))
                size += n
        return [Part(p) for p in parts]

    def _ranges(self, fs, path: str, a: int, z: int, indexed: bool) -> list[tuple[int, int]]:
        """The bytes to read: those of all wanted records that begin in [a, z), neighbours together."""
        if not indexed:
            return [(a, z)]
        with fs.open_input_stream(f"{path}.idx") as f:
            index = json.loads(f.read())
        kinds, out = self.equal.get("record_type"), []
        for at, size, kind in index:
            if not a <= at < z or kinds is not None and kind not in kinds:
                continue
            if out and out[-1][1] == at:
                out[-1][1] = at + size
            else:
                out.append([at, at + size])
        return [(x, y) for x, y in out]

    def _wanted(self, values: dict) -> bool:
        return all(values[c] in v for c, v in self.equal.items())

    def read(self, partition: Part):
        fs, _ = _fs(self.path)
        schema = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        for path, first, end, indexed in partition.pieces:
            stream = _Plain if path.endswith(".warc") else _Gzip
            with fs.open_input_file(path) as f:
                for a, z in self._ranges(fs, path, first, end, indexed):
                    for row in self._records(stream(f, a, z)):
                        rows.append(row)
                        held += len(row[-1] or b"")
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def _records(self, s):
        while s.next():
            h = parse_header(s.until())
            length = int(h.get("content-length", 0))
            values = {"record_type": h.get("warc-type"), "page_id": _of_urn(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "payload_digest": _digest(h.get("warc-payload-digest"))}
            if not self._wanted(values):
                s.skip(length + 4)
                continue
            size = payload = None
            if h.get("content-type", "").startswith("application/http"):
                http = s.until()
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
                rest = length - len(http) - 4
                told = fields.get(b"content-length", b"")
                # a revisit holds no payload and tells its size; elsewhere what is there counts, as encodings and missing lengths have it differ
                size = rest if values["record_type"] != "revisit" else int(told) if told.isdigit() else None
            else:
                size = rest = length
            if self.payload and values["record_type"] != "revisit":
                payload = s.take(rest)
                s.skip(4)
            else:
                s.skip(rest + 4)
            yield (values["record_type"], values["page_id"], values["url"], values["payload_digest"], size, _of_urn(h.get("warc-refers-to")), payload)


class _Plain:
    """Records of an uncompressed file, one after the other; a skip is a seek."""

    def __init__(self, f, a: int, z: int):
        self.f, self.at, self.end = f, a, z

    def next(self) -> bool:
        return self.at < self.end

    def until(self) -> bytes:
        """Bytes up to the next empty line, which is passed."""
        self.f.seek(self.at)
        data = b""
        while (cut := data.find(b"\r\n\r\n")) < 0:
            more = self.f.read(4096)
            if not more:
                raise ValueError("a header does not end")
            data += more
        self.at += cut + 4
        return data[:cut]

    def take(self, n: int) -> bytes:
        self.f.seek(self.at)
        self.at += n
        return self.f.read(n)

    def skip(self, n: int) -> None:
        self.at += n


class _Gzip:
    """Records of a file of gzip members; what is skipped is inflated, in small pieces, only to find where the member ends."""

    def __init__(self, f, a: int, z: int):
        self.f, self.left, self.raw, self.z, self.data = f, z - a, b"", None, b""
        f.seek(a)

    def _more(self) -> bool:
        if not self.raw and self.left:
            self.raw = self.f.read(min(1 << 20, self.left))
            self.left -= len(self.raw)
        if not self.raw:
            return False
        if self.z is None or self.z.eof:
            self.z = zlib.decompressobj(31)
        self.data += self.z.decompress(self.raw, 1 << 20)
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def next(self) -> bool:
        while not self.data:
            if not self._more():
                return False
        return True

    def until(self) -> bytes:
        while (cut := self.data.find(b"\r\n\r\n")) < 0:
            if not self._more():
                raise ValueError("a header does not end")
        out, self.data = self.data[:cut], self.data[cut + 4 :]
        return out

    def take(self, n: int) -> bytes:
        while len(self.data) < n:
            if not self._more():
                raise ValueError("a record is cut short")
        out, self.data = self.data[:n], self.data[n:]
        return out

    def skip(self, n: int) -> None:
        while n:
            if not self.data and not self._more():
                raise ValueError("a record is cut short")
            k = min(n, len(self.data))
            self.data, n = self.data[k:], n - k


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """The records to write for pages (page_id, url, html).

    Of rows with equal payloads of at least min_revisit bytes the largest page_id is the response and the others revisit it. Repeated
    rows of that page_id are responses too; a null page_id never is one unless all its copies have none. Null html is an empty payload.
    The digests that occur twice are decided from (digest, id) alone and written as a table, whose size is then known: below the limit
    for broadcasts payloads stay where they are; beyond it they are dealt out once, and adaptive execution splits a hot digest."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    big = rows.filter(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    big = Scratch(pages.sparkSession, "warc").save(big.select("payload_digest", "first_id"), "repeated")
    out = rows.join(big, "payload_digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return out.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), "page_id", "url", "payload_digest", "payload_bytes",
        F.when(again, F.col("first_id")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archive(records: DataFrame, path: str, mode: str = "append", **options) -> None:
    register(records.sparkSession)
    records.write.format("warc").options(**options).mode(mode).save(path)


def read_archive(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)
