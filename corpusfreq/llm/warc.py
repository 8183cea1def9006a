"""WARC archives: a writer and a Python data source.

The writer turns rows into gzip records, one member a record, with `revisit` records for payloads that an archive set holds
already. Each member tells its packed length in the `sl` extra field of the gzip header. A manifest, committed once as a Parquet table, names the files of
the attempts that count. The data source plans partitions over files (several small ones a partition), takes equality and IN
predicates on the record type and on header columns from Spark, and reads each header first; of a record that doesn't pass, or whose payload isn't asked for, the rest is
passed over without being inflated where the member tells its length, and without being put together elsewhere.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from corpusfreq.session import materialize, scratch_path

SCHEMA = "file string, offset long, warc_type string, record_id string, target_uri string, date string, content_type string, payload_digest string, refers_to string, truncated string, content_length long, payload_length long, payload binary, computed_digest string"
HEADERS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "truncated": "warc-truncated"}
MANIFEST = "_manifest"
_CHUNK, _STEP = 1 << 18, 1 << 14
BROADCAST_ROWS = 50_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (pafs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value).strip()


def record(kind: str, key: str, uri: str | None, payload: bytes, sha: str, refers: str | None, date: str) -> bytes:
    """One record: an HTTP response whose payload is stored (response) or left out (revisit)."""
    stored = payload if kind == "response" else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{key}>"), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha}")]
    if uri is not None:
        head.append(("WARC-Target-URI", _clean(uri)))
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers}>")]
    head.append(("Content-Length", str(len(http) + len(stored))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace") + b"\r\n" + http + stored + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member whose header tells its packed and plain length (extra field `sl`), unless they take more than 32 bits."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    whole = 10 + 14 + len(body) + 8
    if max(whole, len(data)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00" + bytes(5) + b"\xff" + body + tail
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, whole, len(data)) + body + tail


def write(rows: DataFrame, path: str, max_bytes: int = 64 << 20, date: str = "2000-01-01T00:00:00Z") -> int:
    """Write rows (record_key string, uri, payload binary, sha binary, refers string or null) below path; returns the number of files.

    Files are named by attempt and roll at about max_bytes. Their names travel as rows of the manifest, which Spark commits once, so
    files of lost or doubled attempts aren't in it and aren't read. Rows with `refers` become revisits. A null uri has no header.
    """
    made = rows.select("record_key", "uri", F.when(F.col("refers").isNull(), F.col("payload")).alias("payload"), F.length("payload").alias("size"), "sha", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(path)
        fs.create_dir(root, recursive=True)
        mine, out, held, done = uuid.uuid4().hex, None, 0, []
        for b in batches:
            for key, uri, payload, size, sha, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = f"{mine}-{len(done):04d}.warc.gz"
                    out, held = fs.open_output_stream(f"{root}/{name}", compression=None), 0
                body = payload if payload is not None else _Sized(size)
                data = member(record("response" if refers is None else "revisit", key, uri, body, base64.b32encode(sha).decode(), refers, date))
                out.write(data)
                held += len(data)
                if held >= max_bytes:
                    out.close()
                    done.append((name, held))
                    out = None
        if out is not None:
            out.close()
            done.append((name, held))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([h for _, h in done], pa.int64())], ["file", "bytes"])

    manifest = f"{path.rstrip('/')}/{MANIFEST}"
    made.mapInArrow(run, "file string, bytes long").write.parquet(manifest)
    return rows.sparkSession.read.schema("file string, bytes long").parquet(manifest).count()


class _Sized:
    """Stands for a payload that isn't stored; only its length counts."""

    def __init__(self, size: int) -> None:
        self.size = size

    def __len__(self) -> int:
        return self.size


class _Bytes:
    """Buffered reading over a plain or gzip stream of any number of members."""

    def __init__(self, raw, packed: bool) -> None:
        self.raw, self.packed, self.box, self.buffer, self.at = raw, packed, None, b"", 0
        self.feed, self.left = b"", None  # packed bytes that aren't inflated yet; how many of this member are neither fed nor passed over, if it tells
        self.inflated = 0

    def _fill(self, n: int) -> bool:
        while len(self.feed) < n:
            data = self.raw.read(_CHUNK)
            if not data:
                return False
            self.feed += data
        return True

    def _begin(self) -> bool:
        """Start the next member; false at the end (zero padding may follow the last)."""
        if not self._fill(1):
            return False
        if self.feed[:1] == b"\0" and not self.feed.strip(b"\0"):
            self._fill(1 << 30)
            if not self.feed.strip(b"\0"):
                return False
        self.box, self.left = zlib.decompressobj(31), None
        if self._fill(24) and self.feed[3] & 4 and self.feed[10:16] == b"\x0c\x00sl\x08\x00":
            self.left = struct.unpack("<I", self.feed[16:20])[0]
        return True

    def _more(self) -> bool:
        if not self.packed:
            data = self.raw.read(_CHUNK)
            self.buffer += data
            return bool(data)
        while True:
            if self.box is None and not self._begin():
                return False
            if not self._fill(1):
                raise EOFError("the archive ends within a gzip member")
            part, self.feed = self.feed[:_STEP], self.feed[_STEP:]
            data = self.box.decompress(part, _CHUNK)
            unused = self.box.unconsumed_tail or self.box.unused_data
            self.feed = unused + self.feed
            if self.left is not None:
                self.left -= len(part) - len(unused)
            if self.box.eof:
                self.box = None
            if data:
                self.inflated += len(data)
                self.buffer += data
                return True

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (k := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                out, self.buffer = self.buffer, b""
                self.at += len(out)
                return out
        out, self.buffer = self.buffer[: k + len(mark)], self.buffer[k + len(mark) :]
        self.at += len(out)
        return out

    def take(self, n: int, keep: bool) -> bytes:
        """The next n bytes; with keep false they are passed over without being put together. An error if there are fewer."""
        parts = []
        while n:
            if not self.buffer and not self._more():
                raise EOFError(f"the archive ends {n} bytes before the end of a record")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            self.at += len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)

    def leave(self, n: int) -> bool:
        """Pass over the rest of this member, n bytes of content and the two empty lines after them, without inflating it; false where its length isn't told."""
        if self.box is None or self.left is None:
            return False
        while self.left:
            if not self.feed:
                if hasattr(self.raw, "seek") and self.left > _CHUNK:
                    self.raw.seek(self.left - 1, 1)  # the last byte is read, so that a cut off archive shows
                    self.left = 1
                if not self._fill(1):
                    raise EOFError("the archive ends within a gzip member")
            k = min(self.left, len(self.feed))
            self.feed, self.left = self.feed[k:], self.left - k
        self.box, self.buffer = None, b""
        self.at += n + 4
        return True


def records(raw, packed: bool, wanted=lambda head: True, payload: str = "bytes") -> Iterator[dict]:
    """Records of a stream. wanted sees the parsed headers before anything of the content is decoded.
    payload: none, digest (length and SHA-1 only) or bytes. Archives that are cut off raise EOFError."""
    stream = _Bytes(raw, packed)
    while True:
        offset = stream.at
        head = stream.until(b"\r\n\r\n")
        if not head.strip():
            return
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {offset}: {lines[0][:40]!r}")
        if not head.endswith(b"\r\n\r\n"):
            raise EOFError(f"the archive ends within the header at {offset}")
        fields: dict[str, str] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields.setdefault(name.strip().lower(), value.strip())
        size = int(fields.get("content-length", 0))
        row = {c: fields.get(h) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c] and row[c].strip("<>")
        row["payload_digest"] = row["payload_digest"] and row["payload_digest"].rpartition(":")[2]
        row |= {"offset": offset, "content_length": size, "payload_length": None, "payload": None, "computed_digest": None}
        use = wanted(row)
        decode = use and payload != "none"
        content = b""
        if decode or not stream.leave(size):
            content = stream.take(size, decode)
            if not (stream.buffer or stream._more()):
                pass  # the last record of a plain file may lack its empty lines
            else:
                stream.until(b"\r\n\r\n") if not stream.buffer.startswith(b"\r\n\r\n") else stream.take(4, False)
        if not use:
            continue
        if decode:
            http, found, body = content.partition(b"\r\n\r\n") if (row["content_type"] or "").startswith("application/http") else (b"", b"", content)
            if (row["content_type"] or "").startswith("application/http"):
                told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                row["payload_length"] = int(told[1]) if told and row["warc_type"] == "revisit" else len(body)
            else:
                row["payload_length"] = len(body)
            if row["warc_type"] != "revisit":
                row["computed_digest"] = digest(body)
                row["payload"] = body if payload == "bytes" else None
        yield row


class _Files(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.payload = options["path"], options.get("payload", "bytes")
        self.target = int(options.get("partition_bytes", 16 << 20))
        self.columns = schema.fieldNames()
        self.equal: list[tuple[str, set]] = []
        self.given: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, IN and not-null on header columns are settled here, on the header alone; the rest goes back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.equal.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.given.append(f.attribute[0])
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = _fs(self.path)
        if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.Directory:
            listed = pads.dataset(f"{root}/{MANIFEST}", filesystem=fs, format="parquet", schema=pa.schema([("file", pa.string()), ("bytes", pa.int64())])).to_table()
            found = [(f"{root}/{n}", size) for n, size in zip(listed["file"].to_pylist(), listed["bytes"].to_pylist())]
        else:
            all_ = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
            found = [(i.path, i.size) for i in all_ if i.type == pafs.FileType.File and i.base_name[0] not in "._" and re.search(r"\.warc(\.gz)?$", i.path)]
        groups: list[list[str]] = []
        held = 0
        for name, size in sorted(found):
            if not groups or held + size > self.target:
                groups.append([])
                held = 0
            groups[-1].append(name)
            held += size
        return [_Files(g) for g in groups]

    def read(self, partition: _Files | None) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(self.path)
        kinds = {"offset": pa.int64(), "content_length": pa.int64(), "payload_length": pa.int64(), "payload": pa.binary()}

        def wanted(head: dict) -> bool:
            return all(head[c] is not None for c in self.given) and all(head[c] in values for c, values in self.equal)

        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.columns], self.columns)

        for name in partition.names if partition else []:
            with fs.open_input_file(name) as raw:
                for r in records(raw, name.endswith(".gz"), wanted, self.payload):
                    rows.append(r | {"file": name})
                    held += len(r["payload"] or b"") + 500
                    if held > 8 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class WarcDataSource(DataSource):
    """spark.read.format("warc").option("payload", "none|digest|bytes").load(path); predicates are pushed down where
    spark.sql.python.filterPushdown.enabled is true."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options, schema)


def read(spark: SparkSession, path: str, payload: str = "bytes") -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", payload).load(path)


def revisits(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """rows (id, payload binary, ...) with sha (20 bytes) and refers_id: of rows with equal payloads of at least min_bytes the one of the largest id stands, the others refer to it.

    Payloads aren't shuffled for the choice: ids and digests find the digests that repeat. Up to BROADCAST_ROWS of these (counted first) are broadcast; beyond that they
    are joined to the ids alone, and payloads meet what they refer to by id and digest, so that a page that many rows share is no hot key of payloads.
    Null ids never stand for others and refer to nothing.
    """
    hashed = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    many = hashed.filter((F.length("payload") >= min_bytes) & F.col("id").isNotNull()).select("id", "sha")
    twice, _ = materialize(many.groupBy("sha").agg(F.max("id").alias("top"), F.count("*").alias("n")).filter("n > 1").select("sha", "top"), "digests")
    if twice.count() <= BROADCAST_ROWS:
        return hashed.join(F.broadcast(twice), "sha", "left").withColumn("refers_id", F.when(F.col("id") < F.col("top"), F.col("top"))).drop("top")
    refers = many.distinct().join(twice, "sha").filter("id < top").select("id", "sha", F.col("top").alias("refers_id"))
    return hashed.join(refers, ["id", "sha"], "left")


def archive(rows: DataFrame, path: str, id_col: str, uri_col: str, text_col: str, min_bytes: int = 0) -> int:
    """Write a record a row: payload the text in UTF-8 (null: empty), key urn:row:<id>. Null ids get urn:row: without a number. Returns the number of files.

    Other columns aren't read; an empty table writes no file.
    """
    narrow = rows.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"))
    marked = revisits(narrow, min_bytes)
    key = F.concat(F.lit("urn:row:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    return write(marked.select(key.alias("record_key"), "uri", "payload", "sha", F.concat(F.lit("urn:row:"), F.col("refers_id").cast("string")).alias("refers")), path)

