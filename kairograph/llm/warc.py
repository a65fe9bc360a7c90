"""WARC archives compressed with Zstandard: a dictionary in the leading skippable frame, then one frame per record."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.common import materialize, new_path, tasks_for, text_or_empty

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
CRLF = b"\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, uri: str, payload: bytes, date: str, refers_to: str | None = None) -> bytes:
    """One WARC record. A revisit has the HTTP headers of the payload, not the payload itself."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        (b"WARC-Type", b"response" if refers_to is None else b"revisit"),
        (b"WARC-Record-ID", f"<{record_id}>".encode()),
        (b"WARC-Date", date.encode()),
        (b"WARC-Target-URI", "".join(uri.split()).encode()),
        (b"WARC-Payload-Digest", f"sha1:{digest(payload)}".encode()),
    ]
    if refers_to is not None:
        fields += [(b"WARC-Refers-To", f"<{refers_to}>".encode()), (b"WARC-Profile", REVISIT_PROFILE)]
    fields += [(b"Content-Type", b"application/http;msgtype=response"), (b"Content-Length", str(len(block)).encode())]
    return b"WARC/1.1\r\n" + b"".join(k + b": " + v + CRLF for k, v in fields) + CRLF + block + CRLF + CRLF


def parse_record(data: bytes) -> dict:
    """The columns of RECORD_SCHEMA of one whole record; ValueError where headers, lengths or digests don't hold."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(CRLF)
    if not found or not lines[0].startswith(b"WARC/1."):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"header line without a colon: {line[:60]!r}")
        fields[name.strip().lower().decode()] = value.strip().decode()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise ValueError(f"headers missing: {', '.join(sorted(missing))}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4:
        raise ValueError(f"Content-Length {fields['content-length']} but {len(rest) - 4} bytes")
    if not rest.endswith(b"\r\n\r\n"):
        raise ValueError("record doesn't end in two line ends")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    lengths = [x.partition(b":")[2].strip() for x in http.split(CRLF) if x.lower().startswith(b"content-length:")]
    if not found or len(lengths) != 1 or not lengths[0].isdigit():
        raise ValueError("no HTTP header with one Content-Length")
    kind, said = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        if payload or "warc-refers-to" not in fields:
            raise ValueError("revisit with a payload or without WARC-Refers-To")
    elif len(payload) != int(lengths[0]) or (said and said != digest(payload)):
        raise ValueError("payload doesn't fit its length or digest")
    bare = lambda x: x.removeprefix("<").removesuffix(">")
    return {
        "record_id": bare(fields["warc-record-id"]),
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": bare(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload_digest": said or (digest(payload) if kind != "revisit" else None),
        "payload_bytes": int(lengths[0]),
        "payload": None if kind == "revisit" else payload,
        "error": None,
    }


class ArchiveWriter:
    """Compresses records one frame each; the dictionary is trained on the archive's first records, a bounded sample."""

    def __init__(self, sink, dictionary_bytes: int = 32 << 10, sample_records: int = 256, sample_bytes: int = 2 << 20, level: int = 6) -> None:
        self.sink, self.size, self.level = sink, dictionary_bytes, level
        self.waiting: list[bytes] = []
        self.sample, self.room = sample_records, sample_bytes
        self.compressor = None
        self.records = self.written = 0

    def write(self, data: bytes) -> None:
        self.records += 1
        if self.compressor is None:
            self.waiting.append(data)
            self.room -= len(data)
            if len(self.waiting) < self.sample and self.room > 0:
                return
            self._start()
        else:
            self._frame(data)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.written += len(data)

    def _frame(self, data: bytes) -> None:
        self._put(self.compressor.compress(data))

    def _start(self) -> None:
        import zstandard

        trained = None
        if len(self.waiting) >= 16:
            with_samples = [x[: 64 << 10] for x in self.waiting]
            try:
                trained = zstandard.train_dictionary(self.size, with_samples)
            except zstandard.ZstdError:  # too few or too like samples: the archive does without
                trained = None
        if trained is not None:
            raw = trained.as_bytes()
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=trained, write_content_size=True)
        for x in self.waiting:
            self._frame(x)
        self.waiting = []

    def close(self) -> None:
        if self.compressor is None:
            self._start()


def read_records(source, chunk: int = 256 << 10) -> Iterator[bytes]:
    """Decoded records of an open archive, one per frame, never more than one in memory. Raises ValueError if it is cut off."""
    import zstandard

    head = source.read(8)
    dictionary, data = None, head
    if len(head) == 8:
        magic, size = struct.unpack("<II", head)
        if magic == DICTIONARY_MAGIC:
            raw = source.read(size)
            if len(raw) != size:
                raise ValueError("dictionary frame cut off")
            if raw[:4] == b"\x28\xb5\x2f\xfd":  # itself compressed
                raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 28)
            dictionary, data = zstandard.ZstdCompressionDict(raw), b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        data = data or source.read(chunk)
        if not data:
            return
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not data:
                raise ValueError("record frame cut off")
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise ValueError(f"bad frame: {e}") from e
            data = frame.unused_data if frame.eof else source.read(chunk)
        yield b"".join(parts)


def write_archives(
    pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html", least_bytes: int = 0, archive_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """Write one record per row of ``pages`` to .warc.zst archives in the shared folder; (path, records, bytes) per archive.

    Of rows with equal payloads of ``least_bytes`` or more, the one with the largest id is a response and the others
    revisit it; rows that tie for the largest id are all responses; smaller payloads are responses. Null text is an
    empty payload, a null uri an empty one; rows of null id refer to the largest id like others, and are responses where
    all ids of the payload are null. The list of archives is written too: files that a lost task left aren't in it.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(uri_col).cast("string"), F.lit("")).alias("uri"), text_or_empty(text_col).cast("binary").alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    last = rows.filter(F.length("payload") >= least_bytes).groupBy("sha").agg(F.max("id").alias("last")).withColumnRenamed("sha", "last_sha")
    rows = rows.join(last, F.col("sha") == F.col("last_sha"), "left").select("id", "uri", "payload", "last")
    folder = new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        made, writer, sink = [], None, None
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    sink = store.open_output_stream(path, compression=None)
                    writer = ArchiveWriter(sink)
                seen = row["last"] is not None and row["id"] != row["last"]
                writer.write(record(f"urn:page:{'' if row['id'] is None else row['id']}", row["uri"], row["payload"], date, f"urn:page:{row['last']}" if seen else None))
                if writer.written >= archive_bytes:
                    writer.close()
                    sink.close()
                    made.append((path, writer.records, writer.written))
                    writer = None
        if writer is not None:
            writer.close()
            sink.close()
            made.append((path, writer.records, writer.written))
        columns = list(zip(*made)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["path", "records", "bytes"])

    scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
    listed = rows.mapInArrow(run, "path string, records long, bytes long")
    return materialize(listed, "archives").withColumn("path", F.concat(F.lit(scheme), "path"))


def read_archives(archives: DataFrame, strict: bool = True) -> DataFrame:
    """Records (RECORD_SCHEMA) of the archives named in column ``path``: dictionary loaded, one frame decoded per record.

    Headers, lengths and digests are checked. A record that fails is an error, or with ``strict`` off a row with
    ``error``; the rest of an archive that is cut off is one such row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        types = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])

        def parsed(path: str) -> Iterator[dict]:
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_stream(name, compression=None) as source:
                records = read_records(source)
                while True:
                    try:
                        data = next(records, None)
                        if data is None:
                            return
                    except ValueError as e:
                        if strict:
                            raise ValueError(f"{path}: {e}") from e
                        yield {"error": f"{path}: {e}"}
                        return
                    try:
                        yield parse_record(data)
                    except ValueError as e:
                        if strict:
                            raise ValueError(f"{path}: {e}") from e
                        yield {"error": f"{path}: {e}"}

        for batch in batches:
            for path in batch.column(0).to_pylist():
                out, size = [], 0
                for row in parsed(path):
                    out.append(row)
                    size += len(row.get("payload") or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=types)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=types)

    paths = archives.select("path").repartition(tasks_for(archives.sparkSession))
    return paths.mapInArrow(run, RECORD_SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The records of ``pages``, written to archives and read back, with the page ids of records and of what they refer to."""
    page = lambda c: F.expr(f"try_cast(nullif(substring({c}, 10), '') as long)")
    return read_archives(write_archives(pages)).withColumn("page_id", page("record_id")).withColumn("refers_to", page("refers_to"))
