"""Zstandard-compressed WARC archives: writer and reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, followed by one
Zstandard frame for each record. ``write_archives`` runs on the executors and leaves the files to
Spark's own committer, so a lost task is simply run again and any file system Spark knows will do:
frames go out as rows of a text table whose line separator is itself an empty skippable frame (eight
ASCII bytes), which every Zstandard reader passes over. ``read_archives`` walks the frames of each
file, loads the dictionary, decodes one frame at a time and checks versions, headers, lengths and
digests; a bad record becomes a row with ``error`` set and the walk goes on, if its frame's end is known.

Rows: a null payload is written as an empty one; a null url leaves out WARC-Target-URI; a null id gets
a random URN and is never the response of other copies if one of them has an id. Rows that repeat the
smallest id of a payload are all responses. No rows: no archives, and reading gives no rows. Columns
other than the three named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame (magic 0x184D2A50, length 0), as text.
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
_FRAME_MAGIC, _RAW_DICTIONARY = 0xFD2FB528, 0xEC30A437
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_ID = re.compile(r"<urn:x-row:(-?\d+)>")
RECORD = (
    "archive string, record_no long, record_id string, row_id long, record_type string, target_uri string, refers_to string,"
    " refers_to_id long, payload_digest string, payload_bytes long, payload binary, error string"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(row_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One whole record; a revisit has the HTTP head only."""
    digest = digest or base32_sha1(payload)
    block = _HTTP % len(payload) + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:x-row:{row_id}>" if row_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-row:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int) -> zstd.ZstdCompressionDict | None:
    """A dictionary, or none where the samples are too few for the trainer."""
    if len(samples) < 8:
        return None
    try:
        return zstd.train_dictionary(min(size, max(256, sum(map(len, samples)) // 10)), samples)
    except zstd.ZstdError:
        return None


def archive_frames(records: Iterable[bytes], sample_records: int = 64, sample_bytes: int = 1 << 20, dictionary_size: int = 1 << 14, level: int = 3) -> Iterator[bytes]:
    """The frames of one archive. The dictionary is trained on the first records, which alone are held back."""
    records = iter(records)
    first: list[bytes] = []
    held = 0
    for r in records:
        first.append(r)
        held += len(r)
        if len(first) >= sample_records or held >= sample_bytes:
            break
    if not first:
        return
    trained = train([r[: 1 << 16] for r in first], dictionary_size)
    if trained:
        data = zstd.ZstdCompressor(level=level).compress(trained.as_bytes())
        yield struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data
    pack = zstd.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
    for r in first:
        yield pack.compress(r)
    first.clear()
    for r in records:
        yield pack.compress(r)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its header and block headers alone."""
    if len(data) - at < 8:
        raise ValueError("truncated frame")
    magic = int.from_bytes(data[at : at + 4], "little")
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    elif magic == _FRAME_MAGIC:
        try:
            head = data[at : at + 18]
            flags, end = zstd.get_frame_parameters(head), at + zstd.frame_header_size(head)
        except zstd.ZstdError as e:
            raise ValueError(f"bad frame header: {e}") from e
        last = False
        while not last:
            if end + 3 > len(data):
                raise ValueError("truncated frame")
            block = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            if kind == 3:
                raise ValueError("reserved block type")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * flags.has_checksum
    else:
        raise ValueError(f"no frame at byte {at}")
    if end > len(data):
        raise ValueError("truncated frame")
    return end


def parse_record(data: bytes) -> dict:
    """The fields of one record; ValueError names what is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line or header end")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"malformed header line {line[:60]!r}")
        if name.lower() in fields and name.lower() != "warc-concurrent-to":
            raise ValueError(f"repeated header {name}")
        fields[name.lower()] = value.strip()
    for name in ("warc-record-id", "warc-type", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"missing header {name}")
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length} does not fit the frame")
    block = rest[:length]
    kind = fields["warc-type"]
    payload: bytes | None = block
    if fields.get("content-type", "").startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found:
            raise ValueError("no end of the HTTP head")
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
        if kind != "revisit" and stated and int(stated[1]) != len(payload):
            raise ValueError("the HTTP Content-Length differs from the payload's")
    if kind == "revisit":
        if "warc-refers-to" not in fields:
            raise ValueError("revisit without WARC-Refers-To")
        payload = None
    for name, part in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        stated = fields.get(name, "")
        if part is not None and stated.lower().startswith("sha1:") and stated[5:] != base32_sha1(part):
            raise ValueError(f"{name} differs")
    digest = fields.get("warc-payload-digest", "")
    row_id = lambda x: int(m[1]) if (m := _ID.fullmatch(x or "")) else None
    return {
        "record_id": fields["warc-record-id"],
        "row_id": row_id(fields["warc-record-id"]),
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"),
        "refers_to_id": row_id(fields.get("warc-refers-to")),
        "payload_digest": digest[5:] if digest.lower().startswith("sha1:") else (base32_sha1(payload) if payload is not None else None),
        "payload_bytes": None if payload is None else len(payload),
        "payload": payload,
    }


def archive_records(data: bytes, max_record: int = 1 << 31) -> Iterator[dict]:
    """Every record of one archive, in order; what is wrong with one is in its ``error``."""
    view, at, n, dictionary = memoryview(data), 0, 0, None
    unpack = zstd.ZstdDecompressor()
    while at < len(view):
        try:
            end = frame_end(view, at)
        except ValueError as e:
            yield {"record_no": n, "error": str(e)}
            return
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic == DICTIONARY_MAGIC and at == 0:
            raw = bytes(view[8:end])
            try:
                if raw[:4] == struct.pack("<I", _FRAME_MAGIC):
                    raw = zstd.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
                if raw[:4] != struct.pack("<I", _RAW_DICTIONARY):
                    raise ValueError("the leading frame holds no dictionary")
                dictionary = zstd.ZstdCompressionDict(raw)
            except (zstd.ZstdError, ValueError) as e:
                yield {"record_no": n, "error": f"dictionary: {e}"}
                return
            unpack = zstd.ZstdDecompressor(dict_data=dictionary)
        elif magic == _FRAME_MAGIC:
            try:
                size = zstd.get_frame_parameters(view[at : at + 18]).content_size
                if size > max_record and size != zstd.CONTENTSIZE_UNKNOWN:
                    raise ValueError("record beyond max_record")
                whole = unpack.decompress(view[at:end]) if size != zstd.CONTENTSIZE_UNKNOWN else unpack.decompressobj().decompress(view[at:end])
                yield {"record_no": n, "error": None} | parse_record(whole)
            except (zstd.ZstdError, ValueError) as e:
                yield {"record_no": n, "error": str(e)}
            n += 1
        at = end


_NAMES = [x.split()[0] for x in RECORD.split(",")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_RECORD_ARROW = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in RECORD.split(",")])


def _write_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[bytes]:
        for b in batches:
            for row_id, url, payload, refers_to in zip(*(b.column(c) for c in ("row_id", "url", "payload", "refers_to")), strict=True):
                yield record_bytes(row_id.as_py(), url.as_py(), payload.as_py() or b"", refers_to.as_py())

    out: list[bytes] = []
    held = 0
    for frame in archive_frames(records()):
        out.append(frame)
        held += len(frame)
        if held > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])


def write_archives(df: DataFrame, path: str, id_col: str = "id", url_col: str = "url", payload_col: str = "payload") -> None:
    """Writes a record for each row, an archive for each partition.

    Of the rows with equal payloads the one with the smallest id is the response; the others are revisits of it.
    The payload's digest is joined with the smallest id per digest; both sides can be split where a digest is hot.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    first = rows.groupBy("sha").agg(F.min("row_id").alias("first_id"))
    marked = rows.join(first, "sha").select(
        "row_id", "url", "payload", F.when(F.col("row_id").isNull() | (F.col("row_id") != F.col("first_id")), F.col("first_id")).alias("refers_to")
    )
    frames = marked.mapInArrow(_write_partition, "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below a path, columns as in RECORD; payload is null for revisits, or unless asked for.

    A file is one row of the ``binaryFile`` source, so an archive has to fit in an executor's memory; the writer's
    archives are as large as one partition of its input.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held = 0
        for b in batches:
            for name, content in zip(b.column("path"), b.column("content"), strict=True):
                name = name.as_py()
                for r in archive_records(content.as_py()):
                    if not with_payload:
                        r["payload"] = None
                    out.append({"archive": name} | r)
                    held += 300 + len(r.get("payload") or b"")
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(out, schema=_RECORD_ARROW)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_RECORD_ARROW)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, RECORD)


def page_digests(records: DataFrame) -> DataFrame:
    """id, payload_bytes, payload_digest, record_type and refers_to of each record read back.

    A revisit's length is that of the response which it names, whose digest must be the same; any invalid
    record or unresolved revisit fails the job.
    """
    r = records.select("row_id", "record_type", "refers_to", "refers_to_id", "record_id", "payload_digest", "payload_bytes", "error", "target_uri")
    r = r.withColumn("record_type", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")).otherwise(F.col("record_type")))
    response = r.filter("record_type = 'response'").groupBy("record_id").agg(F.first("payload_digest").alias("d"), F.first("payload_bytes").alias("n"))
    revisit = r.filter("record_type = 'revisit'").drop("record_id").join(response.withColumnRenamed("record_id", "refers_to"), "refers_to", "left")
    bad = F.col("d").isNull() | (F.col("d") != F.col("payload_digest"))
    revisit = revisit.withColumn("payload_bytes", F.when(bad, F.raise_error(F.lit("revisit without its response")).cast("long")).otherwise(F.col("n")))
    cols = ["row_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_id").alias("refers_to"), "target_uri"]
    return r.filter("record_type = 'response'").select(*cols).unionByName(revisit.select(*cols))
