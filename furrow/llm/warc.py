"""WARC archives of individually compressed records that share a dictionary.

An archive starts with a skippable frame that holds a Zstandard dictionary built from its
own records; each record is a frame of its own, so a reader can start at any record. Spark
writes the archives, one per partition, with its text sink: a record's bytes are a row, and
the line separator is an empty skippable frame, which every Zstandard reader passes over.
They are committed like any other output, so retried and lost tasks leave no half files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import cut

# Fixed values of the Zstandard and WARC formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
SEPARATOR = "P*M\x18\0\0\0\0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 1 << 16
# Records whose bytes train an archive's dictionary.
SAMPLE_BYTES = 4 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain_value(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header of its response but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {url} {digest}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _header_value(url)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Page-ID", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Fields, payload (None for a revisit) and payload length of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    response = fields["WARC-Type"] == "response"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if response and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"payload of page {fields['WARC-Page-ID']} doesn't match its digest")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number("WARC-Page-ID"),
        "url": None if url is None else _plain_value(url),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To-Page-ID"),
        "payload": payload if response else None,
    }


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary trained on records; their raw bytes where they are too few to train."""
    total = sum(map(len, samples))
    if total >= 8 * size and len(samples) >= 16:
        try:
            # A segment length and a width that suit text: no search over them.
            return zstandard.train_dictionary(size, samples, k=1024, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    trained = data[:4] == struct.pack("<I", 0xEC30A437)
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def archive_frames(records, sample_bytes: int = SAMPLE_BYTES, level: int = LEVEL):
    """Frames of one archive: the dictionary frame, then one frame for each record.

    Records are held back only until ``sample_bytes`` of them are there to train on. An
    archive without records has no frames.
    """
    waiting: list[bytes] = []
    size, compressor = 0, None

    def start():
        data = build_dictionary(waiting)
        own = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(data), write_checksum=True) if data else zstandard.ZstdCompressor(level=level, write_checksum=True)
        return own, struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data

    for record in records:
        if compressor is None:
            waiting.append(record)
            size += len(record)
            if size < sample_bytes:
                continue
            compressor, first = start()
            yield first
            for x in waiting:
                yield compressor.compress(x)
            waiting.clear()
        else:
            yield compressor.compress(record)
    if waiting:
        compressor, first = start()
        yield first
        for x in waiting:
            yield compressor.compress(x)


def frame_end(data: memoryview, start: int) -> int:
    """End of the frame at ``start``, from its header and block sizes."""
    end = start + zstandard.frame_header_size(bytes(data[start : start + 18]))
    checksum = data[start + 4] & 4
    while True:
        block = int.from_bytes(data[end : end + 3], "little")
        kind, size = block >> 1 & 3, block >> 3
        end += 3 + (1 if kind == 1 else size)
        if block & 1:
            return end + (4 if checksum else 0)


def read_frames(data: bytes):
    """Records of one archive."""
    view, at = memoryview(data), 0
    reader = zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            if magic == DICTIONARY_MAGIC and size:
                reader = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError("not a Zstandard frame")
        end = frame_end(view, at)
        yield reader.decompress(view[at:end])
        at = end


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest as hex, refers_to) of every page.

    Of pages with equal payloads of ``min_bytes`` or more, the one with the largest id is
    the original; rows that repeat that id and payload are originals too, and where no page
    of a group has an id all are. Only digests and ids are grouped, combined before the
    shuffle and written; the join with that table is left to the engine, which can then split
    the partition of a frequent payload.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    groups = rows.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
    shared = cut(groups.where("_n > 1").select(F.col("sha").alias("_sha"), "_last"))
    return (
        rows.join(shared, F.col("sha") == F.col("_sha"), "left")
        .withColumn("refers_to", F.when(~F.coalesce(F.col("_last").eqNullSafe(F.col("page_id")), F.lit(False)), F.col("_last")))
        .select("page_id", "url", "payload", "sha", "refers_to")
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) to a folder of archives, one record per row.

    A null html is an empty payload, null ids and urls stay null, repeated rows are repeated
    records, other columns are not read, an empty table gives no record. Each partition of
    the join with the originals becomes one archive, so payloads are shuffled once at most.
    """
    rows = with_originals(pages, min_bytes)

    def frames(batches):
        def records():
            for b in batches:
                for page_id, url, payload, sha, refers in zip(*[c for c in b.columns], strict=True):
                    digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                    yield make_record(page_id.as_py(), url.as_py(), payload.as_py(), refers.as_py(), digest)

        for frame in archive_frames(records()):
            yield pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], names=["frame"])

    out = rows.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("frame"))
    out.write.mode("errorifexists").option("lineSep", SEPARATOR).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record in the archives of a folder; payloads are checked against digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    columns = "page_id url payload_bytes payload_digest record_type refers_to".split() + ["payload"] * payloads
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def parse(batches):
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for record in read_frames(content.as_py()):
                    rows.append(parse_record(record))
                    if not payloads:
                        rows[-1]["payload"] = None
                    size += len(record) if payloads else 300
                    if size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in columns], names=columns)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads
    return files.mapInArrow(parse, schema)
