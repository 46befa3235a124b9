"""WARC archives with a Zstandard dictionary of their own.

An archive is one file: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one
frame per record, so that any record can be read alone once the dictionary is known. Files are
written by Spark's text writer, which commits them like any other output on any file system and
lets a lost task write again: a row is a frame, and the line separator is an empty skippable frame,
which every Zstandard reader passes over.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # magic 0x184D2A50, length 0
WHOLE_FROM = 1000  # payloads of fewer bytes are always written out
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def roles(pages: DataFrame, whole_from: int = WHOLE_FROM) -> DataFrame:
    """page_id, url, payload (binary), payload_digest (hex SHA-1) and refers_to: of equal payloads
    of at least `whole_from` bytes every page refers to the one with the largest page_id.

    A NULL html is an empty payload. A row that repeats page_id and payload plays the same part; a
    NULL page_id is smaller than any other. Only digests are grouped, first within each task; the
    pages then join by page_id, which no group of copies can make uneven.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.lower(F.sha1("payload")))
    large = rows.filter(F.octet_length("payload") >= whole_from).select("page_id", "payload_digest")
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("__to"), F.count(F.lit(1)).alias("__n"))
    groups = groups.filter("__n > 1 and __to is not null")
    narrow = large.join(groups, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("__to")))
    revisits = narrow.select(
        F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), "__to"
    ).distinct()
    same = rows["page_id"].eqNullSafe(revisits["__id"]) & (rows["payload_digest"] == revisits["__digest"])
    joined = rows.join(revisits, same, "left")
    return joined.select("page_id", "url", "payload", "payload_digest", F.col("__to").alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its HTTP head, or a revisit that has only the head."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    name = "none" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes], size: int, sample: int) -> bytes:
    """A dictionary of `size` bytes from about `sample` bytes of records spread over the archive.
    Too few records give an empty one. The sample decides how small the archive gets, nothing else."""
    import zstandard

    step = max(1, sum(map(len, records)) // sample)
    chosen = [r[: 1 << 17] for r in records[::step]]
    if len(chosen) < 8 or sum(map(len, chosen)) < 4 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, chosen, k=256, d=8, steps=1).as_bytes()
    except zstandard.ZstdError:  # all samples are alike: nothing to learn
        return b""


def archive(records: list[bytes], size: int, sample: int, level: int) -> Iterator[bytes]:
    """The frames of one archive, dictionary first."""
    import zstandard

    words = train(records, size, sample)
    yield struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words
    known = zstandard.ZstdCompressionDict(words) if words else None
    press = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True)
    for r in records:
        yield press.compress(r)


def write(
    rows: DataFrame, path: str, archive_bytes: int = 16 << 20, dictionary_bytes: int = 64 << 10,
    sample_bytes: int = 4 << 20, level: int = 3,
) -> None:
    """Write the rows of `roles` as archives under `path`.

    A task closes an archive after about `archive_bytes` of records and opens the next one, with a
    new dictionary, in the same file; a record of any size is written whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full() -> Iterator[list[bytes]]:
            held, size = [], 0
            for batch in batches:
                for k in range(batch.num_rows):
                    row = [c[k].as_py() for c in batch.columns]
                    held.append(record(*row))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield held
                        held, size = [], 0
            if held:
                yield held

        for held in full():
            frames, size = [], 0
            for frame in archive(held, dictionary_bytes, sample_bytes, level):
                frames.append(frame)
                size += len(frame)
                if size >= 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])
                    frames, size = [], 0
            if frames:
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    frames = rows.mapInArrow(run, "frame binary")
    # The bytes are handed to the writer as they are: a cast from binary to string copies them.
    frames.select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME).text(path)


def frames_of(data: bytes) -> Iterator[tuple[object, int, int]]:
    """Begin and end of each record's frame, with the dictionary that is in force there."""
    import zstandard

    at, known = 0, None
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC:
                known = zstandard.ZstdCompressionDict(data[at + 8 : at + 8 + size]) if size else None
            at += 8 + size
            continue
        end = at + frame_length(data, at)
        yield known, at, end
        at = end


def frame_length(data: bytes, at: int) -> int:
    """Length of the Zstandard frame at `at`, from its header and block headers."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    size = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + (1 if single and not flags >> 6 else (0, 2, 4, 8)[flags >> 6])
    while True:
        head = int.from_bytes(data[size : size + 3], "little")
        size += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return size + (4 if flags >> 2 & 1 else 0) - at


RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def parse(data: bytes) -> tuple:
    """A record as a row of RECORDS. A revisit's length is that of its HTTP head."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    name = fields["WARC-Record-ID"][10:-1]
    page_id = None if name == "none" else int(name)
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"][5:]
    url = fields["WARC-Target-URI"]
    if kind == "response":
        return page_id, url, kind, None, len(payload), hashlib.sha1(payload).hexdigest(), payload
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    return page_id, url, kind, int(fields["WARC-Refers-To"][10:-1]), length, digest, None


def load(spark, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under `path`, as RECORDS: response payloads are read back and
    digested anew. `payloads=False` leaves their bytes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for k in range(batch.num_rows):
                data, reader, last, rows, size = batch.column(0)[k].as_py(), None, None, [], 0
                for known, at, end in frames_of(data):
                    if reader is None or known is not last:
                        reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
                        last = known
                    row = parse(reader.decompress(data[at:end]))
                    rows.append(row if payloads else (*row[:-1], None))
                    size += (row[4] if payloads else 0) + 200
                    if size >= 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.select("content").mapInArrow(run, RECORDS)
