"""Zstandard WARC archives: one frame per record, the dictionary in a leading skippable frame.

Writing is a Spark text sink. A row is one compressed frame, and the line
separator is itself an empty skippable frame, so the bytes between two records
are valid Zstandard and any file system that Spark writes to will do, with
Spark's commit of finished tasks only. Every file starts with the dictionary.

Reading takes a file from Spark's binary source and walks its frames in small
slices: skippable frames are skipped, every other frame must decode to exactly
one record whose version line, mandatory headers, lengths and digests hold. An
archive is held whole while it is read, so archives should stay below a few
hundred MB; those written here follow the size of Spark's partitions.

Of records with equal payloads of at least ``LEAST_BYTES`` bytes, the one with
the smallest id is a response and the others revisit it. Ids and digests alone
are shuffled to find them; payloads are joined by id, evenly spread.

Defined cases: null payloads are empty; null addresses are left out; a null id
is written as ``null`` and revisits a copy that has an id. Rows that repeat an
id and a payload are both responses or both revisits. No rows give no archive.
"""

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import shared_dir

LEAST_BYTES = 100
DICT_MAGIC = 0x184D2A5D  # fixed value of the WARC format for Zstandard: the skippable frame of the dictionary
SKIP_MASK, SKIP_MAGIC = 0xFFFFFFF0, 0x184D2A50  # fixed values of the Zstandard format
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
SEPARATOR = struct.pack("<II", SKIP_MAGIC, 0).decode("ascii")
SLICE = 16 << 10
OUT_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("archive", pa.string()),
])
RECORD_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, archive string"


# --- records as bytes -------------------------------------------------------------


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: an HTTP response, or a revisit without a block."""
    revisit = refers_to is not None
    block = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": urn(page_id),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        headers["WARC-Target-URI"] = "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    if revisit:
        headers |= {"WARC-Refers-To": urn(refers_to), "WARC-Profile": PROFILE}
    head = "".join(f"{name}: {value}\r\n" for name, value in headers.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def urn(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def id_of(value: str):
    if not (value.startswith("<urn:page:") and value.endswith(">")):
        raise ValueError(f"not a page id: {value}")
    return None if value == "<urn:page:null>" else int(value[10:-1])


def parse_record(data: bytes) -> dict:
    """The fields of a record; raises ValueError where headers, lengths or digests do not hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not gap or first not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name}")
    length = int(headers["content-length"])
    if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"content-length {length}, but {len(rest) - 4} bytes follow")
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha256:")
    payload, said = None, headers.get("x-payload-length")
    if kind == "response":
        http, gap, payload = rest[:length].partition(b"\r\n\r\n")
        if not gap or not http.startswith(b"HTTP/"):
            raise ValueError("the block is not an HTTP response")
        found = hashlib.sha256(payload).hexdigest()
        if digest and digest != found:
            raise ValueError(f"payload digest {found}, header {digest}")
        if said is not None and int(said) != len(payload):
            raise ValueError(f"payload of {len(payload)} bytes, header {said}")
        digest, said = found, len(payload)
    elif kind == "revisit" and "warc-refers-to" not in headers:
        raise ValueError("a revisit that refers to nothing")
    return {
        "page_id": id_of(headers["warc-record-id"]), "url": headers.get("warc-target-uri"),
        "payload_bytes": None if said is None else int(said), "payload_digest": digest or None, "record_type": kind,
        "refers_to": id_of(headers["warc-refers-to"]) if kind == "revisit" else None, "payload": payload,
    }


# --- frames -----------------------------------------------------------------------


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary


def frames(data) -> Iterator[bytes]:
    """The decoded frames of an archive in turn, with the dictionary it starts with."""
    view, at, context = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError(f"{len(view) - at} stray bytes at {at}")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & SKIP_MASK == SKIP_MAGIC:
            if at + 8 + size > len(view):
                raise ValueError(f"a skippable frame at {at} is cut off")
            if magic == DICT_MAGIC:
                if at:
                    raise ValueError(f"a dictionary at {at}, not at the start")
                dictionary = bytes(view[8:8 + size])
                if dictionary[:4] == ZSTD_MAGIC:
                    dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
                if dictionary:
                    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
            at += 8 + size
            continue
        decoder, parts, start = context.decompressobj(), [], at
        while not decoder.eof:
            if at >= len(view):
                raise ValueError(f"the frame at {start} is cut off")
            piece = view[at:at + SLICE]
            parts.append(decoder.decompress(piece))
            at += len(piece) - len(decoder.unused_data)
        yield b"".join(parts)


def read_archive(data, name: str = "") -> Iterator[dict]:
    for number, frame in enumerate(frames(data)):
        try:
            yield parse_record(frame) | {"archive": name}
        except ValueError as error:
            raise ValueError(f"{name}, record {number}: {error}") from error


# --- Spark ------------------------------------------------------------------------


def train_dictionary(pages: DataFrame, payload: str = "html", rows: int = 400, head: int = 4096, size: int = 32 << 10) -> bytes:
    """A dictionary from the heads of about ``rows`` sampled payloads; empty without any."""
    share = min(1.0, rows / max(pages.select().count(), 1))
    some = pages.select(F.col(payload).cast("binary").alias("data")).where("data is not null").sample(share, 3)
    samples = [bytes(r[0]) for r in some.select(F.substr("data", F.lit(1), F.lit(head))).limit(2 * rows).collect() if r[0]]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their plain text serves as well
        return b"".join(samples)[-size:]


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) rows of a (page_id, url, html) table."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= LEAST_BYTES).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = large.join(first, "digest").where("page_id > first or (page_id is null and first is not null)").distinct()
    again = again.select(F.col("page_id").alias("its_id"), F.col("digest").alias("its_digest"), F.col("first").alias("refers_to"))
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("its_id")) & (F.col("digest") == F.col("its_digest")), "left").drop("its_id", "its_digest")


def write_archives(pages: DataFrame, path: str, level: int = 3, dictionary: bytes | None = None) -> None:
    """The pages as archives below ``path``, one per partition."""
    shared = train_dictionary(pages) if dictionary is None else dictionary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = {"dict_data": zstandard.ZstdCompressionDict(shared)} if shared else {}
        context, begun = zstandard.ZstdCompressor(level=level, **options), False
        for batch in batches:
            columns = [batch.column(name) for name in ("page_id", "url", "payload", "digest", "refers_to")]
            out, held = [], 0
            for row in zip(*columns, strict=True):
                page_id, url, payload, digest, refers_to = (cell.as_py() for cell in row)
                if not begun:
                    out.append(dictionary_frame(shared))
                    begun = True
                out.append(context.compress(record_bytes(page_id, url, payload, digest, refers_to)))
                held += len(out[-1])
                if held > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = with_revisits(pages).mapInArrow(encode, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", SEPARATOR).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                out, held = [], 0
                for record in read_archive(content.as_buffer(), name.as_py()):
                    out.append(record)
                    held += len(record["payload"] or b"") + 200
                    if held > OUT_BYTES:
                        yield pa.RecordBatch.from_pylist(out, RECORD)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, RECORD)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(decode, RECORD_DDL)


def round_trip(pages: DataFrame) -> DataFrame:
    """The pages written as archives in the shared folder and read back."""
    path = shared_dir(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
