"""Token-id files: documents as ids, in ascending order of their ids, in coded blocks.

A file is a run of frames: a directory (which documents, how many ids of each),
then one block of the range coder. Files are written by Spark's text sink, a
frame per row with a line feed after it, so any file system that Spark writes to
will do. Part n holds smaller document ids than part n + 1.

Texts are tokenized in pieces. Byte-level BPE starts a new piece at every single
space between two other characters, so such texts are split there, and the ids
of a piece are kept in a table of bounded bytes; texts with any other white
space than single spaces and line feeds, and texts that hold an added token of
the tokenizer, such as an end mark, are encoded whole. Both give the ids of the
whole text.

Defined cases: null text is empty and has the end id only. Null document ids
come first. Rows that repeat an id are separate documents, ordered by text
hash. No rows give no files and no rows.
"""

import os
import re
import struct
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm import id_coder
from tickloom.llm.common import packed
from tickloom.llm.id_coder import BLOCK_IDS
from tickloom.session import materialize, shared_dir

END_ID = 2
FRAME = "<4sII"  # magic, bytes of the directory, bytes of the block
MAGIC = b"TLF1"
ENTRY = np.dtype([("doc_id", "<i8"), ("ids", "<u4"), ("flags", "<u4")])
NULL_ID, GOES_ON = 1, 2
KEPT_BYTES, ENTRY_BYTES = 80_000_000, 170  # of a worker's table; what Python adds to the bytes of an entry
# pieces that hold white space other than single line feeds between other characters
IRREGULAR = re.compile("^$|^\\n|\\n$|\\n\\n|[^\\S\\n]|\u180e")


HELD = None  # the table's key for its own bytes; pieces are strings


class PieceEncoder:
    """Ids of texts, by a table of pieces seen before; irregular pieces have none."""

    def __init__(self, tokenizer, table: dict | None = None):
        self.tokenizer, self.table = tokenizer, {} if table is None else table
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        # byte-level vocabularies write a space as this letter
        added = sorted((token.content for token in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.opens = np.array([(tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        table, split = self.table, [[""] if self.added.search(text) else text.split(" ") for text in texts]
        # the empty piece is irregular, and its text is encoded whole
        found = [list(map(table.get, pieces)) for pieces in split]
        fresh = list({piece for pieces, coded in zip(split, found, strict=True) if None in coded
                      for piece, ids in zip(pieces, coded, strict=True) if ids is None})
        regular = [piece for piece in fresh if not IRREGULAR.search(piece)]
        new = dict.fromkeys(fresh, 0) | dict(zip(regular, self.ids_of_pieces(regular), strict=True))
        for pieces, coded in zip(split, found, strict=True):
            if None in coded:
                coded[:] = [new[piece] if ids is None else ids for piece, ids in zip(pieces, coded, strict=True)]
        if table.get(HELD, 0) < KEPT_BYTES:  # common pieces come early
            table.update(new)
            table[HELD] = table.get(HELD, 0) + sum(len(piece) + len(ids or b"") + ENTRY_BYTES for piece, ids in new.items())
        # the first piece has no space before it; irregular texts are encoded whole
        heads = self.tokenizer.encode_batch_fast(
            [text if 0 in coded else pieces[0] for text, pieces, coded in zip(texts, split, found, strict=True)], add_special_tokens=False)
        for coded, head in zip(found, heads, strict=True):
            first = array("I", head.ids).tobytes()
            yield first if 0 in coded else first + b"".join(coded[1:])

    def ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces with a space before each, encoded as one text and cut where an id opens with a space."""
        if not pieces:
            return []
        joined = self.tokenizer.encode_batch_fast([" " + " ".join(pieces)], add_special_tokens=False)[0]
        ids = np.array(joined.ids, "<u4")
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(pieces):
            raise ValueError("the tokenizer does not begin a piece at every space")
        raw, cuts = ids.tobytes(), [*(starts * 4).tolist(), len(ids) * 4]
        return [raw[low:high] for low, high in zip(cuts, cuts[1:], strict=False)]


def worker_table() -> dict:
    """A table that lives as long as the Python worker, over all its tasks."""
    home = sys.modules.setdefault("_tickloom_pieces", types.ModuleType("_tickloom_pieces"))
    return home.__dict__.setdefault("table", {})


def frame(entries: list[tuple], ids: list[np.ndarray]) -> bytes:
    directory, block = np.array(entries, ENTRY).tobytes(), id_coder.encode(np.concatenate(ids))
    checked = directory + struct.pack("<I", zlib.crc32(directory))
    return struct.pack(FRAME, MAGIC, len(checked), len(block)) + checked + block


def frames_of(documents: Iterator[tuple[int | None, np.ndarray]]) -> Iterator[bytes]:
    """Frames of full blocks; a document may go on in the next ones."""
    entries, parts, room = [], [], BLOCK_IDS
    for doc_id, ids in documents:
        at = 0
        while True:
            take = min(room, len(ids) - at)
            more = at + take < len(ids)
            entries.append((doc_id or 0, take, NULL_ID * (doc_id is None) + GOES_ON * more))
            parts.append(ids[at:at + take])
            at, room = at + take, room - take
            if not room:
                yield frame(entries, parts)
                entries, parts, room = [], [], BLOCK_IDS
            if not more:
                break
    if entries:
        yield frame(entries, parts)


def read_frames(data) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
    """(doc_id, ids, crc32, last block's ids) per document of a file, in order."""
    view, at = memoryview(data), 0
    count = checksum = 0
    while at < len(view):
        if len(view) - at < struct.calcsize(FRAME):
            raise ValueError(f"a frame at {at} is cut off")
        magic, directory_size, block_size = struct.unpack_from(FRAME, view, at)
        begin, stop = at + struct.calcsize(FRAME), at + struct.calcsize(FRAME) + directory_size + block_size
        if magic != MAGIC or stop + 1 > len(view) or view[stop] != 10:
            raise ValueError(f"not a frame at {at}")
        directory = bytes(view[begin:begin + directory_size - 4])
        if struct.unpack_from("<I", view, begin + directory_size - 4)[0] != zlib.crc32(directory):
            raise ValueError(f"the directory of the frame at {at} does not hold")
        ids = id_coder.decode(bytes(view[begin + directory_size:stop])).astype("<u4")
        place = 0
        for doc_id, size, flags in np.frombuffer(directory, ENTRY).tolist():
            piece = ids[place:place + size]
            place += size
            count, checksum = count + size, zlib.crc32(piece.tobytes(), checksum)
            if not flags & GOES_ON:
                yield None if flags & NULL_ID else doc_id, count, checksum, piece
                count = checksum = 0
        at = stop + 1


# --- Spark ----------------------------------------------------------------------------


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID) -> None:
    """The documents' ids as files below ``path``."""
    with open(tokenizer_file, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary.value)
        encoder, end = PieceEncoder(tokenizer, worker_table()), struct.pack("<I", end_id)

        def documents():
            for batch in batches:
                for low in range(0, batch.num_rows, 200):
                    some = batch.slice(low, 200)
                    texts = [text or "" for text in some.column("text").to_pylist()]
                    for doc_id, ids in zip(some.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                        yield doc_id, np.frombuffer(ids + end, "<u4")

        for one in frames_of(documents()):
            yield pa.RecordBatch.from_arrays([pa.array([one], pa.binary())], ["value"])

    rows = packed(docs).select(F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("h"),
                               F.monotonically_increasing_id().alias("nr"), F.col("row.text").alias("text"))
    order = ["doc_id", "h", "nr"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    lines = ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\n").option("compression", "none").text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document of the files below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                part = int(re.search(r"part-(\d+)", name.as_py())[1])
                found = [(doc_id, count, checksum) for doc_id, count, checksum, _ in read_frames(content.as_buffer())]
                ids, counts, checksums = zip(*found, strict=True)
                counts = np.array(counts, np.int64)
                columns = [np.full(len(counts), part, np.int64), pa.array(ids, pa.int64()), counts.cumsum() - counts, counts, np.array(checksums, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    found = materialize(files.mapInArrow(run, "part long, doc_id long, start long, n_tokens long, ids_crc32 long"), "token-directory")
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    # one row per file
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", before.alias("before"))
    return found.join(starts, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID) -> DataFrame:
    """The documents written as id files in the shared folder and read back."""
    path = shared_dir(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer_file, end_id)
    return read_ids(docs.sparkSession, path)
