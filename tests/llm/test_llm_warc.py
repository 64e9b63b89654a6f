import hashlib

import pytest

from llm_cases import same_rows
from tickloom.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, digest int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA)


def test_round_trip(spark):
    big, small = "<p>ä</p>" * 50, "<p>short</p>"
    rows = [(1, "http://a/\r\nx", big), (2, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""),
            (7, "u", "y" * 300_000), (8, "u", "a\r\n\r\nb" * 20), (None, "u", big), (2, "v", big), (9, "é", "z" * 100), (10, "é", "z" * 99)]
    found = warc.round_trip(pages(spark, rows).repartition(2)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    wanted = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        again = html == big and page_id != 1
        wanted.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None))
    same_rows(found, wanted)


def test_no_pages(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def archive(records, dictionary=b""):
    import zstandard

    compress = zstandard.ZstdCompressor().compress
    return warc.dictionary_frame(dictionary) + b"".join(compress(r) + warc.SEPARATOR.encode() for r in records)


def test_damage_is_found():
    record = warc.record_bytes(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    whole = archive([record])
    assert [r["payload"] for r in warc.read_archive(whole)] == [b"payload"]
    for wrong in (
        record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"WARC-Date", b"X-Date"), record + b"x", record[:-1],
        record.replace(b"payload\r\n", b"pAyload\r\n"), record.replace(b"Content-Length: 7", b"Content-Length 7"),
        record.replace(b"X-Payload-Length: 7", b"X-Payload-Length: 8"),
    ):
        with pytest.raises(ValueError):
            list(warc.read_archive(archive([wrong])))
    for cut in (whole[:-3], whole[:-12], whole + b"12", archive([record]) + warc.dictionary_frame(b"")):
        with pytest.raises(ValueError):
            list(warc.read_archive(cut))


def test_packed_dictionary():
    import zstandard

    raw = b"a shared beginning of many records " * 20
    options = zstandard.ZstdCompressionDict(raw)
    record = warc.record_bytes(3, None, raw, hashlib.sha256(raw).hexdigest(), None)
    frame = zstandard.ZstdCompressor(dict_data=options).compress(record)
    for dictionary in (raw, zstandard.ZstdCompressor().compress(raw)):
        assert [r["page_id"] for r in warc.read_archive(warc.dictionary_frame(dictionary) + frame)] == [3]
