import struct

import pytest
import zstandard as zstd

from quarry.llm import warc
from quarry.llm._store import new_path


def _archive(records):
    return b"".join(warc.archive_frames(records))


RECORDS = [warc.record_bytes(i, f"http://x.example/{i}", f"<p>page {i} of the archive, with some shared text</p>".encode() * 3, None) for i in range(40)]


def test_dictionary_leads_and_records_return():
    data = _archive(RECORDS)
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC
    back = list(warc.archive_records(data))
    assert [r["row_id"] for r in back] == list(range(40)) and not any(r["error"] for r in back)
    assert back[7]["payload"] == b"<p>page 7 of the archive, with some shared text</p>" * 3


def test_every_frame_is_one_record():
    data, at, n = _archive(RECORDS), 0, 0
    while at < len(data):
        at, n = warc.frame_end(memoryview(data), at), n + 1
    assert n == 41


def test_too_few_records_have_no_dictionary():
    back = list(warc.archive_records(_archive(RECORDS[:2])))
    assert len(back) == 2 and not any(r["error"] for r in back)


@pytest.mark.parametrize("change, word", [
    (lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), "version"),
    (lambda r: r.replace(b"WARC-Date: 1970-01-01T00:00:00Z\r\n", b""), "warc-date"),
    (lambda r: r[:-4], "Content-Length"),
    (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: response"), "repeated"),
    (lambda r: r.replace(b"<p>page", b"<q>page"), "digest"),
    (lambda r: r.replace(b"WARC-Type: response", b"no colon"), "malformed"),
])
def test_bad_records_are_named_and_the_walk_goes_on(change, word):
    back = list(warc.archive_records(_archive([RECORDS[0], change(RECORDS[1]), RECORDS[2]])))
    assert len(back) == 3 and word in back[1]["error"] and not back[2]["error"]


def test_broken_archives():
    data = _archive(RECORDS)
    assert list(warc.archive_records(data[:-5]))[-1]["error"] == "truncated frame"
    assert "no frame" in list(warc.archive_records(b"x" * 40))[-1]["error"]
    bad = struct.pack("<II", warc.DICTIONARY_MAGIC, 4) + b"abcd" + data
    assert "dictionary" in list(warc.archive_records(bad))[0]["error"]
    assert list(warc.archive_records(b"")) == []
    assert list(warc.archive_records(zstd.ZstdCompressor().compress(b"")))[0]["error"]


def test_round_trip_with_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "u1", "<a>"), (2, None, "<a>"), (3, "a b", None), (4, "u", ""), (5, "u", "é" * 50_000), (1, "u1", "<a>"), (None, "u", "<a>"), (None, "u", "alone")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, sha string, payload string")
    path = new_path(spark, "t")
    warc.write_archives(df, path, "page_id", "url", "html")
    records = warc.read_archives(spark, path)
    got = sorted(((r.row_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.page_digests(records).collect()), key=str)
    assert got == sorted([(1, "response", None, 3), (1, "response", None, 3), (2, "revisit", 1, 3), (3, "response", None, 0), (4, "revisit", 3, 0), (5, "response", None, 100_000), (None, "revisit", 1, 3), (None, "response", None, 5)], key=str)
    assert records.filter("row_id = 5").first().payload == ("é" * 50_000).encode()


def test_empty_table(spark):
    path = new_path(spark, "t")
    warc.write_archives(spark.createDataFrame([], "id long, url string, payload string"), path)
    assert warc.page_digests(warc.read_archives(spark, path)).count() == 0


def test_an_invalid_record_fails_the_digest_query(spark):
    bad = spark.createDataFrame([("a", 0, None, None, None, None, None, None, None, None, None, "broken")], warc.RECORD)
    with pytest.raises(Exception, match="broken"):
        warc.page_digests(bad).collect()
