"""Archives: round trips, what the reader refuses, and the query's columns."""

import hashlib

import pytest
import zstandard

from solvenza.llm import warc

BIG = "<html>" + "x" * 2000


def pages(spark, rows):
    schema = "page_id long, url string, html string, digest string, _page long"
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], schema)


def test_round_trip(spark):
    rows = [
        (1, "http://a.example/1", BIG), (2, "http://a.example/ü x\n", BIG), (5, None, BIG), (3, "u", "small"),
        (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", BIG), (8, "u", "日本" * 400), (9, "u", "日本" * 400),
        (10, "u", "z" * 3_000_000), (5, None, BIG),
    ]
    found = sorted(warc.round_trip(pages(spark, rows)).collect(), key=str)
    expected = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        ids = [i for i, _, h in rows if h == html and i is not None]
        refers = max(ids) if len(payload) >= 1000 and page_id != max(ids) else None
        expected.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(),
                         "revisit" if refers else "response", refers))
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(expected, key=str)
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_archive_starts_with_its_dictionary(tmp_path, spark):
    records = [warc.record(i, "http://x.example/", f"<p>{i} common words in all pages</p>".encode(), None) for i in range(300)]
    data = warc.archive(records)
    assert data[:4] == warc.DICTIONARY_MAGIC
    read = list(warc.records_of(data, strict=True))
    assert [r["record_id"] for r in read] == [f"urn:page:{i}" for i in range(300)]
    # Every frame is a record of its own, at the position that is given.
    trained, _ = warc.read_dictionary(memoryview(data))
    one = zstandard.ZstdDecompressor(dict_data=trained).decompressobj().decompress(data[read[7]["position"]:])
    assert one == records[7]


def test_plain_dictionaries_and_none():
    record = warc.record(1, "u", b"abc", None)
    plain = zstandard.ZstdCompressionDict(b"WARC/1.1 Content-Length" * 9, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    frame = zstandard.ZstdCompressor(dict_data=plain).compress(record)
    front = warc.DICTIONARY_MAGIC + len(plain.as_bytes()).to_bytes(4, "little") + plain.as_bytes()
    assert [r["payload"] for r in warc.records_of(front + frame, True)] == [b"abc"]
    assert [r["payload"] for r in warc.records_of(zstandard.compress(record), True)] == [b"abc"]
    unsized = zstandard.ZstdCompressor(write_content_size=False).compress(record)
    assert [r["payload"] for r in warc.records_of(unsized + unsized, True)] == [b"abc", b"abc"]
    assert list(warc.records_of(b"", True)) == []


@pytest.mark.parametrize("old,new,says", [
    (b"WARC/1.1", b"WARC/9.9", "no WARC header"),
    (b"WARC-Date", b"WARC-Dote", "missing warc-date"),
    (b"Content-Length: 3\r\n\r\nabc", b"Content-Length: 4\r\n\r\nabc", "digest"),
    (b"abc", b"abcd", "bytes in the frame"),
    (b"abc", b"abd", "digest"),
    (b"HTTP/1.1", b"FTTP/1.1", "digest"),
    (b"WARC-Type: response", b"WARC-Type: revisit!", None),
])
def test_broken_records(old, new, says):
    broken = warc.record(1, "u", b"abc", None).replace(old, new, 1)
    good = zstandard.compress(warc.record(2, "u", b"abc", None))
    data = zstandard.compress(broken) + good
    rows = list(warc.records_of(data, strict=False))
    assert len(rows) == 2 and rows[1]["payload"] == b"abc"
    if says:
        assert says in rows[0]["problem"]
        with pytest.raises(warc.BadRecord, match="record at byte 0"):
            list(warc.records_of(data, strict=True))


def test_length_of_the_block():
    text = warc.record(1, "u", b"abc", None)
    with pytest.raises(warc.BadRecord, match="no number"):
        warc.parse(text.replace(b"Content-Length: ", b"Content-Length: x", 1))


def test_cut_archive():
    data = warc.archive([warc.record(1, "u", b"abc" * 100, None)])
    rows = list(warc.records_of(data[:-3], strict=False))
    assert "ends inside a frame" in rows[-1]["problem"]
    assert "no frame" in list(warc.records_of(b"junk" * 5, strict=False))[0]["problem"]
