import base64
import hashlib
import io

import pytest

from kairograph.llm import queries, warc


def brute(rows):
    last = {}
    for i, html in rows:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    out = []
    for i, html in rows:
        data, top = (html or "").encode(), last.get(html or "")
        revisit = top is not None and i != top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def digest_columns(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_odd_rows(spark):
    rows = [(1, "<p>é</p>"), (2, "<p>é</p>"), (2, "<p>é</p>"), (3, None), (4, ""), (None, "x\r\n\r\ny"), (None, "<p>é</p>"), (7, "long " * 100_000), (8, "WARC/1.1\r\nContent-Length: 3")]
    pages = spark.createDataFrame([(i, f"http://a.example/{i} b" if i else None, t, "clash") for i, t in rows], "page_id long, url string, html string, payload string")
    assert digest_columns(warc.round_trip(spark, pages)) == brute(rows)


def test_empty(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_table(spark, data):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    assert digest_columns(queries.op10_warc_zstd(spark, data)) == brute(rows)


def test_payloads_survive(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").limit(40)
    want = {r.page_id: r.html.encode() for r in pages.collect()}
    got = {r.page_id: bytes(r.payload) for r in warc.round_trip(spark, pages).filter("record_type = 'response'").collect()}
    assert got == want


def archive(records):
    sink = io.BytesIO()
    writer = warc.ArchiveWriter(sink)
    for r in records:
        writer.write(r)
    writer.close()
    return sink.getvalue()


RECORDS = [warc.record(f"urn:page:{k}", "http://a/", b"<html>some page %d with words</html>" % k * 40, "2024-01-01T00:00:00Z") for k in range(60)]


@pytest.mark.parametrize("number", [0, 1, 60])
@pytest.mark.parametrize("chunk", [7, 256 << 10])
def test_reader(number, chunk):
    data = archive(RECORDS[:number])
    assert (data[:4] == b"\x5d\x2a\x4d\x18") == (number == 60)  # the dictionary leads
    assert list(warc.read_records(io.BytesIO(data), chunk)) == RECORDS[:number]


def test_cut_off():
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_records(io.BytesIO(archive(RECORDS)[:-9])))


@pytest.mark.parametrize(
    "bad",
    [b"", b"GET / HTTP/1.1\r\n\r\n", RECORDS[0][:-1], RECORDS[0] + b"x", RECORDS[0].replace(b"WARC-Date", b"WARC-Data"), RECORDS[0].replace(b"page 0", b"page 1"), RECORDS[0].replace(b"WARC-Type:", b"WARC-Type")],
)
def test_validation(bad):
    with pytest.raises(ValueError):
        warc.parse_record(bad)


def test_lenient_reading(spark, tmp_path):
    path = tmp_path / "a.warc.zst"
    path.write_bytes(archive([RECORDS[0], RECORDS[1][:-1], RECORDS[2]])[:-5])
    rows = warc.read_archives(spark.createDataFrame([(str(path),)], "path string"), strict=False).collect()
    assert [r.record_id for r in rows] == ["urn:page:0", None, None]
    assert "bytes" in rows[1].error and "cut off" in rows[2].error
