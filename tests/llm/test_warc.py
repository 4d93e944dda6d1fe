import hashlib
import io
import zipfile

import pytest

from seqloom.llm import warc

SCHEMA = "page_id long, url string, html string, first string, n int, _digest string"
BIG = "x" * 200
PAGES = [(5, "http://a/é b", BIG), (3, "http://b", BIG), (9, None, BIG), (3, "http://b", BIG), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "ü" * 50), (8, "u", "ü" * 50), (10, "u", "HTTP/1.1\r\n\r\nWARC/1.1 PK\x05\x06" * 20), (None, "u", BIG), (None, "u", "alone" * 50)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


def test_round_trip(spark):
    rows = warc.round_trip(pages(spark)).collect()
    raw = [(i, (h or "").encode()) for i, _, h in PAGES]
    first = {}
    for i, b in raw:
        if i is not None:
            first[b] = min(i, first.get(b, i))
    count = {b: sum(x == b for _, x in raw) for _, b in raw}
    want = []
    for i, b in raw:
        again = len(b) >= 100 and count[b] > 1 and i != first[b]
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert warc.round_trip(pages(spark, [])).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_directories(wide):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in (("a/ä.txt", b"first"), ("b.bin", bytes(1000))):
            with z.open(name, "w", force_zip64=wide) as f:
                f.write(data)
        z.comment = b"a comment"
    data = out.getvalue()
    if wide:  # an end record that sends the reader to the ZIP64 ones
        at = data.rfind(b"PK\x05\x06")
        import struct

        count, size, start = struct.unpack("<HII", data[at + 10 : at + 20])
        end = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, start)
        locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at, 1)
        data = data[:at] + end + locator + data[at : at + 8] + struct.pack("<HHII", 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF) + data[at + 20 :]
    found = warc.members(lambda a, n: data[a : a + n], len(data))
    assert list(found) == ["a/ä.txt", "b.bin"]
    _, _, start, length = found["b.bin"]
    assert data[start : start + length] == bytes(1000)


def test_an_archive_is_a_zip_file():
    records = [(str(i), warc.warc_record(str(i), "u", b"p" * i, "d", i, None)) for i in range(5)]
    data = warc.build_archive(records)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist() == [warc.DATA, warc.INDEX] and z.testzip() is None
    assert [r["payload"] for r in warc.read_records(lambda a, n: data[a : a + n], len(data))] == [b"p" * i for i in range(5)]
    with pytest.raises(ValueError):
        list(warc.read_records(lambda a, n: data[: len(data) - 30][a : a + n], len(data) - 30))
