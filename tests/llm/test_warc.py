"""WARC archives: round trips, and faults that reading must find."""

import glob
import hashlib
import os

import pytest
import zstandard

from protospan.llm import queries, warc

SCHEMA = "page_id long, url string, html string, `a.b` int, PAYLOAD string, frame string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)


def brute(rows, least=1000):
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        same = [j for j, _, t in rows if (t or "").encode() == b and j is not None] if len(b) >= least else []
        last = max(same, default=None)
        again = last is not None and i != last
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(map(str, out))


ROWS = [
    *((i, f"http://a.example/{i}?q=1", f"<html>{i}{'word ' * (i % 400)}</html>") for i in range(150)),
    *((1000 + i, "http://hot.example/", "<p>hot</p>" * 200) for i in range(70)),
    *((2000 + i, "http://two.example/", f"<p>{i // 2}</p>" * 200) for i in range(20)),
    *((3000 + i, "http://short.example/", "<p>short</p>") for i in range(5)),
    (4000, None, None), (4001, "", ""), (4002, "http://x/\r\nWARC-Type: evil\r\n é", "a\r\n\r\nb\x00€"), (4003, "u", "x" * 999), (4004, "u", "x" * 999), (4005, "u", "y" * 1000), (4006, "u", "y" * 1000),
    (4007, "u", "ü" * 500), (4008, "u", "ü" * 500), (None, "u", "y" * 1000), (None, "u", "z" * 1000), (None, "u", "z" * 1000), (4006, "u", "y" * 1000), (4009, "u", "P*M\x18\0\0\0\0" * 200), (4010, "long", "long text " * 300_000),
]


@pytest.mark.parametrize("size", [1 << 12, 1 << 24])
def test_round_trip(spark, tmp_path, size):
    folder = warc.write_archives(table(spark, ROWS), f"{tmp_path}/w", archive=size)
    rows = warc.read_archives(spark, folder, payload=True).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows) == brute(ROWS)
    html = {(i, (t or "").encode()) for i, _, t in ROWS}
    url = {(i, u) for i, u, _ in ROWS}
    for r in rows:
        assert (r.page_id, bytes(r.payload)) in html if r.record_type == "response" else not r.payload
        assert (r.page_id, r.url) in url or r.page_id == 4002 and r.url.startswith("http://x/%0D%0AWARC-Type:%20evil")
    files = [f for f in glob.glob(f"{folder}/part-*") if os.path.getsize(f)]
    assert (len(files) > 20) == (size < 1 << 20)
    for f in files:  # the leading frame is the dictionary's
        assert open(f, "rb").read(4) == warc.OWN_DICTIONARY


def test_query(spark, tmp_path):
    table(spark, ROWS).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(str(tuple(r)) for r in queries.op13_warc(spark, str(tmp_path)).collect()) == brute(ROWS)
    table(spark, []).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.op13_warc(spark, f"{tmp_path}/none").collect() == []


def archive(records, raw=b"", packed=False):
    own = zstandard.ZstdCompressionDict(raw) if raw else None
    packer = zstandard.ZstdCompressor(dict_data=own, write_checksum=True)
    lead = zstandard.ZstdCompressor().compress(raw) if packed else raw
    return warc.OWN_DICTIONARY + len(lead).to_bytes(4, "little") + lead + b"".join(packer.compress(r) for r in records)


def good(i=1, payload=b"<p>one</p>", refers_to=None):
    return warc._record(i, "http://e/", payload, refers_to, hashlib.sha1(payload).digest())


def test_dictionaries():
    raw = zstandard.train_dictionary(2048, [good(i, b"<p>%d</p>" % i * 30) for i in range(200)]).as_bytes()
    for made in (archive([good(), good(2)], raw), archive([good(), good(2)], raw, packed=True), archive([good(), good(2)])):
        assert [warc.parsed(r)["page_id"] for _, r in warc.frames_of(memoryview(made))] == [1, 2]
    # Without its dictionary a frame cannot be read.
    bare = archive([good()], raw)
    with pytest.raises(ValueError):
        list(warc.frames_of(memoryview(bare[8 + len(raw) :])))


@pytest.mark.parametrize("broken", [
    lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r.replace(b"WARC-Record-ID", b"WARC-Other-ID"), lambda r: r[:-1], lambda r: r + b"x", lambda r: r.replace(b"<p>one", b"<p>two"),
    lambda r: r.replace(b"Content-Length: 10\r\n", b"Content-Length: 11\r\n"), lambda r: r.replace(b"\r\nPage-ID", b"\r\nno colon\r\nPage-ID"), lambda r: r.replace(b"\r\nPage-ID", b"\r\nWARC-Type: revisit\r\nPage-ID"),
    lambda r: b"", lambda r: r.replace(b"HTTP/1.1", b"HTTX/1.1"), lambda r: r.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:AAAA"),
])
def test_bad_records(broken):
    warc.parsed(good())
    with pytest.raises(ValueError):
        warc.parsed(broken(good()))


def test_revisits_and_other_types():
    assert warc.parsed(good(3, b"x" * 2000, 9))["payload_bytes"] == 2000
    with pytest.raises(ValueError):
        warc.parsed(good(3, b"x" * 2000, 9).replace(b"WARC-Profile", b"WARC-Other"))
    info = good().replace(b"WARC-Type: response", b"WARC-Type: warcinfo")
    assert warc.parsed(info) == {"record_type": "warcinfo"}


def test_bad_archives(spark, tmp_path):
    whole = archive([good(), good(2)])
    for bad in (whole[:-3], whole[:6], whole + b"abcd", whole[:40] + b"\0\0\0" + whole[43:], b"\x5d\x2a\x4d\x18\x04\0\0\0abcd"):
        with pytest.raises(ValueError):
            list(warc.frames_of(memoryview(bad)))
    (tmp_path / "bad.warc.zst").write_bytes(whole[:-3])
    with pytest.raises(Exception, match="bad.warc.zst at .*cut off"):
        warc.read_archives(spark, str(tmp_path)).collect()
