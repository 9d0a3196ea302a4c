"""Archives written, read at any split, and broken on purpose."""

import gzip
import hashlib
import io

import pytest

from sparsight.llm import warc as W


def archive(payloads):
    return b"".join(
        W.member(W.record_bytes(i, f"http://h/{i}", p, hashlib.sha1(p).hexdigest(), None)) for i, p in enumerate(payloads)
    )


def read_all(data, split):
    source = io.BytesIO(data)
    return [W.parse_record(r) for s in range(0, len(data), split) for r in W.owned_records(source, s, min(s + split, len(data)))]


@pytest.mark.parametrize("feed", [1, 7, 4096])
@pytest.mark.parametrize("split", [1, 2, 3, 50, 777, 10**6])
def test_every_record_has_one_owner(monkeypatch, split, feed):
    monkeypatch.setattr(W, "READ_BYTES", 64)
    monkeypatch.setattr(W, "FEED_BYTES", feed)
    payloads = [b"", b"x", b"<p>" + bytes(range(256)) * 20, W.MAGIC * 50, b"a" * 5000]
    got = read_all(archive(payloads), split)
    assert [g["page"] for g in got] == [str(i) for i in range(len(payloads))]
    assert [g["payload"] for g in got] == payloads


def test_bytes_fed_follow_the_bytes_of_the_members(monkeypatch):
    data, fed, make = archive([b"%d" % i * 100 for i in range(2000)]), [], W.zlib.decompressobj

    class Counted:
        def __init__(self, bits):
            self.inner = make(bits)

        def decompress(self, piece):
            fed.append(len(piece))
            return self.inner.decompress(piece)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    monkeypatch.setattr(W.zlib, "decompressobj", Counted)
    assert len(read_all(data, 10**9)) == 2000
    assert sum(fed) <= 2000 * W.FEED_BYTES + 2 * len(data)


def test_false_magic_is_passed_over():
    data = W.MAGIC * 3 + archive([b"one"]) + W.MAGIC + gzip.compress(b"no archive record") + archive([b"two"])
    assert [g["payload"] for g in read_all(data, 40)] == [b"one", b"two"]


def test_damage_raises():
    data = archive([b"text " * 1000])
    with pytest.raises(EOFError):
        read_all(data[:-5], 10**6)
    wrong = W.member(W.record_bytes(1, None, b"text", hashlib.sha1(b"other").hexdigest(), None))
    with pytest.raises(ValueError):
        read_all(wrong, 10**6)


def test_round_trip(spark, tmp_path):
    big, other = "<p>é" * 400, "<p>b" * 400
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://b/\n4", "small"), (5, "u", "small"),
            (6, "u", None), (7, "u", ""), (8, "u", other), (8, "u", other), (9, "u", other), (None, "u", big), (10, "u", "ü" * 500)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    manifest = W.write_warc(W.with_revisits(pages.repartition(3)), f"file://{tmp_path}/out")
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    expected = []
    for page, _, html in rows:
        data = (html or "").encode()
        last = {big: 3, other: 9}.get(html)
        older = last is not None and page is not None and page < last
        expected.append((page and str(page), len(data), hashlib.sha1(data).hexdigest(), "revisit" if older else "response", str(last) if older else None))
    for files in (manifest, W.list_archives(spark, f"file://{tmp_path}/out")):
        got = W.read_warc(files, split_bytes=200, with_payload=True).collect()
        assert sorted(map(str, ((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, expected))
        assert {r.payload.decode() for r in got if r.page == "10"} == {"ü" * 500}
    for file in manifest.collect():  # any gzip reader takes the files
        with gzip.open(file.file.removeprefix("file://")) as f:
            assert f.read().count(b"WARC/1.1") == file.records


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert W.read_warc(W.write_warc(W.with_revisits(pages), f"{tmp_path}/none")).count() == 0
