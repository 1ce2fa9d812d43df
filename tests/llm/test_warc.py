import base64
import hashlib
import io
import zlib

import pytest

from reelgraph.llm import warc
from tests.llm import data

PAGES = [
    (1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "bad\r\nurl", "é" * 70_000),
    (6, "c", "tail\r\n\r\nWARC/1.1\r\n"), (7, "d", "<p>x</p>"), (7, "d", "<p>x</p>"), (None, "e", "alone"), (None, "f", "<p>x</p>"),
    (-9, "g", "minus"),
]


def expected(rows):
    best = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if page is not None:
            best[body] = max(page, best.get(body, page))
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        response = best.get(body) in (page, None)
        out.append((page, len(body), digest, "response" if response else "revisit", None if response else best[body]))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, sha string, last int")


def test_odd_pages(spark):
    got = [tuple(r) for r in warc.round_trip(pages(spark, PAGES)).collect()]
    assert sorted(got, key=repr) == expected(PAGES)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_small_table(spark):
    df = data.table(spark, "pages")
    rows = [(r["page_id"], r["url"], r["html"]) for r in df.collect()]
    assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=repr) == expected(rows)


def test_files_and_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    manifest = warc.archive(pages(spark, PAGES), f"file://{tmp_path}/out")
    assert manifest.count() > 3 and sum(r["records"] for r in manifest.collect()) == len(PAGES)
    back = {r["page_id"]: r for r in warc.read_archives(manifest).collect()}
    assert bytes(back[5]["payload"]).decode() == "é" * 70_000 and back[5]["url"] == "badurl"
    assert back[1]["payload"] is None and back[1]["refers_to"] == 7
    first = sorted((tmp_path / "out").glob("*.gz"))[0].read_bytes()
    assert zlib.decompressobj(31).decompress(first).startswith(b"WARC/1.1\r\n")


@pytest.mark.parametrize("change", [
    lambda b: b[:-3], lambda b: b.replace(b"hello", b"jello"), lambda b: b.replace(b"Content-Length: 9", b"Content-Length: 8"),
])
def test_damage_is_noticed(change):
    plain = warc.record(1, "u", b"hello all", warc.digest_of(b"hello all"), None)
    assert len(list(warc.records(io.BytesIO(warc.member(plain) * 2)))) == 2
    broken = warc.member(change(plain)) if change(plain) != plain[:-3] else warc.member(plain)[:-3]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(broken)))


def test_record_ids():
    for page in (None, 0, 7, -9, (1 << 63) - 1, -(1 << 63)):
        assert warc.page_of(warc.record_id(page)) == page
