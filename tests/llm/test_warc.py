import base64
import hashlib
from collections import defaultdict

from quillspark.llm import warc

PAGES = "page_id long, url string, html string, row string, sha1 string, size string, first string, chunk string"


def hard_pages(spark):
    rows = [
        (1, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "http://c/", None),
        (4, "http://d/", ""), (5, "http://e/\r\nX: 1 é", "é\r\n\r\nWARC/1.1\r\n" * 50), (6, "", "x" * 1_000_000), (7, "u", "日本" * 70_000),
        (None, "u", "<p>same</p>"), (None, "u", "lone"), (8, "u", "repeat"), (8, "u", "repeat"), (10, "u", "a" * 64), (11, "u", "a" * 128),
    ]
    return rows, spark.createDataFrame([r + ("x",) * 5 for r in rows], PAGES).repartition(3)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_hard_pages(spark):
    rows, pages = hard_pages(spark)
    got = warc.archive_pages(pages).collect()
    assert sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"]) for r in got) == sorted(
        (p or -1, len((h or "").encode()), digest(h)) for p, _, h in rows)
    groups = defaultdict(list)
    for r in got:
        groups[r["payload_digest"]].append(r)
    for members in groups.values():
        responses = [r for r in members if r["record_type"] == "response"]
        assert len(responses) == 1 and responses[0]["refers_to"] is None and responses[0]["intact"]
        last = max((r["page_id"] for r in members if r["page_id"] is not None), default=None)
        assert responses[0]["page_id"] == last
        assert all(r["refers_to"] == last for r in members if r["record_type"] == "revisit")


def test_chunks_round_trip(spark):
    rows, pages = hard_pages(spark)
    manifest = warc.write_archives(pages, chunk_bytes=64)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    records = defaultdict(list)
    for r in warc.read_archives(manifest, chunk_bytes=50).collect():
        records[r["record_id"]].append(r)
    assert len(records) == len(rows)
    html = {p: (h or "").encode() for p, _, h in rows if p is not None}
    for chunks in records.values():
        chunks.sort(key=lambda r: r["chunk"])
        assert [r["chunk"] for r in chunks] == list(range(len(chunks))) and [r["last"] for r in chunks][-1]
        if chunks[0]["record_type"] == "response" and chunks[0]["page_id"] is not None:
            data = b""
            for r in chunks:
                assert len(r["data"]) <= 50
                data += bytes(r["data"])
                assert r["bytes_so_far"] == len(data) and r["digest_so_far"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
            assert data == html[chunks[0]["page_id"]] and chunks[-1]["intact"]


def test_small_payloads_are_never_revisits(spark):
    _, pages = hard_pages(spark)
    got = warc.read_archives(warc.write_archives(pages, least_bytes=8)).where("last").collect()
    assert all(r["record_type"] == "response" for r in got if r["bytes_so_far"] < 8)
    assert any(r["record_type"] == "revisit" for r in got)


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).collect() == []


def test_archives_are_plain_gzip_members(spark):
    import gzip

    _, pages = hard_pages(spark)
    for row in warc.write_archives(pages).collect():
        with open(row["archive"].removeprefix("file:"), "rb") as f:
            data = f.read()
        assert len(data) == row["bytes"] and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
