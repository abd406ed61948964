import base64
import gzip
import hashlib
from pathlib import Path

from thalweg.llm.warc import assemble, captures, parse_archive, read_archives, write_archives

ROWS = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/ 4\r\n", ""), (5, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n é☃"), (None, "n", "null id"), (7, "r", "again"), (7, "r", "again"), (8, "s", "big " * 50_000)]
SCHEMA = "page_id long, url string, html string"


def test_round_trip(spark, tmp_path):
    write_archives(spark.createDataFrame(ROWS, SCHEMA), f"{tmp_path}/w")
    data = [gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "w").glob("part*")]
    records = [r for d in data for r in parse_archive(d)]
    assert len(records) == 3 * len(ROWS)
    assert all(d.count(b"WARC/1.1\r\nWARC-Type") == len(list(parse_archive(d))) for d in data)
    nested = assemble(read_archives(spark, f"{tmp_path}/w")).collect()
    assert len(nested) == len(ROWS) and all(r.request and r.metadata for r in nested)
    assert {bytes(r.response.payload).decode() for r in nested if r.kind == "response"} == {h or "" for _, _, h in ROWS}


def test_captures_against_brute_force(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS bytes", "2 AS digest", "3 AS rec", "4 AS payload_bytes")
    got = captures(pages).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert sorted(r.payload_digest for r in got) == sorted(digest(h) for *_, h in ROWS)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert (by[1][0].record_type, by[1][0].refers_to) == ("revisit", 2) and (by[2][0].record_type, by[2][0].refers_to) == ("response", None)
    assert (by[3][0].record_type, by[3][0].refers_to, by[3][0].payload_bytes) == ("revisit", 4, 0)
    assert sorted((r.record_type, r.refers_to) for r in by[7]) == [("response", None), ("revisit", 7)] or sorted(r.record_type for r in by[7]) == ["response", "revisit"]
    assert by[None][0].record_type == "response" and by[8][0].payload_bytes == 200_000
    assert captures(pages.limit(0)).count() == 0
    assert {r.record_type for r in captures(pages, min_bytes=10**6).collect()} == {"response"}


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    from thalweg.llm import warc

    monkeypatch.setattr(warc, "FILE_BYTES", 50_000)
    pages = spark.createDataFrame([(i, f"u{i}", f"{i} " + "x" * 20_000) for i in range(20)], SCHEMA).coalesce(1)
    write_archives(pages, f"{tmp_path}/w")
    sizes = [len(gzip.decompress(p.read_bytes())) for p in Path(tmp_path, "w").glob("part*")]
    assert len(sizes) >= 10 and max(sizes) < 60_000
    assert assemble(read_archives(spark, f"{tmp_path}/w")).count() == 20
