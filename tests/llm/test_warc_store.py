import hashlib

import pytest

from arenaflow.llm import warc_store as ws

ROWS = [
    (5, "http://a/x", "A" * 200), (3, "http://a/y\r\nWARC-Type: revisit", "A" * 200), (9, None, "A" * 200), (1, "u", "short"), (2, "u", "short"),
    (7, "u", None), (8, "u", ""), (10, "u", "é😀\r\n\r\nWARC/1.1\r\n" * 20), (11, "u", "é😀\r\n\r\nWARC/1.1\r\n" * 20), (3, "http://a/y", "A" * 200),
    (None, "u", "B" * 100),
]


@pytest.fixture
def archive(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")
    ws.write_archive(pages, str(tmp_path / "a"))
    return str(tmp_path / "a")


def test_round_trip(spark, archive):
    got = ws.read_archive(spark, archive).collect()
    assert sorted((r.page_id or -1, bytes(r.payload)) for r in got) == sorted((i or -1, (h or "").encode()) for i, _, h in ROWS)
    for r in got:
        assert r.payload_digest == hashlib.sha256(bytes(r.payload)).hexdigest() and r.payload_bytes == len(r.payload)
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and r.header.encode() == head + b"\r\n"
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert fields["WARC-Type"] == r.record_type and len(body) == int(fields["Content-Length"]) + 4
        assert r.record_type == "revisit" or body == bytes(r.payload) + b"\r\n\r\n"
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got)
    assert (5, "revisit", 3) in kinds and (9, "revisit", 3) in kinds and kinds.count((3, "response", None)) == 2
    assert (11, "revisit", 10) in kinds and (2, "response", None) in kinds and (-1, "response", None) in kinds


def test_payloads_are_stored_once(spark, archive):
    assert spark.read.parquet(f"{archive}/payloads").count() == len({h or "" for _, _, h in ROWS})
    plain = ws.read_archive(spark, archive, with_payload=False)
    assert plain.count() == len(ROWS) and "payload" not in plain.columns


def test_a_damaged_payload_raises(spark, archive, tmp_path):
    p = spark.read.parquet(f"{archive}/payloads")
    blobs = {r.digest: r.blob for r in p.collect()}
    keys = sorted(blobs)
    spark.createDataFrame([(k, blobs[keys[0]]) for k in keys], "digest string, blob binary").write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(f"{archive}/headers").write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="wrong payload"):
        ws.read_archive(spark, str(tmp_path / "b")).collect()


def test_one_digest_with_unequal_payloads_raises(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ws, "digest_of", lambda payload: F.lit("same"))
    for n, texts in enumerate((["A" * 200, "B" * 333], ["A" * 200, "B" * 200])):
        pages = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
        with pytest.raises(Exception, match="unequal payloads"):
            ws.write_archive(pages, str(tmp_path / str(n)))


def test_empty(spark, tmp_path):
    ws.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert ws.read_archive(spark, str(tmp_path / "e")).count() == 0
